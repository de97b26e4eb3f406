"""The queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, lexical, line_dedup, mixing, whitening
from .common import table, written


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; the folder is SIGNALFRAME_TOKENIZERS or that of the installed package."""
    if folder := os.environ.get("SIGNALFRAME_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2, 4096).drop("ids")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    return removed(table(spark, sf_dir, "documents"), 50).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import decode_media, encode_media, features

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pcm = b"".join(b["pcm"] for b in sorted(blocks, key=lambda b: b["sample_offset"]))
                rows.append((doc_id, n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(pcm)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    stored = written(encode_media(table(spark, sf_dir, "documents")), "flac-media", compression="zstd")
    return decode_media(stored).mapInArrow(digest, schema)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_copies import near_copy_groups

    return near_copy_groups(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_common_lines(table(spark, sf_dir, "documents"), 10, 1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), 16)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_quality, op3_repeated_passages, op4_toxicity, op5_flac_media, op6_top_k, op7_token_files, op8_near_copies, op9_main_text, op10_source_mix, op11_line_dedup, op12_whitening, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op6_top_k": cover_tree.ORACLE_SQL, "op10_source_mix": mixing.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL, "op13_ranked_search": lexical.ORACLE_SQL}
