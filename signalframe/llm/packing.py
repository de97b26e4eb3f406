"""Packing token ids into fixed sequences: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks, written
from .tokens import Ids, encoder

TOKENS = "part long, n_row long, doc_id long, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Every document's ids and its offset within its partition. Ids are 16 bits wide where the vocabulary allows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as ids:
            yield from encoded(ids, batches)

    def encoded(ids: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, row = TaskContext.get().partitionId(), 0, 0
        wide = "<u2" if max(ids.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for i, j, _, _ in text_chunks(batch.column(1), 1 << 21):
                each = [np.append(x, end_id).astype(wide) for x in ids.ids([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])]
                n = np.array([len(x) for x in each], np.int64)
                starts = at + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, part, np.int64)), pa.array(np.arange(row, row + j - i, dtype=np.int64)), batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in each], pa.binary())],
                    ["part", "n_row", "doc_id", "local_start", "n_tokens", "ids"],
                )
                at, row = int(at + n.sum()), row + j - i

    return docs.select("doc_id", "text").mapInArrow(encode, TOKENS)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096) -> DataFrame:
    """Concatenate all documents and cut the stream every ``length`` ids: one row per piece of a document in a sequence.

    Two passes. The first encodes every document once, writes the ids to the shared folder and knows each document's
    offset within its partition; one total per partition is summed before it. The second adds both and cuts. Only these
    totals, one row per partition, are gathered and sent out. Every sequence is full but the last, which is padded.

    Null text is empty and gives the end id alone; empty texts too. A text longer than a sequence spans several; its
    pieces share doc_id and doc_tokens. Repeated rows and equal or null doc_ids are packed each on their own. No rows
    give no rows. Other columns of ``docs`` are not looked at.
    """
    tokens = written(token_rows(docs, tokenizer, end_id), "pack-ids")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("part"), F.coalesce(base, F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, starts, counts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            rows: list[tuple] = []
            for i, blob in enumerate(batch.column(3)):
                at, n, raw = int(starts[i]), int(counts[i]), blob.as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")
                bounds = [0, *range(length - at % length, n, length), n]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    piece = ids[a:b].tobytes()
                    rows.append((docs_[i].as_py(), a, b - a, zlib.crc32(piece), n, (at + a) // length, (at + a) % length, piece))
                if len(rows) >= 4000:
                    yield _pieces(rows)
                    rows = []
            yield _pieces(rows)

    rows = tokens.join(F.broadcast(totals), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")
    return rows.mapInArrow(cut, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
