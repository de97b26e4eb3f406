import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalframe.llm import mixing, packing, queries, token_files
from signalframe.llm.tokens import Ids

from conftest import ODD_TEXTS


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library_on_whole_texts(name):
    rng = random.Random(1)
    alphabet = ["a", "The", "don't", "é", "ß", ".", ",", " ", " ", "\n", "\t", " ", " ", "9", "12", "'s", "$%", "\U0001f600", "́", "  ", "\n\n", "<|endoftext|>"]
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    ids = Ids(queries.tokenizer_path(name), most=500)
    whole = [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 97):
        for got, want, text in zip(ids.ids(texts[i : i + 97]), whole[i : i + 97], texts[i : i + 97]):
            assert got.tolist() == want, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_an_untouched_tokenizer(name):
    path = queries.tokenizer_path(name)
    whole, ids, rng = Tokenizer.from_file(path), Ids(path), random.Random(2)
    letters = [c for c in map(chr, range(0x180)) if c.isalpha()]
    texts = [t for c in letters for t in (c, f"{c}stanbul", f"st{c}n", f"An{c}, {c}. {c}{c}")]
    alphabet = [*letters, *"İİ .,;:!?'9\n字か\u3099", " ", " ", " ", " <|endoftext|> ", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(3000)]
    for got, want, text in zip(ids.ids(texts), whole.encode_batch(texts, add_special_tokens=False), texts):
        assert got.tolist() == want.ids, text


def test_packing_covers_every_id_once(spark, odd_documents):
    path = queries.tokenizer_path("word_bpe_49k.json")
    docs = odd_documents.repartition(3)
    rows = packing.pack(docs, path, 2, 64).collect()
    ids = Ids(path)
    want = sorted((-1 if r.doc_id is None else r.doc_id, [*ids.ids([r.text or ""])[0].tolist(), 2]) for r in docs.collect())
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.length > 0 and r.offset + r.length <= 64
        assert zlib.crc32(r.ids) == r.ids_crc32
        piece = np.frombuffer(r.ids, "<u4").tolist()
        runs = by_doc.setdefault(-1 if r.doc_id is None else r.doc_id, [])
        if r.start == 0:
            runs.append([])
        assert r.start == len(runs[-1])
        runs[-1] += piece
    assert sorted((d, run) for d, runs in by_doc.items() for run in runs) == want
    used = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in used:
        assert s * 64 + o == at
        at += n
    assert packing.pack(odd_documents.limit(0), path).count() == 0


def test_token_files_round_trip(spark, odd_documents):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    files = token_files.write_token_files(odd_documents, path)
    rows = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in odd_documents.collect()], key=lambda x: (x is not None, x))
    at, ids = 0, Ids(path)
    want = {}
    for r in odd_documents.collect():
        x = np.append(ids.ids([r.text or ""])[0], 2).astype("<u4")
        want.setdefault(r.doc_id, []).append((len(x), zlib.crc32(x)))
    for r in rows:
        assert r.start == at
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert token_files.read_token_files(token_files.write_token_files(odd_documents.limit(0), path)).count() == 0


def test_elias_fano_select_and_seek():
    rng = np.random.default_rng(3)
    for top in (1, 10, 10_000, 10**12):
        values = np.sort(rng.integers(0, top, 500))
        ef, _ = token_files.EliasFano.load(memoryview(token_files.EliasFano.of(values).dump()), 0)
        assert ef.all().tolist() == values.tolist()
        assert [ef.select(i) for i in range(500)] == values.tolist()
    ids = [np.arange(n, dtype="<u2") for n in (3, 1, 700, 2)]
    shard = token_files.Shard(token_files.shard_bytes(np.array([5, 5, 900]), 1, np.cumsum([len(x) for x in ids]), np.concatenate(ids)))
    assert [shard.doc_id(i) for i in range(4)] == [None, 5, 5, 900]
    assert shard.ids(2).tolist() == list(range(700)) and shard.offsets(3) == (704, 706)


def test_mix_takes_its_targets(spark, odd_documents):
    docs = odd_documents.filter("doc_id is not null")
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs.repartition(5)).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    for (target, size), taken in by.items():
        assert target <= 2 * size + 1e-6 and abs(sum(taken) - target) <= 1
    assert abs(sum(t for t, _ in by) - 1.5 * total) < 1e-3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_water_filling_by_hand(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size long")).collect()}
    # 1665 words at 5:2:1; a stops at 20, then b at 200, the rest goes to null
    assert got == {"a": 20.0, "b": 200.0, None: 1445.0}


def test_mixed_documents_repeat_and_cut(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y\nz", "en", "s" if i % 2 else "t", 9, "k") for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long, size string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    words = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert words == {k: v for k, v in taken.items() if v}
    assert all(r.n_chars == len(r.text) for r in rows.collect())


def test_other_operators_give_back_an_encoders_memory():
    from signalframe.llm import tokens
    from signalframe.llm.quality import passages

    tokens.ids_of(queries.tokenizer_path("word_bpe_49k.json")).ids(["some words"])
    assert tokens.ids_of.cache_info().currsize
    assert passages(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))[1].tolist() == [1]
    assert not tokens.ids_of.cache_info().currsize


def test_an_idle_worker_gives_back_its_encoder():
    import time

    from signalframe.llm import tokens

    path = queries.tokenizer_path("word_bpe_49k.json")
    with tokens.encoder(path, 0.2) as ids:
        assert len(ids.ids(["some words"])[0])
    with tokens.encoder(path, 0.2) as again:  # the next task comes at once
        assert again is ids
    time.sleep(1)
    assert not tokens.ids_of.cache_info().currsize
