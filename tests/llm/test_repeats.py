import hashlib
import random

import pytest

from signalframe.llm import repeats

from conftest import ODD_TEXTS


def brute(docs, length):
    first = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(first.get(s, repeats.NO_ID), d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(spark, docs, length=50):
    got = repeats.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length).drop("kept").collect()
    return sorted((r.doc_id if r.doc_id is not None else repeats.NO_ID, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "BATCH", 3000)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = list(ODD_TEXTS)
    for _ in range(70):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        t = " ".join(parts)
        texts.append(t)
        if rng.random() < 0.5:  # near copies
            u = list(t)
            for _ in range(rng.randint(0, 3)):
                u[rng.randrange(len(u))] = rng.choice("xyz")
            texts.append("".join(u))
    texts += ["ab" * 300, "ab" * 200, "a" * 49, "a" * 50, "a" * 51, "abc " * 100, texts[-1], texts[-1]]
    ids = rng.sample(range(-50, 10 * len(texts)), len(texts))
    docs = list(zip(ids, texts))
    assert rows_of(spark, docs) == brute([(d, (t or "").encode()) for d, t in docs], 50)


def test_equal_and_null_ids_and_no_rows(spark):
    t = "0123456789" * 6
    docs = [(4, t), (4, t), (None, t), (None, t + "x"), (9, None)]
    want = brute([(repeats.NO_ID if d is None else d, (x or "").encode()) for d, x in docs], 50)
    assert rows_of(spark, docs) == want
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
