import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402
from signalframe.llm import mixing, queries, repeats  # noqa: E402
from signalframe.llm.tokens import Ids  # noqa: E402

from test_near_copies import brute as near_brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage got and gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    out = []
    for _, f in cp.STAGES:
        new = f(spark, docs, SF).toPandas()
        out.append((docs.toPandas(), new))
        if len(out) < len(cp.STAGES):
            docs = spark.createDataFrame(new, schema=docs.schema)
    return out


def test_columns_stay(stages):
    for was, now in stages[:-1]:
        assert list(now.columns) == list(was.columns)
        assert len(now)


def test_quality_takes_rows_away_unchanged(stages):
    was, now = stages[0]
    assert 0 < len(now) < len(was)
    assert now.merge(was, on=list(was.columns)).shape[0] == len(now)


def test_near_copies_equal_brute_force(stages):
    was, now = stages[1]
    want = {d for d, (_, c) in near_brute(list(zip(was.doc_id, was.text))).items() if d == c}
    assert set(now.doc_id) == want and len(now) == len(want) < len(was)


def test_repeats_equal_brute_force(stages):
    was, now = stages[2]
    first = {}
    raw = {d: t.encode() for d, t in zip(was.doc_id, was.text)}
    for d in sorted(raw):
        for i in range(len(raw[d]) - 49):
            first.setdefault(hashlib.blake2b(raw[d][i : i + 50], digest_size=12).digest(), d)
    for d, t in zip(now.doc_id, now.text):
        gone = bytearray(len(raw[d]))
        for i in range(len(raw[d]) - 49):
            if first[hashlib.blake2b(raw[d][i : i + 50], digest_size=12).digest()] < d:
                gone[i : i + 50] = b"\1" * 50
        assert t == bytes(c for c, g in zip(raw[d], gone) if not g).decode("utf-8", "ignore")
    assert (now.n_chars == now.text.map(len)).all()


def test_mix_has_its_size(stages):
    was, now = stages[3]
    words = lambda f: f.text.map(lambda t: len(t.split())).groupby(f.source).sum()
    total, got = words(was), words(now)
    assert abs(got.sum() - 1.5 * total.sum()) <= len(total) + 1
    assert (got <= 2 * total.reindex(got.index)).all()


def test_packing_holds_every_id(stages):
    was, now = stages[4]
    ids = Ids(queries.tokenizer_path("word_bpe_49k.json"))
    n = {}
    for d, x in zip(was.doc_id, ids.ids(list(was.text))):
        n[d] = n.get(d, 0) + len(x) + 1
    assert now.groupby("doc_id").length.sum().to_dict() == n


def test_run_equals_its_stages(spark, stages):
    got = cp.run(spark, SF)
    assert got.count() == len(stages[4][1])
    assert got.agg(F.sum("length")).first()[0] == stages[4][1].length.sum()


@pytest.fixture(scope="module")
def odd_stages(spark, odd_documents):
    """What every stage makes of nulls, empty and long texts, repeated rows, no doc_id and clashing names."""
    docs = odd_documents.withColumn("text_", F.lit("mine")).withColumn("tokens", F.lit(7)).withColumn("cid", F.lit("c"))
    return docs.toPandas(), {name: f(spark, docs, SF) for name, f in cp.STAGES}, docs.columns


def test_stages_keep_odd_columns(odd_stages):
    _, out, columns = odd_stages
    for name, df in list(out.items())[:-1]:
        assert df.columns == columns, name
        assert {r["text_"] for r in df.select("text_").distinct().collect()} <= {"mine"}
        assert df.count() > 0


def test_repeats_keep_nulls_and_rows(odd_stages):
    was, out, _ = odd_stages
    now = out["suffix-array dedup"].toPandas()
    assert len(now) == len(was) and now.text.isna().sum() == was.text.isna().sum()
    assert now.doc_id.isna().sum() == 1


def test_near_copies_keep_what_has_no_partner(odd_stages):
    was, out, _ = odd_stages
    now = out["n-gram Jaccard join"].toPandas()
    assert now.text.isna().sum() == was.text.isna().sum()
    assert (now.doc_id == 3).sum() == (was.doc_id == 3).sum()
    assert sorted(now.doc_id[now.text == "The cat sat."]) == [5]


def test_mix_and_packing_take_every_row(odd_stages):
    was, out, _ = odd_stages
    assert out["mixing sources to target weights"].filter("text is not null").count() > 0
    packed = out["packing"].toPandas()
    assert set(packed.doc_id.dropna()) == set(was.doc_id.dropna())


@pytest.mark.parametrize("k", range(5))
def test_no_rows_give_no_rows(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    name, f = cp.STAGES[k]
    assert f(spark, docs, SF).count() == 0, name
