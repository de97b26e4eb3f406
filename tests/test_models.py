"""Boosted trees, folds and normalisation against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import boosting, normalise

UNIT = boosting.UNIT


def plain_boosting(rows, classes, edges, s):
    """rows: [(features, y)] to learn from; gives a function of features to raw scores."""
    outputs = 1 if classes == 2 else classes
    n = [sum(y == k for _, y in rows) for k in range(classes)]
    w = [sum(n) / (sum(x > 0 for x in n) * x) if x and s.balanced else 1.0 for x in n]
    codes = lambda x: [boosting.MISSING if v is None or v != v else sum(e < v for e in edges[f]) for f, v in enumerate(x)]
    held = [(codes(x), y) for x, y in rows]
    raw = [[0.0] * outputs for _ in rows]
    trees = []

    def node(rows_, g, h, depth):
        sg, sh = sum(g[i] for i in rows_), sum(h[i] for i in rows_)
        leaf = -s.rate * (sg / UNIT) / (sh / UNIT + s.l2)
        best = None
        if depth < s.depth:
            score = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + s.l2)
            for f in range(len(edges)):
                for b in sorted({held[i][0][f] for i in rows_} - {boosting.MISSING}):
                    left = [i for i in rows_ if held[i][0][f] <= b]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if len(left) < s.least or len(rows_) - len(left) < s.least or min(hl, sh - hl) / UNIT < s.least_hessian:
                        continue
                    gain = score(gl, hl) + score(sg - gl, sh - hl) - score(sg, sh)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, b, left)
        if best is None:
            return leaf
        _, f, b, left = best
        inside = set(left)
        return f, b, node(left, g, h, depth + 1), node([i for i in rows_ if i not in inside], g, h, depth + 1)

    def reach(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(s.rounds):
        g, h = [], []
        for (_, y), r in zip(held, raw, strict=True):
            p = [1 / (1 + math.exp(-r[0]))] if outputs == 1 else [math.exp(v) / sum(map(math.exp, r)) for v in r]
            t = [float(y == 1)] if outputs == 1 else [float(y == k) for k in range(classes)]
            g.append([round((a - b) * w[y] * UNIT) for a, b in zip(p, t, strict=True)])
            h.append([round(a * (1 - a) * w[y] * UNIT) for a in p])
        own = [node(list(range(len(rows))), [x[k] for x in g], [x[k] for x in h], 0) for k in range(outputs)]
        trees.append(own)
        for (x, _), r in zip(held, raw, strict=True):
            for k in range(outputs):
                r[k] += reach(own[k], x)
    return lambda x: [sum(reach(own[k], codes(x)) for own in trees) for k in range(outputs)]


def matrix(n, classes, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [round(rng.gauss(0, 1), 2), rng.choice([None, 1.0, 2.0, 3.0]), float(rng.randint(0, 9))]
        y = min(classes - 1, max(0, int((x[0] + (x[1] or 0) / 3 + rng.gauss(0, 0.5)) * classes / 3)))
        rows.append((i, i % 5, *x, y))
    return rows


SCHEMA = "id long, grp long, a double, b double, c double, y int"


@pytest.mark.parametrize(("classes", "every"), [(2, 16), (2, 2), (3, 2)])
def test_boosting_holds_every_group_out_as_separate_fits_do(spark, monkeypatch, classes, every):
    monkeypatch.setattr(boosting, "SCORES_EVERY", every)
    rows = matrix(90, classes, 7)
    s = boosting.Settings(rounds=5, depth=2, least=4, rate=0.3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    edges = boosting.even_edges(df, ["a", "b", "c"], 8)
    boosted = boosting.fitted(df, ["a", "b", "c"], hold_out=True, classes=classes, edges=edges, settings=s)
    got = {r.id: r.p for r in boosting.scored(boosted, df).collect()}
    for g in range(5):
        raw = plain_boosting([(r[2:5], r[5]) for r in rows if r[1] != g], classes, edges, s)
        for r in rows:
            if r[1] == g:
                v = raw(r[2:5])
                want = [1 - 1 / (1 + math.exp(-v[0])), 1 / (1 + math.exp(-v[0]))] if classes == 2 else (np.exp(v) / np.exp(v).sum()).tolist()
                assert np.allclose(got[r[0]], want, atol=1e-6)


def test_passes_do_not_grow_with_groups_and_few_bytes_split_them(spark, monkeypatch):
    rows = matrix(60, 2, 3)
    df, s = spark.createDataFrame(rows, SCHEMA), boosting.Settings(rounds=2, depth=2, least=4)
    calls = []
    passes = boosting.level_sums
    monkeypatch.setattr(boosting, "level_sums", lambda *a: calls.append(len(a[1])) or passes(*a))
    whole = boosting.fitted(df, ["a", "b", "c"], hold_out=True, bins=8, settings=s)
    assert set(calls) == {5} and len(calls) <= 4  # two rounds of two levels for all five models
    calls.clear()
    monkeypatch.setattr(boosting, "SUM_BYTES", 3 * 2 * 256 * 24 * 2)
    parts = boosting.fitted(df, ["a", "b", "c"], hold_out=True, bins=8, settings=s)
    assert set(calls) == {2, 1} and boosting.nodes(parts) == boosting.nodes(whole)


def test_odd_rows_of_boosting(spark):
    s = boosting.Settings(rounds=2, depth=2, least=2)
    rows = [(i, i % 2, float(i), None, float("nan"), i % 3 % 2) for i in range(12)] + [(50, None, 1.0, None, 2.0, 1), (51, 0, 3.0, None, 2.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    boosted = boosting.fitted(df, ["a", "b", "c"], hold_out=True, settings=s)
    p = {r.id: r.p for r in boosting.scored(boosted, df).collect()}
    assert len(p) == 14 and p[50] is None and p[51] is not None
    # a group that holds all of one class has no model; no rows give no models
    alone = spark.createDataFrame([(i, i // 6, float(i), 0.0, 0.0, int(i < 6)) for i in range(12)], SCHEMA)
    boosted = boosting.fitted(alone, ["a"], hold_out=True, settings=s)
    assert boosted.models == [] and {r.p for r in boosting.scored(boosted, alone).select("p").collect()} == {None}
    assert boosting.fitted(alone.limit(0), ["a"], settings=s).models == []
    with pytest.raises(ValueError, match="edges"):
        boosting.binned(alone, ["a"], [[float(k) for k in range(256)]], "grp")


def test_causal_scores_by_fold_and_a_fit_on_them(spark):
    rng = random.Random(5)
    rows = [(p * 100 + i, p % 3, p, i, round(rng.gauss(p, 1 + p), 3), int(rng.random() < 0.4)) for p in range(6) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, grp long, person long, idx long, a double, y int")
    got = normalise.causal_by_fold(df, ["a"], "person", "idx", "grp").collect()
    assert len(got) == 6 * 5 + 6 * 4 * 3
    for r in got:
        past = [x[4] for x in rows if x[2] == r.person and x[3] < r.idx] if r.only is None else [x[4] for x in rows if x[1] != r.only]
        assert math.isclose(r.a_z, (r.a - np.mean(past)) / np.std(past), rel_tol=1e-9, abs_tol=1e-9)
    z = spark.createDataFrame(got).select("id", "grp", "only", "a_z", "y")
    s = boosting.Settings(rounds=3, depth=2, least=3)
    edges = boosting.even_edges(z, ["a_z"], 8)
    boosted = boosting.fitted(z, ["a_z"], hold_out=True, edges=edges, settings=s, only="only")
    p = {r.id: r.p[1] for r in boosting.scored(boosted, z, only="only").collect()}
    assert sorted(p) == sorted(r[0] for r in rows)
    for g in range(3):
        seen = [r for r in got if r.only in (None, g)]
        raw = plain_boosting([((r.a_z,), r.y) for r in seen if r.grp != g], 2, edges, s)
        assert all(math.isclose(p[r.id], 1 / (1 + math.exp(-raw((r.a_z,))[0])), abs_tol=1e-6) for r in seen if r.grp == g)


def test_moments_of_others_are_safe_far_from_zero(spark):
    rows = [(g, 1e8 + g * 10 + k * 0.25) for g in range(4) for k in range(50)]
    got = normalise.others_moments(spark.createDataFrame(rows, "grp long, a double"), ["a"], "grp").collect()
    for r in got:
        rest = np.array([a for g, a in rows if g != r.held])
        assert r.n == 150 and math.isclose(r.m_a, rest.mean()) and math.isclose(r.v_a, rest.var(), rel_tol=1e-6)


def test_quantile_edges(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("double").alias("c"))
    assert boosting.quantile_edges(df, ["a", "b", "c"], 4) == [[249.0, 499.0, 749.0], [1.0], []]
