"""Ranges, draws, folds, pairing and p-values against plain enumeration."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import accounting, boosting, floors, hypothesis_tests, importance, labels, metrics, ordering, resampling, sampling, sensitivity, split_draws, splits
from signalframe.session import kept


def test_running_sums_and_positions_by_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 5), rng.randint(-3, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, x int, v long").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    want = {r[0]: (k, sum(q[3] for q in ordered[:k])) for k, r in enumerate(ordered)}
    got = ordering.running(df, ["x", "id"], {"k": F.lit(1).cast("long"), "before": F.col("v")})
    assert {r.id: (r.k, r.before) for r in got.collect()} == want
    by_key = {r.id: r.k for r in ordering.numbered(df, ["x", "id"], "k", ("key",)).collect()}
    for key in ("a", "b", None):
        assert [by_key[r[0]] for r in ordered if r[1] == key] == list(range(sum(r[1] == key for r in rows)))
    assert ordering.numbered(df.limit(0), ["id"]).count() == 0


def test_weighted_draws_follow_the_weights(spark):
    rows = [(i, "x" if i < 30 else "y", None if i == 7 else (0 if i == 3 else 1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, weight long")
    got = {r.id: r.times for r in sampling.weighted_draws(df, "id", "weight", 5000, "s").collect()}
    total = sum(w or 0 for *_, w in rows)
    want = {}
    upto = list(itertools.accumulate(w or 0 for *_, w in rows))
    places = spark.range(5000).select(sampling.position("s", F.col("id"), F.lit(total)).alias("at")).collect()
    for p in places:
        i = next(k for k, u in enumerate(upto) if p.at < u)
        want[i] = want.get(i, 0) + 1
    assert got == want and sum(got.values()) == 5000 and not {3, 7} & set(got)
    assert sampling.weighted_draws(df.filter("weight = 0"), "id", "weight", 10, "s").count() == 0
    balanced = sampling.balanced_weight(df.filter("id < 40"), "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert {r.label: round(r.w / 2**32, 3) for r in balanced} == {"x": round(math.sqrt(30), 3), "y": round(math.sqrt(10), 3)}


def test_phases_of_folds_equal_one_by_one():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randint(1, 5)
        loads, plain = [rng.randint(0, 30) for _ in range(k)], None
        plain = loads.copy()
        size, count = rng.randint(1, 7), rng.randint(0, 25)
        want = []
        for _ in range(count):
            f = min(range(k), key=lambda f: (plain[f], f))
            want.append(f)
            plain[f] += size
        got = [None] * count
        for begin, end, folds in splits.greedy_phases(loads, size, count):
            for t in range(begin, end):
                got[t] = folds[(t - begin) % len(folds)]
        assert got == want and loads == plain


def test_clicks_take_the_latest_down_of_the_span(spark):
    rng = random.Random(8)
    rows = [(p, rng.randint(0, 400), i, rng.random() < 0.5) for p in range(3) for i in range(p * 100, p * 100 + 90)]
    got = {(r.participant, r.event_id) for r in labels.unpaired(spark.createDataFrame(rows, "participant long, ts long, event_id long, down boolean"), 25).collect()}
    want = set()
    for p in range(3):
        held = []
        for _, ts, i, down in sorted(r for r in rows if r[0] == p):
            if down:
                held.append(ts)
                want.add((p, i))
                continue
            live = [t for t in held if ts - t <= 25]
            if live:
                held = live[:-1]
            else:
                want.add((p, i))
    assert got == want


def test_exact_p_values_equal_enumeration():
    for n in (1, 4, 9):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs, strict=True) if up) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert math.isclose(hypothesis_tests.signed_rank_p(w, n, 0, 0), min(1, 2 * sum(s <= w for s in sums) / len(sums)))
    for a, b in ((1, 3), (3, 4), (2, 9)):
        us = [sum(i - k for k, i in enumerate(c)) for c in itertools.combinations(range(a + b), a)]
        for u in range(a * b + 1):
            top = max(u, a * b - u)
            assert math.isclose(hypothesis_tests.rank_sum_p(u, a, b, 0), min(1, 2 * sum(x >= top for x in us) / len(us)))
    for n in (3, 10, 100):
        q = hypothesis_tests.t_quantile(0.95, n)
        assert math.isclose(hypothesis_tests.t_two_sided(q, n), 0.05, rel_tol=1e-9)
    assert round(hypothesis_tests.t_quantile(0.95, 10), 4) == 2.2281 and round(hypothesis_tests.t_quantile(0.95, 1), 3) == 12.706


def test_tests_of_small_and_odd_samples(spark):
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 2.0), (5.0, 8.0), (None, 1.0)], "a double, b double")
    r = hypothesis_tests.paired_test(pairs, "a", "b").first()
    d = [1.0, 0.5, -1.0, 3.0]
    mean, sd = sum(d) / 4, math.sqrt(sum((x - sum(d) / 4) ** 2 for x in d) / 3)
    half = hypothesis_tests.t_quantile(0.95, 3) * sd / 2
    assert (r.n, r.differing, r.w_plus, r.w_minus) == (4, 4, 7.5, 2.5)
    assert math.isclose(r.low, mean - half) and math.isclose(r.high, mean + half) and 0 < r.p_t < 1 and 0 < r.p_wilcoxon <= 1
    alike = hypothesis_tests.paired_test(pairs.withColumn("b", F.col("a")), "a", "b").first()
    assert alike.mean == 0 and alike.differing == 0 and alike.p_wilcoxon is None and alike.d_z == 0
    assert hypothesis_tests.mcnemar_test(spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean"), "a", "b").first().p == 1.0
    only_b = hypothesis_tests.mcnemar_test(spark.createDataFrame([(False, True)] * 6, "a boolean, b boolean"), "a", "b").first()
    assert only_b.p == 2 / 2**6 and only_b.odds_ratio == float("inf") and only_b.exact
    two = hypothesis_tests.independent_test(spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0)] + [("y", v) for v in (4.0, 5.0, 6.5)] + [("z", 1.0), ("x", None)], "g string, v double"), "g", "v", "x", "y").first()
    assert (two.n1, two.n2, two.u) == (3, 3, 0.0) and math.isclose(two.p_mann_whitney, 0.1) and two.low < two.mean1 - two.mean2 < two.high


def test_importance_of_a_feature_that_the_score_does_not_use(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame([(i, g, a, b, int(a + rng.gauss(0, 0.2) > 0.5)) for i, g, a, b in rows], "id long, grp long, a double, b double, y int").repartition(4)
    out = {r.feature: r for r in importance.permutation_importance(df, ["a", "b"], lambda x: x.withColumn("p", F.col("a")), 3, "i").collect()}
    assert out["a"].drop > 0.2 and out["b"].drop == 0 and out["b"].sd == 0 and (out["a"].rank, out["b"].rank) == (1, 2)
    taken = importance.shuffled(df, ["a", "b"], 2, "i").collect()
    for f, k in (("a", 2), ("b", 3)):
        for rep in range(2):
            own = [t for t in taken if (t.feature, t.repeat) == (f, rep)]
            assert sorted(t.other for t in own) == sorted(r[k] for r in rows) and sorted(t.id for t in own) == list(range(200))
            assert sum(t.other == rows[t.id][k] for t in own) < 20
    w = importance.within_groups(df, "a").first()
    assert w.groups == 3 and w.low <= w.mean <= w.high


def test_blocks_of_metrics(spark):
    rows = spark.createDataFrame([(i, i % 4, i % 2, 0.3 + 0.4 * (i % 2) + 0.001 * i) for i in range(40)] + [(99, 1, 1, None)], "id long, grp long, y int, p double")
    r = metrics.record_block(rows, 30, 20, "b").first()
    assert (r.n, r.positives, r.groups, r.auc, r.accuracy, r.ap, r.kappa) == (40, 20, 4, 1.0, 1.0, 1.0, 1.0) and r.beats_baseline and r.p_value == 1.0
    folds = spark.createDataFrame([(0, 0, 0, 0.1), (0, 1, 0, 0.2), (0, 1, 1, 0.9), (1, 0, 0, 0.4), (1, 0, 2, 0.6)], "fold int, y_true int, y_pred int, p double")
    a, b = metrics.by_fold(folds, 3, 1).orderBy("fold").collect()
    assert (a.n, a.missing, a.recalls, a.auc, a.f1) == (3, [2], [1.0, 0.5, 0.0], 1.0, 2 / 3)
    assert (b.n, b.missing, b.recalls, b.auc, b.f1) == (2, [1, 2], [0.5, 0.0, 0.0], None, None)


def test_floors(spark):
    rows = [(1, 0.5, 10, 4, 100, 30), (1, 0.7, 4, 3, 100, 30), (2, 0.5, 10, 2, 80, 20), (2, 0.7, 0, 0, 80, 20), (3, 0.5, 0, 0, 10, 1), (3, 0.7, 0, 0, 10, 1)]
    df = spark.createDataFrame([(*r[:2], True, True, r[4], r[5], r[2], r[3]) for r in rows], "grp long, floor double, persistence boolean, cooling boolean, n long, positives long, offers long, correct long")
    # without group 1 there are no offers at 0.7; without group 2 the floor 0.7 is precise
    got = {r.grp: (r.floor, r.offers, r.correct) for r in floors.leave_one_out(df, 0.6).collect()}
    assert got == {1: (0.5, 10, 4), 2: (0.7, 0, 0), 3: (0.7, 0, 0)}
    assert floors.leave_one_out(df.filter("grp = 3"), 0.6).count() == 0
    picks = {r.rule: r.floor for r in floors.selected(df, df, 0.6, 5).collect()}
    assert picks == {"primary": 0.7, "lift": 0.5}


def test_states_of_bins_merge_to_longer_windows(spark):
    rng = random.Random(3)
    rows = [(p, i, rng.randint(0, 999), rng.random() * 1e6, rng.choice("ab")) for p in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "participant long, event_id long, ts long, value double, type string")
    bins = sensitivity.states(df, 50, {"bs": F.col("type") == "b"})
    for r in sensitivity.merged(bins, [1, 3, 20], ["bs"]).collect():
        own = sorted((x for x in rows if x[0] == r.participant and x[2] // (50 * r.factor) == r.w), key=lambda x: (x[2], x[1]))
        v, gaps = [x[3] for x in own], [float(b[2] - a[2]) for a, b in itertools.pairwise(own)]
        mean = sum(v) / len(v)
        assert r.n == len(own) and r.bs == sum(x[4] == "b" for x in own) and (r.low, r.high) == (min(v), max(v))
        assert math.isclose(r.mean, mean) and math.isclose(r.sd, math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)), rel_tol=1e-7, abs_tol=1e-6)
        if gaps:
            g = sum(gaps) / len(gaps)
            assert math.isclose(r.gap_mean, g) and r.gap_max == max(gaps) and math.isclose(r.gap_sd, math.sqrt(sum((x - g) ** 2 for x in gaps) / len(gaps)), rel_tol=1e-7, abs_tol=1e-6)
        else:
            assert r.gap_mean is None and r.gap_max is None


def test_independent_means_draw_each_side_by_itself(spark):
    rows = spark.createDataFrame([(i, i < 5, float(i)) for i in range(12)] + [(50, None, 3.0), (51, True, None)], "id long, side boolean, v double")
    means = resampling.independent_means(rows, F.col("side"), "v", 40, "m").collect()
    assert len(means) == 40 and all(-11 <= r["diff"] <= -1 for r in means) and len({r["diff"] for r in means}) > 10
    ratios = resampling.bootstrap_ratio_by(spark.createDataFrame([(1, "a", 1, 2), (2, "a", 1, 1), (1, "b", 0, 2), (2, "b", 1, 4)], "grp long, k string, hit long, n long"), "k", "hit", "n", 20, "r")
    assert {r.k for r in ratios.collect()} == {"a", "b"} and resampling.interval(ratios, "ratio", "k").count() == 2


def test_families_of_tests(spark):
    df = spark.createDataFrame([("a", "x", 0.01, 0.6), ("b", "x", 0.02, 0.6), ("c", "y", 0.04, 0.4)], "name string, construct string, p double, low double")
    out = {(r.family, r.name): (round(r.q, 9), r.survives_both) for r in metrics.two_families(df, "construct").collect()}
    assert out == {("all", "a"): (0.03, True), ("all", "b"): (0.03, True), ("all", "c"): (0.04, False), ("constructs", "a"): (0.02, True), ("constructs", "c"): (0.04, False)}


@pytest.mark.parametrize("bad", ["b", "c"])
def test_parity_counts_lone_nulls(spark, bad):
    df = spark.createDataFrame([(0.1, 0.1, None), (0.2, None, 0.2)], "a double, b double, c double")
    with pytest.raises(Exception, match="alone"):
        accounting.parity(df, "a", bad).count()


def test_shares_of_blocks_add_up():
    sizes, draws = np.array([3, 0, 10, 7, 1]), np.array([0, 5, 21, 13])
    for replace in (True, False):
        each = [split_draws.shares("s", sizes, b, draws, replace) for b in range(5)]
        assert np.array_equal(sum(each), draws) and not each[1].any()
        assert replace or all((e <= n).all() for e, n in zip(each, sizes, strict=True))
    many = np.array([split_draws.shares("t", sizes, b, np.full(4000, 21), True).mean() for b in range(5)])
    assert np.allclose(many, sizes, atol=0.15)


def plain_auc(pos, neg):
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("cells", [1 << 16, 10])
def test_split_bootstrap_has_the_plain_ones_distribution(spark, monkeypatch, cells):
    monkeypatch.setattr(split_draws, "CELLS", cells)
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 80)
    p = np.round(y * 0.3 + rng.random(80), 1 if cells > 10 else 2)
    rows = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id long, y int, p double")
    got = np.array([r.auc for r in split_draws.bootstrap_auc_rows(rows, 600, "b").collect()])
    plain = []
    for _ in range(600):
        i = rng.integers(0, 80, 80)
        plain.append(plain_auc(p[i][y[i] == 1], p[i][y[i] == 0]))
    assert len(got) == 600 and abs(got.mean() - np.mean(plain)) < 0.01 and abs(got.std() - np.std(plain)) < 0.008
    assert split_draws.bootstrap_auc_rows(rows.filter("y = 1"), 3, "b").select("auc").distinct().collect()[0].auc is None


@pytest.mark.parametrize("size", [4096, 8])
def test_split_permutations_have_the_plain_ones_p(spark, monkeypatch, size):
    monkeypatch.setattr(split_draws, "ROWS", size)
    monkeypatch.setattr(split_draws, "STEP", 500)
    rng = np.random.default_rng(7)
    g, y = np.repeat([0, 1, 2], [30, 25, 5]), rng.integers(0, 2, 60)
    p = np.round(0.08 * y + rng.random(60), 2)
    rows = spark.createDataFrame([(i, int(a) if a else None, int(b), float(c)) for i, (a, b, c) in enumerate(zip(g, y, p, strict=True))], "id long, grp long, y int, p double")
    got = split_draws.permutation_p(rows, 3000, "q").first().p_value
    seen, hits = plain_auc(p[y == 1], p[y == 0]), 0
    for _ in range(3000):
        z = y.copy()
        for k in range(3):
            z[g == k] = rng.permutation(z[g == k])
        hits += plain_auc(p[z == 1], p[z == 0]) >= seen - 1e-12
    assert abs(got - (hits + 1) / 3001) < 0.035
    assert split_draws.permutation_p(rows.withColumn("p", F.lit(0.5)), 20, "q").first().p_value == 1.0


def drawn_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{g}" if g else None, int(y), None if p < 0.05 else round(float(p), 1 if i % 2 else 3), float(q)) for i, (g, y, p, q) in enumerate(zip(rng.integers(0, 9, 600), rng.integers(0, 2, 600), rng.random(600), rng.integers(0, 4, 600), strict=True))]
    return spark.createDataFrame(rows, "id long, grp string, y int, pa double, pb double")


def test_bootstrap_of_few_groups_makes_no_row_for_a_count_and_repetition(spark, monkeypatch):
    rows = drawn_rows(spark)
    monkeypatch.setattr(resampling, "CELLS", 10)  # several ranges of scores
    few = resampling.bootstrap_auc(rows, 50, "f", ["pa"])
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    got = {r.rep: r.auc_pa for r in few.collect()}
    monkeypatch.setattr(resampling, "DRAWN", 0)
    assert got == {r.rep: r.auc_pa for r in resampling.bootstrap_auc(rows, 50, "f", ["pa"]).collect()}
    assert "Aggregate [rep" in plan and "score" not in plan.split("FlatMapGroupsInArrow")[0]  # after the weighing, no scores


def test_paired_bootstrap_of_few_groups_has_the_same_draws_for_both_scores(spark, monkeypatch):
    rows = drawn_rows(spark)
    got = sorted(map(tuple, resampling.bootstrap_auc(rows.withColumn("pc", F.col("pb") * 2), 40, "g", ["pa", "pb", "pc"]).collect()))
    assert len(got) == 40 and all(r[2] == r[3] for r in got)
    monkeypatch.setattr(resampling, "DRAWN", 0)
    assert [r[:3] for r in got] == sorted(map(tuple, resampling.bootstrap_auc(rows, 40, "g", ["pa", "pb"]).collect()))


def test_record_block_with_split_permutations_repeats_no_rows(spark, monkeypatch):
    rows = drawn_rows(spark).filter("grp is not null")
    exact = metrics.record_block(rows, 20, 300, "b", p="pa").first().p_value
    monkeypatch.setattr(resampling, "permutation_p", None)  # which makes a row for each row and permutation
    assert abs(metrics.record_block(rows, 20, 2000, "b", p="pa", split=True).first().p_value - exact) < 0.12


def test_nested_floors_by_ratios_deal_a_reading_once(spark):
    rng = np.random.default_rng(8)
    rows = [(g % 4, g // 4 % 3, g, i, int(rng.random() < 0.3), None if rng.random() < 0.05 else round(float(rng.random()), 6)) for g in range(40) for i in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "outer long, f long, grp long, idx long, y int, p double").repartition(3)
    # ratios that bring scores onto floors and half a millionth below them
    r = spark.createDataFrame([(o, f, float(x)) for (o, f), x in zip(itertools.product(range(4), range(3)), [1.0, 0.5, 2.0, 1.1, 0.9999995, 0.0, 1.3, 0.7, 1.000001, 3.0, 0.25, 1.7], strict=True)], "outer long, f long, r double")
    inner = df.withColumnRenamed("outer", "own").join(r, "f").filter("own <> outer").select("outer", "grp", "idx", "y", F.round(F.least(F.lit(1.0), F.col("p") * F.col("r")), 6).alias("p"))
    levels = [0.3, 0.5, 0.55, 0.7, 1.0]
    want = floors.nested(inner, df, levels, 1.05, 5).collect()
    scaled = floors.nested_scaled(df, r, levels, 1.05, 5)
    assert sorted(want) == sorted(scaled.collect()) and sum(x.offers for x in want) > 0
    for p, hit in ((0.5499995, True), (0.54999949, False), (0.55, True)):
        one = spark.createDataFrame([(0, 0, 1, i, 1, p) for i in range(2)] + [(1, 0, 2, i, 1, 0.9) for i in range(2)], "outer long, f long, grp long, idx long, y int, p double")
        ones = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "outer long, f long, r double")
        picked = {v.outer: v.floor for v in floors.nested_scaled(one, ones, [0.55, 0.8], 0.0, 1).collect()}
        assert picked == {0: 0.55, 1: 0.55 if hit else 0.8}


def test_nested_interval_computes_the_folds_once(spark):
    chosen = spark.range(6).select(F.col("id").alias("outer"), F.lit(0.6).alias("floor"), (F.col("id") + 1).alias("offers"), F.col("id").alias("correct"), F.lit(20).cast("long").alias("n"), F.lit(5).cast("long").alias("positives"))
    chosen = chosen.repartition(3).withColumn("floor", F.rand())
    out = floors.nested_interval(chosen, 50, "n")
    assert "rand(" not in out._jdf.queryExecution().optimizedPlan().toString()  # what it is computed from is no part of the plan
    row = out.first()
    assert (row.offers, row.correct, row.kept) == (21, 15, 50) and row.low <= row.precision <= row.high


def test_shuffled_packs_draws_by_ranges(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(importance, "RANGE", 20)  # several ranges of each repetition
    rows = [(7 * i % 211 - 50, None if i % 17 == 0 else float(i % 5), float(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    by_id = sorted(rows)
    want = set()
    for k, f in ((1, "a"), (2, "b")):
        for repeat in range(3):
            drawn = sorted(rows, key=lambda r, f=f, repeat=repeat: hashlib.md5(f"s:{f}:{repeat}:{r[0]}".encode()).hexdigest())
            want |= {(f, repeat, taker[0], giver[k], taker[2]) for taker, giver in zip(by_id, drawn, strict=True)}
    assert set(map(tuple, importance.shuffled(df, ["a", "b"], 3, "s", keep=("b",)).collect())) == want


def test_importance_of_trees_writes_no_row_a_repetition(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(11 * i % 307 - 20, i % 4, None if i % 19 == 0 else rng.random(), math.nan if i % 23 == 0 else float(rng.randint(0, 6)), 1.0) for i in range(300)]
    df = spark.createDataFrame([(*r, int((r[2] or 0) + 0.1 * r[3] + rng.gauss(0, 0.1) > 0.6)) for r in rows], "id long, grp long, a double, b double, c double, y int").repartition(3)
    features = ["a", "b", "c"]
    boosted = boosting.fitted(df, features, edges=boosting.even_edges(df, features, 16), settings=boosting.Settings(rounds=3))
    score = lambda x: boosting.appended(boosted, x, None, "both").withColumn("p", F.round(F.col("both")[1], 9))
    written = []
    monkeypatch.setattr(importance, "kept", lambda df, label: written.append(kept(df, label)) or written[-1])
    monkeypatch.setattr(importance, "RANGE", 40)  # several ranges of each repetition, and blocks of rows
    monkeypatch.setattr(importance, "PACK", 500)  # several packs of a batch
    want = importance.permutation_importance(df, features, score, 4, "t").orderBy("rank").collect()
    got = importance.trees_importance(df, boosted, 4, "t").orderBy("rank").collect()
    assert [r.feature for r in got] == [r.feature for r in want] and got[0].drop > 0.1 and {r.feature: r.drop for r in got}["c"] == 0
    for g, w in zip(got, want, strict=True):
        assert all(math.isclose(g[c], w[c], abs_tol=1e-12) for c in ("base", "mean", "sd", "drop"))
    assert max(t.count() for t in written) == 300  # before, 300 x 3 x 4 values in order
    one = df.withColumn("y", F.lit(1))  # one class: no model, and no AUC
    none = importance.trees_importance(one, boosting.fitted(one, features, edges=boosted.edges, settings=boosted.settings), 2, "t").collect()
    assert [(r.rank, r.feature, r.base, r.mean) for r in sorted(none, key=lambda r: r.rank)] == [(1, "a", None, None), (2, "b", None, None), (3, "c", None, None)]


def test_values_of_equal_draws_have_one_order():
    import pyarrow as pa

    items = [(0, 5, 3), (1, 9, 4), (0, 5, 1), (0, 2, 7), (1, 1, 8), (0, 2**64 - 1, 2)]
    for order in itertools.permutations(items):
        packs = [(3, np.array([a], np.uint8).tobytes(), np.array([d], np.uint64).tobytes(), np.array([v], np.uint8).tobytes()) for a, d, v in order]
        group = pa.table(dict(zip(("bucket", "at", "draw", "other"), zip(*packs, strict=True), strict=True)))
        got = importance._in_order(3, np.dtype(np.uint8))(group).to_pylist()
        assert [(r["bucket"], r["at"], r["n"], list(r["other"])) for r in got] == [(3, 0, 4, [7, 1, 3, 2]), (3, 1, 2, [8, 4])]
