import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import text
from signalframe.operators import audits, gate, hypothesis_tests, labels, metrics, resampling, splits, windows
from signalframe.sources import files


def offline(p, floor, least=2, cooldown=3):
    fired, streak, cool = [], 0, 0
    for k, x in enumerate(p):
        streak = streak + 1 if x >= floor else 0
        if cool:
            cool -= 1
        elif x >= floor and streak >= least:
            fired.append(k)
            streak, cool = 0, cooldown
    return fired


def deployed(readings, floor, persistence, cooling, cooldown=3):
    fired, before, last = [], -1, None
    for k, (p, ok) in enumerate(readings):
        now = int(p is not None and p >= 0.5)
        if ok and now and p >= floor and (not persistence or before == 1) and (not cooling or last is None or k - last >= cooldown):
            fired.append(k)
            last = k
        before = now if ok else before
    return fired


@pytest.fixture(params=[(4096, 1024), (7, 3), (1, 2)])
def gate_blocks(request, monkeypatch):
    monkeypatch.setattr(gate, "BLOCK", request.param[0])
    monkeypatch.setattr(gate, "STEP", request.param[1])


def test_offline_gate_equals_a_loop(spark, gate_blocks):
    rng = random.Random(2)
    seqs = {g: [round(rng.random(), 3) for _ in range(40)] for g in range(6)}
    rows = spark.createDataFrame([(g, k, p, int(p * 1000) % 2) for g, s in seqs.items() for k, p in enumerate(s)], "grp long, idx long, p double, y int")
    counts, positions = gate.replay(rows, [0.3, 0.6]).collect(), gate.offers(rows, [0.3, 0.6]).collect()
    assert len(counts) == 12
    for r in counts:
        want = offline(seqs[r.grp], r.floor)
        assert sorted(x.idx for x in positions if (x.grp, x.floor) == (r.grp, r.floor)) == want
        hits = [k for k in want if int(seqs[r.grp][k] * 1000) % 2]
        assert (r.n, r.offers, r.correct) == (40, len(want), len(hits))
        assert sorted(x.idx for x in positions if (x.grp, x.floor) == (r.grp, r.floor) and x.correct) == hits


def test_deployed_gate_equals_a_loop(spark, gate_blocks):
    rng = random.Random(9)
    seqs = {g: [(None if rng.random() < 0.05 else round(rng.random(), 3), rng.random() < 0.8) for _ in range(33)] for g in range(5)}
    rows = spark.createDataFrame([(g, k, p, 1, ok) for g, s in seqs.items() for k, (p, ok) in enumerate(s)], "grp long, idx long, p double, y int, ok boolean")
    variants = [(True, True), (True, False), (False, True), (False, False)]
    for found in (gate.offers(rows, [0.3, 0.6], "deployed", variants=variants).collect(),):
        for g, s in seqs.items():
            for floor in (0.3, 0.6):
                for v in variants:
                    assert sorted(r.idx for r in found if (r.grp, r.floor, r.persistence, r.cooling) == (g, floor, *v)) == deployed(s, floor, *v)


def test_deployed_gate_waits_three_cycles(spark):
    rows = spark.createDataFrame([(1, k, 0.9, k % 2) for k in range(8)], "grp long, idx long, p double, y int")
    assert sorted(r.idx for r in gate.offers(rows, [0.5], "deployed").collect()) == [1, 4, 7]
    assert gate.replay(rows.limit(0), [0.5]).count() == 0 and gate.offers(rows.limit(0), [0.5]).count() == 0


def test_stream_gives_the_offers_of_the_batch(spark, tmp_path):
    from signalframe.streaming import gates

    rng = random.Random(4)
    schema = "grp long, idx long, p double, y int"
    rows = [(g, k, round(rng.random(), 3), 0) for k in range(30) for g in range(4)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gates.offers(stream, 0.4).writeStream.format("memory").queryName("offers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = gate.offers(spark.createDataFrame(rows, schema), [0.4]).select("grp", "idx")
    assert sorted(map(tuple, spark.table("offers").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_counts_stream(spark, tmp_path):
    from signalframe.streaming import gates

    rows = [(f"2024-01-01 0{h}:10:00", "a") for h in (1, 1, 2, 3)]
    spark.createDataFrame(rows, "t string, type string").select(F.col("t").cast("timestamp").alias("ts"), "type").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, type string").parquet(str(tmp_path / "in"))
    q = gates.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 1, 2]


def test_an_empty_bin_is_idle_not_zero(spark):
    e = spark.createDataFrame([("a", 1, 0, "click", 0.0, 0.0, "", 0.0), ("a", 2, 150, "key", 0.0, 0.0, "Backspace", 0.0)], "participant string, event_id long, ts long, type string, x double, y double, key string, dy double")
    rows = {r.bin: r for r in windows.bin_features(e, 30_000, 1000).collect()}
    assert len(rows) == 30
    assert rows[7].idle_time_pct == 1.0 and rows[7].scroll_inactivity_pct == 1.0 and rows[7].click_count == 0.0
    assert math.isclose(rows[0].idle_time_pct, 0.65) and rows[0].backspace_pct == 1.0


def test_hidden_state_is_carried_over_bins(spark):
    e = spark.createDataFrame([("a", 1, 0, "click", 0.0, 0.0, "", 0.0), ("a", 2, 500, "visibility", 0.0, 0.0, "", 1.0), ("a", 3, 2250, "visibility", 0.0, 0.0, "", 0.0)], "participant string, event_id long, ts long, type string, x double, y double, key string, dy double")
    blur = {r.bin: r.blur_time_pct for r in windows.bin_features(e, 4000, 1000).collect()}
    assert blur == {0: 0.5, 1: 1.0, 2: 0.25, 3: 0.0}


def test_five_statistics_of_a_ramp(spark):
    r = windows.five_statistics(spark.range(30).select(F.lit(1).alias("w"), F.col("id").alias("bin"), F.col("id").cast("double").alias("c")), ["c"], ["w"], "bin", 30).first()
    assert (r.c_mean, r.c_min, r.c_max, r.c_trend) == (14.5, 0.0, 29.0, 20.0)


def test_as_of_labels(spark):
    w = spark.createDataFrame([("s1", 1000, 1), ("s1", 2000, 2), ("s2", 500, 3)], "participant string, ts long, seq long")
    r = spark.createDataFrame([("s1", 2100, 9, 2), ("s2", 600, 8, 3), ("s1", 10, 7, 1)], "participant string, ts long, seq long, label long")
    assert {(x.window_seq, x.label) for x in labels.as_of_labels(r, w).collect()} == {(2, 2), (3, 3)}
    assert {(x.window_seq, x.label) for x in labels.band_labels(r, w, 1500).collect()} == {(1, 2), (2, 2), (3, 3)}


def test_section_windows_are_bounded(spark):
    w = spark.createDataFrame([("a", 500, 1), ("a", 1500, 2), ("a", 1800, 3), ("a", 2500, 4), ("a", 5000, 5)], "participant string, ts long, seq long")
    c = spark.createDataFrame([("a", 1000, 1), ("a", 2000, 2), ("a", 3000, 3)], "participant string, ts long, seq long")
    got = {(r.window_seq, r.section_seq) for r in labels.section_windows(w, c, 1_200_000, 600_000).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 3)}
    assert {r.window_seq for r in labels.section_windows(w, c, 600, 100).collect()} == {2, 3, 4}


def test_collapse_sums_probabilities_before_the_largest_is_taken(spark):
    rows = spark.createDataFrame([(0, [0.30, 0.33, 0.35, 0.02])], "y_true int, y_prob array<double>")
    r = metrics.collapsed(rows, [[0, 1], [2, 3]]).first()
    assert r.y_pred == 0 and [round(x, 9) for x in r.y_prob] == [0.63, 0.37]
    with pytest.raises(ValueError):
        metrics.collapsed(rows, [[0, 1], [1, 2]])


def test_clustered_interval_is_wider_than_that_of_rows(spark):
    rng = random.Random(1)
    rows = []
    for g in range(20):  # a group's rows share label and score, so they are worth little more than one
        y, shift = g % 2, rng.gauss(0, 1)
        rows += [(g * 10 + k, g, y, round(0.5 * y + shift + rng.gauss(0, 0.05), 4)) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, grp long, y int, pa double")
    by = lambda d: resampling.interval(resampling.bootstrap_auc(d, 60, "s", ["pa"]), "auc_pa").first()
    a, b = by(df), by(df.withColumn("grp", F.col("id")))
    point = metrics.auc(df, [], p="pa").first().auc
    assert a.low <= point <= a.high and a.high - a.low > b.high - b.low


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double"), []).first().auc is None


def test_folds_split_no_group_and_hold_every_class(spark):
    groups = spark.createDataFrame([(f"g{i}", c) for i, c in enumerate([0] * 26 + [1] * 7 + [2] * 9 + [3] * 5)], "grp string, label int")
    for seed in ("a", "b", "c"):
        s = splits.stratified_split(groups, seed)
        assert s.count() == 47 and s.select("split", "label").distinct().count() == 12
        f = splits.stratified_folds(groups, 5, seed)
        assert f.select("fold", "label").distinct().count() == 20


def test_balanced_folds(spark):
    out = splits.balanced_folds(spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1)], "grp string, n long"), 2).collect()
    load = {}
    for r in out:
        load[r.fold] = load.get(r.fold, 0) + r.n
    assert sorted(load.values()) == [10, 10]


def test_tails():
    assert hypothesis_tests.mcnemar_p(1, 2) == 1.0
    assert abs(hypothesis_tests.t_two_sided(2.0, 10) - 0.073388) < 1e-6
    assert abs(hypothesis_tests.minimum_detectable(15) - 1.0598) < 1e-3


def test_alignment_fails_loudly(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, g string")
    for b in ([(1, "x")], [(1, "x"), (2, "z")], [(1, "x"), (2, "y"), (2, "y")]):
        with pytest.raises(Exception, match="aligned"):
            audits.aligned(a, spark.createDataFrame(b, "id long, g string"), "id", same=["g"]).collect()
    with pytest.raises(Exception, match="no match"):
        audits.complete(a, spark.createDataFrame([(1, 5)], "id long, v long"), "id").collect()
    with pytest.raises(ValueError):
        audits.without_identifiers(a.withColumnRenamed("g", "learner_id"), ["learner_id"])
    with pytest.raises(ValueError):
        audits.not_empty(a.limit(0), "labels")


def test_interaction_log(spark, tmp_path):
    p = tmp_path / "v0.csv"
    lines = ["\t".join(files.LOG_COLUMNS)]
    lines += [f"1\t{1000000 + k * 100}\tMouseMovement\t\t{800 + k}\t400\t" for k in range(6)]
    lines += ["1\t1000700\tKeyPressed\tBACK_SPACE\t\t\t", "1\t1000800\tKeyPressed\tLETTER_A\t\t\t", "1\t1000900\tScroll\t\t\t\t5.0", "1\t1001000\tScroll\t\t\t\t2.0", "1\tbad\tScroll\t\t\t\t2.0"]
    p.write_text("\n".join(lines) + "\n")
    rows = files.interaction_log(spark, [str(p)]).orderBy("ts").collect()
    assert len(rows) == 10 and {r.participant for r in rows} == {"v0_1"}
    assert [r.key for r in rows if r.type == "key"] == ["Backspace", "a"]
    assert [r.dy for r in rows if r.type == "scroll"] == [0.0, -3.0]


def test_interaction_log_reads_by_header_and_kind(spark, tmp_path):
    """Columns in any order among others, every native kind, and none of another."""
    kinds = ["MouseMovement", "MouseClick", "MouseDoubleClick", "MouseButtonDown", "KeyPressed", "Scroll", "Unheard"]
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("url\ttype\tsession\ttimestamp\tkey\tx\ty\tyPosition\temotion_affectiva_Neutral\n" + "".join(f"u\t{k}\t1\t{i}\t\t1\t1\t0\t95\n" for i, k in enumerate(kinds)))
    b.write_text("session\ttimestamp\ttype\tkey\tx\ty\tyPosition\n2\t5\tScroll\t\t\t\t1\n")
    rows = files.interaction_log(spark, [str(a), str(b)], ("emotion_affectiva_Neutral",)).orderBy("participant", "ts").collect()
    assert [r.type for r in rows] == ["move", "click", "click", "click", "key", "scroll", "scroll"]
    assert [r.emotion_affectiva_Neutral for r in rows] == [95.0] * 6 + [None]
    with pytest.raises(ValueError, match="yPosition"):
        (tmp_path / "c.csv").write_text("session\ttimestamp\ttype\tkey\tx\ty\n")
        files.interaction_log(spark, [str(tmp_path / "c.csv")])


def test_collapsing_refuses_a_class_without_a_group(spark):
    rows = spark.createDataFrame([(0, [0.5, 0.3, 0.2]), (2, [0.1, 0.1, 0.8])], "y_true int, y_prob array<double>")
    with pytest.raises(Exception, match="no group holds class 2"):
        metrics.collapsed(rows, [[0], [1]]).collect()


def test_keystroke_log(spark, tmp_path):
    p = tmp_path / "typing.csv"
    p.write_text("User Id;emotionIndex;index;keyCode;keyDown;D1D2\n7;N;0;72;1,58E+12;120,5\n7;N;1;BACK_SPACE;1,58E+12;99999\n7;N;2;73;1,58E+12;\n")
    rows = files.keystroke_log(spark, str(p)).orderBy("event_id").collect()
    assert [r.ts for r in rows] == [0, 120, 5120] and [r.key for r in rows] == ["a", "Backspace", "a"]


def test_research_export_and_codebook(spark, tmp_path):
    items = [{"eventType": "self_report", "sessionId": "s", "learnerId": "l", "timestamp": 5, "payload": {"affect": "Confused"}}, {"event_type": "section_completed", "learner_id": "l", "timestamp": 9, "payload": {"section_id": "x"}}]
    for name, body in (("a.json", items), ("b.json", {"items": items, "sections": {}})):
        (tmp_path / name).write_text(json.dumps(body))
        rows = files.research_events(spark, str(tmp_path / name)).orderBy("ts").collect()
        assert [(r.event_type, r.learner_id, r.affect, r.section_id, r.skipped) for r in rows] == [("self_report", "l", "confused", None, False), ("section_completed", "l", None, "x", False)]
    (tmp_path / "c.json").write_text(json.dumps({"sections": {"T": {"affect": "bored", "course": "c"}}}))
    assert files.codebook(spark, str(tmp_path / "c.json")).collect() == [("T", "bored", "c")]


def pages(page, size):
    return [{"n": k} for k in range((page - 1) * size, min(page * size, 25))], 25


def test_paged_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fake_pages.py").write_text("def pages(page, size):\n    return [{'n': k} for k in range((page - 1) * size, min(page * size, 25))], 25\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fake_pages.py"))
    spark.dataSource.register(files.PagedSource)
    df = spark.read.format("paged").option("provider", "fake_pages:pages").option("size", "10").load()
    assert df.count() == 25 and df.select("page").distinct().count() == 3


def test_text_scores(spark):
    df = spark.createDataFrame([("The gradient descends slowly **down**", "gradient descends quickly"), ("", "x")], "a string, b string")
    r = df.select(text.grounding(F.col("a"), F.col("b")).alias("g"), text.words(F.col("a")).alias("w"), text.has_markdown(F.col("a")).alias("m")).collect()
    assert (r[0].g, r[0].w, r[0].m) == (0.5, 5, True) and (r[1].g, r[1].w) == (0.0, 0)
    s = spark.range(1).select(text.valid_strategy(F.lit('{"action_type":"hint","urgency":"low"}'), ["hint"]).alias("v"), text.valid_strategy(F.lit("not json"), ["hint"]).alias("n")).first()
    assert s.v and not s.n


def test_full_resampling_runs_at_the_repetitions_of_the_reference(spark, monkeypatch):
    from signalframe.plans import catalog, prediction_queries
    from signalframe.sources import views

    rows = spark.createDataFrame([(i, f"g{i % 3}", i, int(i % 60 >= 48), float(i % 60)) for i in range(120)], "id long, grp string, idx long, y int, p double")
    monkeypatch.setattr(prediction_queries.views, "binary_predictions", lambda *_: rows)
    assert catalog.queries()["r04_within_group_permutation_full"](spark, "").first().p_value == round(1 / 2001, 6)  # 20 permutations give no p below 1/21
    both = rows.select("id", "grp", "y", F.lit(0.5).alias("pa"), F.lit(0.4).alias("pb"))
    monkeypatch.setattr(views, "document_predictions", lambda *_: both)
    kept = {name: catalog.queries()[name](spark, "").first().kept for name in ("r01_cluster_bootstrap_full", "r02_row_bootstrap_full", "r06_accuracy_bootstrap_full")}
    assert kept == {"r01_cluster_bootstrap_full": 4000, "r02_row_bootstrap_full": 4000, "r06_accuracy_bootstrap_full": 2000}


def test_platt_scaling_is_the_fit_of_largest_likelihood(spark):
    import numpy as np

    from signalframe.operators import accounting

    rng = np.random.default_rng(3)
    p = rng.uniform(0.02, 0.98, 400)
    y = (rng.uniform(size=400) < p**2).astype(int)
    x = np.stack([np.ones(400), np.log(p / (1 - p))], 1)
    w = np.zeros(2)
    for _ in range(50):  # Newton's steps
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    got = accounting.platt(rows, rows).select("p", "p_cal").toPandas().sort_values("p")
    order = np.argsort(p)
    assert np.allclose(got.p_cal, (1 / (1 + np.exp(-x @ w)))[order], atol=1e-4)


def test_accounts_with_nulls_and_ties(spark):
    from signalframe.operators import accounting

    rows = spark.createDataFrame([(1, "a", 1.0), (1, None, 1.0), (2, "b", None), (2, "b", 3.0)], "k int, label string, v double")
    tests = {"no label": F.col("label").isNull(), "no value": F.col("v").isNull(), "large": F.col("v") > 9}
    assert {r.reason: r.n for r in accounting.drop_reasons(rows, tests).collect()} == {"no label": 1, "no value": 1, "large": 0, "kept": 2}
    assert {r.reason: r.n for r in accounting.drop_reasons(rows.limit(0), tests).collect()} == {"no label": 0, "no value": 0, "large": 0, "kept": 0}
    assert {(r.k, r.seen, r.scorable) for r in accounting.scorable(rows, ["k"], F.col("v") >= 1, 2).collect()} == {(1, 2, True), (2, 1, False)}
    assert {r.name: r.varies for r in accounting.varying(rows.limit(0), ["v"]).collect()} == {"v": False}
    with pytest.raises(Exception, match="differ by"):
        accounting.parity(rows.withColumn("w", F.col("v") + 1), "v", "w").collect()
    with pytest.raises(ValueError, match="no rows"):
        accounting.matched_by_stem(rows, "label", rows.withColumnsRenamed({"label": "other"}).filter("false"), "other", "x")


def test_records_are_checked_and_work_goes_on(spark, tmp_path):
    from signalframe.operators import records

    schema = "id long, y_true int, y_prob array<double>"
    rows = spark.createDataFrame([(1, 0, [0.7, 0.3]), (2, 1, [0.4, 0.6])], schema)
    records.saved(rows, str(tmp_path / "r"), 2)
    back = records.loaded(spark, str(tmp_path / "r"), schema, 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        records.saved(rows, str(tmp_path / "r"), 2)
    for bad, why in (((3, 2, [0.5, 0.5]), "class out of range"), ((3, None, [0.5, 0.5]), "class out of range"), ((3, 0, [1.0]), "number of classes"), ((3, 0, None), "number of classes"), ((3, 0, [0.5, None]), "no number")):
        with pytest.raises(Exception, match=why):
            records.valid(spark.createDataFrame([bad], schema), 2).collect()
    assert [r.id for r in records.remaining(rows, rows.filter("id = 1"), "id").collect()] == [2]
    assert records.remaining(rows, None, "id").count() == 2


def failing(df):
    """Every way to ask for the rows: all columns, each alone, and their number."""
    return [df.collect, df.count, *[df.select(c).collect for c in df.columns]]


def test_checks_stay_whatever_columns_are_asked_for(spark):
    from signalframe.operators import accounting, records

    orders, customers = spark.createDataFrame([(1, "a"), (2, "b")], "k long, o string"), spark.createDataFrame([(1, "m")], "k long, m string")
    left, right = spark.createDataFrame([(1, 5), (2, 6)], "id long, a int"), spark.createDataFrame([(1, 5), (3, 6)], "id long, a int")
    record = "y_true int, y_prob array<double>, z int"
    probabilities = [[(0, [0.5], 1)], [(2, [0.5, 0.5], 1)], [(0, [0.5, float("inf")], 1)], [(None, [0.5, 0.5], 1)]]
    scores = spark.createDataFrame([(0.1, 0.1), (0.2, None)], "a double, b double")
    apart = spark.createDataFrame([(0.1, 0.3)], "a double, b double")
    checked = [audits.complete(orders, customers, "k"), audits.aligned(left, right, "id"), metrics.collapsed(spark.createDataFrame([(3, [0.5, 0.2, 0.1, 0.2])], "y_true int, y_prob array<double>"), [[0, 1], [2]]), accounting.parity(scores, "a", "b"), accounting.parity(apart, "a", "b")]
    checked += [records.valid(spark.createDataFrame(rows, record), 2) for rows in probabilities]
    for df in checked:
        for ask in failing(df):
            with pytest.raises(Exception, match="USER_RAISED|no match|aligned|class|probabilit|differ|alone"):
                ask()
    assert audits.complete(orders.limit(1), customers, "k").select("m").collect()[0].m == "m"
    assert accounting.parity(scores.limit(1), "a", "b").first().n == 1


def test_drift_between_versions_of_scores_fails(spark):
    from signalframe.operators import accounting

    rows = [(i % 2, 0.01 * i, 0.01 * i + (0.001 if i % 3 else 0)) for i in range(50)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    assert accounting.drifted(df, "y", "a", "b", 0.05).first().r > 0.99
    with pytest.raises(Exception, match="drift"):
        accounting.drifted(df.withColumn("b", -F.col("b")), "y", "a", "b").count()


def test_features_of_another_width_or_version_are_refused(spark):
    rows = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], "v2"), (2, [[1.0, 2.0]], "v2")], "id long, features array<array<double>>, version string")
    assert audits.of_schema(rows, "features", 2, "version", "v2").count() == 2
    for bad in (audits.of_schema(rows, "features", 3), audits.of_schema(rows, "features", 2, "version", "v3"), audits.of_schema(rows.withColumn("features", F.lit(None).cast("array<array<double>>")), "features", 2)):
        for ask in failing(bad):
            with pytest.raises(Exception, match="width|version"):
                ask()


def test_matrix_report_of_lost_classes(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (3, 2), (3, 3)], "y_true int, y_pred int")
    r = metrics.matrix_report(metrics.confusion(rows, 4), 4).first()
    assert (r.errors, r.adjacent, r.worst_true, r.worst_pred, r.worst_n, r.zero_recall, r.absent, r.ceiling) == (3, 3, 1, 0, 2, [1], [2], 0.75)
    right = metrics.matrix_report(metrics.confusion(rows.filter("y_true = y_pred"), 4), 4).first()
    assert (right.errors, right.worst_n, right.absent) == (0, None, [1, 2])


def test_codebook_checks(spark):
    book = spark.createDataFrame([("a", "m"), ("a", "m"), ("b", None), ("c", "k")], "title string, marker string")
    used = spark.createDataFrame([("a",), ("d",), ("d",), ("b",)], "title string")
    got = {(r.problem, r.name, r.n) for r in audits.codebook_checks(book, used).collect()}
    assert got == {("duplicate_title", "a", 2), ("duplicate_marker", "m", 2), ("missing", "d", 2), ("orphan", "c", 1)}


def test_blocks_are_padded_to_a_bounded_matrix_and_a_groups_first_begins_in_one_state(spark, monkeypatch):
    rows = [(g, i, float((i * 7 + g) % 10) / 10, (i + g) % 2) for g in range(30) for i in range(3 + 5 * g)]
    df = spark.createDataFrame(rows, "grp long, idx long, p double, y int").coalesce(1)
    want = sorted(gate.replay(df, [0.3, 0.6]).collect())
    assert {len(r.ends) for r in gate._tables(gate._blocks(df, ["grp"]), ["grp"], gate.Automaton("offline", 2, 3, [(True, True)]), [0.3]).collect()} == {1}
    monkeypatch.setattr(gate, "PADDED", 100)  # matrices of few readings
    sizes = np.array([3 + 5 * g for g in range(30)])
    parts = list(gate._slices(sizes, 7))
    assert sorted(np.concatenate(parts)) == list(range(30)) and all(len(x) == 1 or len(x) * sizes[x].max() <= 100 for x in parts)
    monkeypatch.setattr(gate, "BLOCK", 16)  # several blocks a group
    assert sorted(gate.replay(df, [0.3, 0.6]).collect()) == want
