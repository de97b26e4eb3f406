"""Queries over accounts, agreement, caps, paired bootstraps and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting, gate, records, resampling
from ..sources import views
from ..sources.views import PRED_BIN, PRED_MULTI
from .event_queries import FLOORS, g01, offline_sql, rounded
from .prediction_queries import DRAWS, FULL_BOOT, REPS, USERS, m11, multi, r01, r02, user_labels
from .registry import SQL, query

REASON = "CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN quality IS NULL THEN 'unlabelled' WHEN n_chars < 200 THEN 'short' ELSE 'kept' END"


def _labelled(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "source", "n_chars", (F.trim("text") == "").alias("blank"))
    return docs.join(views.table(spark, d, "labels"), "doc_id", "left")


def _tests():
    return {"empty": F.col("blank").isNull() | F.col("blank"), "unlabelled": F.col("quality").isNull(), "short": F.col("n_chars") < 200}


@query("a14_drop_reasons", f"WITH r AS (SELECT {REASON} AS reason FROM documents LEFT JOIN labels USING (doc_id)) SELECT k AS reason, count(reason) AS n FROM unnest(['empty', 'unlabelled', 'short', 'kept']) t(k) LEFT JOIN r ON reason = k GROUP BY k")
def a14(spark, d):
    return accounting.drop_reasons(_labelled(spark, d), _tests())


@query("a21_split_accounting", f"""WITH r AS (SELECT source, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, {REASON} AS why FROM documents LEFT JOIN labels USING (doc_id))
SELECT split, count(*) AS n, count(*) FILTER (why = 'kept') AS scored, count(*) FILTER (why <> 'kept') AS dropped, count(DISTINCT source) AS subjects, count(DISTINCT source) FILTER (why = 'kept') AS scored_subjects FROM r GROUP BY split""")
def a21(spark, d):
    k = F.pmod("doc_id", F.lit(10))
    rows = _labelled(spark, d).withColumn("split", F.when(k == 0, "test").when(k == 1, "val").otherwise("train"))
    return accounting.by_split(rows, "split", "source", accounting.reason(_tests()))


@query("a15_agreement", f"WITH {PRED_MULTI} SELECT y_true AS designed, sum(CASE WHEN y_true = y_pred THEN 1 + id % 3 ELSE 0 END)::BIGINT AS agreed, sum(1 + id % 3)::BIGINT AS checked, round(sum(CASE WHEN y_true = y_pred THEN 1 + id % 3 ELSE 0 END) / sum(1 + id % 3), 6) AS share FROM pq WHERE y_pred <> 9 GROUP BY y_true")
def a15(spark, d):
    """Windows of an item weigh by their number; class 9 reports nothing."""
    rows = multi(spark, d).select("y_true", F.when(F.col("y_pred") != 9, F.col("y_pred")).alias("reported"), (1 + F.pmod("id", F.lit(3))).alias("windows"))
    return rounded(accounting.agreement(rows, "y_true", "reported", "windows"), "share")


@query("a13_label_histogram", "WITH g AS (SELECT user_id, count(DISTINCT event_type) AS labels FROM events GROUP BY user_id) SELECT labels, count(*) AS groups FROM g GROUP BY labels")
def a13(spark, d):
    return accounting.counts_of_counts(views.table(spark, d, "events"), "user_id", "event_type")


@query("a22_capped_counts", "WITH g AS (SELECT user_id, count(*) AS own FROM events GROUP BY user_id) SELECT own, least(own, 27) AS expected, count(*) AS groups FROM g GROUP BY own")
def a22(spark, d):
    """How many participants have so many readings, beside the number that a cap of 27 would leave."""
    own = views.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("own"))
    return own.groupBy("own").agg(F.count(F.lit(1)).alias("groups")).withColumn("expected", F.least("own", F.lit(27)))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "unchanging"]


@query("a32_varying_columns", " UNION ALL ".join(f"SELECT '{c}' AS name, coalesce(stddev_pop({'1' if c == 'unchanging' else c}) > 1e-9, false) AS varies FROM lineitem" for c in NUMBERS))
def a32(spark, d):
    return accounting.varying(views.table(spark, d, "lineitem").withColumn("unchanging", F.lit(1)), NUMBERS)


@query("j09_stem_join", "SELECT replace(s_name, 'Supplier#', '') AS stem, s_suppkey, c_custkey FROM supplier JOIN customer ON replace(s_name, 'Supplier#', '') = replace(c_name, 'Customer#', '')")
def j09(spark, d):
    out = accounting.matched_by_stem(views.table(spark, d, "supplier"), "s_name", views.table(spark, d, "customer"), "c_name", "^[A-Za-z]+#")
    return out.select("stem", "s_suppkey", "c_custkey")


@query("o07_capped_groups", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def o07(spark, d):
    parts = views.table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return accounting.capped(parts, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3).drop("rank")


@query("p16_low_membership", "SELECT CAST(o_orderpriority IN ('5-LOW', '3-MEDIUM') AS INTEGER) AS low, count(*) AS n FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1")
def p16(spark, d):
    rows = accounting.members(views.table(spark, d, "orders"), "o_orderpriority", ["5-LOW", "3-MEDIUM"], "4-NOT SPECIFIED")
    return rows.groupBy("low").agg(F.count(F.lit(1)).alias("n"))


@query("p17_scorable_clips", f"WITH {PRED_BIN} SELECT grp, idx // 10 AS clip, count(*) AS n, count(*) FILTER (p >= 0.4) AS seen, count(*) FILTER (p >= 0.4) >= 5 AS scorable FROM pb GROUP BY ALL")
def p17(spark, d):
    """Clips of ten readings; a reading counts as present from 0.4 on."""
    rows = views.binary_predictions(spark, d).withColumn("clip", F.floor(F.col("idx") / 10))
    return accounting.scorable(rows, ["grp", "clip"], F.col("p") >= 0.4)


@query("d09_score_parity", f"WITH {PRED_BIN} SELECT count(*) AS n, round(max(abs(p - round(p, 4))), 6) AS furthest, round(corr(p, round(p, 4)), 6) AS r FROM pb")
def d09(spark, d):
    """Scores beside the same scores kept to four places."""
    rows = views.binary_predictions(spark, d).withColumn("kept", F.round("p", 4))
    return rounded(accounting.parity(rows, "p", "kept"), "furthest", "r")


FLOOR_A, FLOOR_B = 0.55, 0.6
CONFIGS = f""", pg AS (SELECT grp, count(*) FILTER (fire AND floor = {FLOOR_A}) AS na, coalesce(sum(hit) FILTER (floor = {FLOOR_A}), 0) AS ha, count(*) FILTER (fire AND floor = {FLOOR_B}) AS nb, coalesce(sum(hit) FILTER (floor = {FLOOR_B}), 0) AS hb FROM g GROUP BY grp), {DRAWS.format(src='pg', seed='r08', reps=REPS)},
r AS (SELECT sum(hb * times) / nullif(sum(nb * times), 0) - sum(ha * times) / nullif(sum(na * times), 0) AS diff FROM pg JOIN dm USING (grp) GROUP BY rep), q AS (SELECT round(diff, 6) AS diff FROM r)
SELECT round(quantile_cont(diff, 0.025), 5) AS low, round(quantile_cont(diff, 0.975), 5) AS high, count(diff) AS kept FROM q"""


@query("r08_gate_config_bootstrap", offline_sql("true", [FLOOR_A, FLOOR_B], CONFIGS))
def r08(spark, d, reps=REPS):
    """Interval of the difference in precision of two floors of the gate, with the same draws of groups for both."""
    at = lambda c, f: F.coalesce(F.sum(F.when(F.col("floor") == f, c)), F.lit(0))
    offers = F.col("offers")
    g = gate.replay(views.binary_predictions(spark, d), [FLOOR_A, FLOOR_B]).groupBy("grp")
    g = g.agg(at(offers, FLOOR_A).alias("na"), at(F.col("correct"), FLOOR_A).alias("ha"), at(offers, FLOOR_B).alias("nb"), at(F.col("correct"), FLOOR_B).alias("hb"))
    out = rounded(resampling.bootstrap_ratio_difference(g, ("ha", "na"), ("hb", "nb"), reps, "r08"), "diff")
    return rounded(resampling.interval(out, "diff"), "low", "high", places=5)


@query("r08_gate_config_bootstrap_full")
def r08_full(spark, d):
    return r08(spark, d, FULL_BOOT)


@query("r09_mean_bootstrap", f"WITH pg AS (SELECT o_custkey AS grp, round(avg(o_totalprice) FILTER (o_orderpriority < '3') - avg(o_totalprice) FILTER (o_orderpriority >= '3'), 4) AS d FROM orders GROUP BY 1), ps AS (SELECT * FROM pg WHERE d IS NOT NULL), {DRAWS.format(src='ps', seed='r09', reps=REPS)}, r AS (SELECT round(sum(d * times) / sum(times), 2) AS mean FROM ps JOIN dm USING (grp) GROUP BY rep) SELECT round(quantile_cont(mean, 0.025), 1) AS low, round(quantile_cont(mean, 0.975), 1) AS high, count(mean) AS kept FROM r")
def r09(spark, d):
    """Interval of a mean paired difference: whole customers are drawn, so both sides stay together."""
    urgent = F.col("o_orderpriority") < "3"
    g = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.round(F.avg(F.when(urgent, F.col("o_totalprice"))) - F.avg(F.when(~urgent, F.col("o_totalprice"))), 4).alias("d"))
    means = resampling.bootstrap_ratio(g.dropna().withColumn("one", F.lit(1)), "d", "one", REPS, "r09")
    return rounded(resampling.interval(rounded(means, "ratio", places=2), "ratio"), "low", "high", places=1)


@query("m13_platt_scaling")
def m13(spark, d):
    """Scores calibrated by groups that aren't scored: seven of ten groups fit, the others are returned."""
    rows = views.binary_predictions(spark, d)
    fits = F.pmod("grp", F.lit(10)) < 7
    return rounded(accounting.platt(rows.filter(fits), rows.filter(~fits)).select("id", "y", "p", "p_cal"), "p_cal", places=4)


@query("d01_valid_record", f"WITH {PRED_MULTI} SELECT y_true, count(*) AS n FROM pm GROUP BY y_true")
def d01(spark, d):
    """Rows a class of a record that is checked on the way."""
    return records.valid(views.multiclass_predictions(spark, d), 10).groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))


@query("l08_out_of_fold", f"""WITH {USERS}, f AS (SELECT grp, (row_number() OVER (PARTITION BY label ORDER BY md5('l08:' || grp), grp) - 1) % 5 AS fold FROM lab), x AS (SELECT pb.*, fold FROM pb JOIN f USING (grp)),
t AS (SELECT fold, sum(y) AS s, count(*) AS n FROM x GROUP BY fold), a AS (SELECT sum(y) AS s, count(*) AS n FROM x) SELECT id, x.fold::INTEGER AS fold, round((a.s - t.s) / (a.n - t.n), 6) AS p_oof FROM x JOIN t USING (fold), a""")
def l08(spark, d):
    """The harness with the plainest of models: the share of positives among the rows of the other folds."""
    base = lambda train, test: test.crossJoin(F.broadcast(train.agg(F.avg("y").alias("p_oof")))).select("id", "fold", "p_oof")
    return rounded(records.out_of_fold(views.binary_predictions(spark, d), user_labels(spark, d), 5, "l08", base), "p_oof")


@query("a35_run_spread", f"WITH m AS ({SQL['m11_metrics_by_fold']}) SELECT 'accuracy_a' AS score, round(avg(accuracy_a), 5) AS mean, round(stddev_samp(accuracy_a), 5) AS sd, min(accuracy_a) AS low, max(accuracy_a) AS high FROM m UNION ALL SELECT 'accuracy_b', round(avg(accuracy_b), 5), round(stddev_samp(accuracy_b), 5), min(accuracy_b), max(accuracy_b) FROM m")
def a35(spark, d):
    return rounded(records.spread(m11(spark, d), "accuracy_a", "accuracy_b"), "mean", "sd", places=5)


@query("a24_noise_floor", f"WITH m AS ({SQL['m11_metrics_by_fold']}) SELECT round(stddev_samp(accuracy_a) + stddev_samp(accuracy_b), 5) AS noise_floor FROM m")
def a24(spark, d):
    """Twice the mean of the scores' standard deviations."""
    return rounded(records.spread(m11(spark, d), "accuracy_a", "accuracy_b").agg((2 * F.avg("sd")).alias("noise_floor")), "noise_floor", places=5)


@query("r03_width_ratio", f"SELECT round((a.high - a.low) / nullif(b.high - b.low, 0), 3) AS ratio FROM ({SQL['r01_cluster_bootstrap']}) a, ({SQL['r02_row_bootstrap']}) b")
def r03(spark, d):
    """How much wider the interval is when whole clusters are drawn instead of rows."""
    width = lambda df, name: df.select((F.col("high") - F.col("low")).alias(name))
    both = width(r01(spark, d), "a").crossJoin(F.broadcast(width(r02(spark, d), "b")))  # one row each
    return rounded(both.select(F.try_divide("a", "b").alias("ratio")), "ratio", places=3)


UNGATED = """, s AS (SELECT floor, count(*) FILTER (fire) AS offers, sum(hit)::BIGINT AS correct, count(*) AS readings FROM g WHERE idx >= 0 GROUP BY floor UNION ALL SELECT NULL, count(*), sum(y)::BIGINT, count(*) FROM pb), b AS (SELECT avg(y) AS base FROM pb)
SELECT floor, offers, correct, readings, round(correct / nullif(offers, 0), 6) AS precision, round(correct / nullif(offers, 0) / base, 6) AS lift, round(offers / readings, 6) AS rate FROM s, b"""


@query("g06_sweep_with_ungated", offline_sql("true", FLOORS, UNGATED))
def g06(spark, d):
    """Every floor, and without a floor the row in which each reading is an offer; lift is over that row's precision."""
    rows = views.binary_predictions(spark, d)
    every = rows.agg(F.lit(None).cast("double").alias("floor"), F.count(F.lit(1)).alias("offers"), F.sum("y").alias("correct"), F.count(F.lit(1)).alias("readings"))
    out = gate.swept(gate.replay(rows, FLOORS)).select("floor", "offers", "correct", "readings").unionByName(every)
    out = out.crossJoin(F.broadcast(every.select((F.col("correct") / F.col("readings")).alias("base")))).withColumn("precision", F.try_divide("correct", "offers"))
    out = out.select("floor", "offers", "correct", "readings", "precision", F.try_divide("precision", "base").alias("lift"), (F.col("offers") / F.col("readings")).alias("rate"))
    return rounded(out, "precision", "lift", "rate")


@query("f23_offer_rates", f"WITH o AS ({SQL['g01_offline_gate_sweep']}) SELECT floor, round(readings * 30 / 3600, 6) AS hours, round(offers / (readings * 30 / 3600), 6) AS per_hour, round(readings * 30 / 60 / nullif(offers, 0), 6) AS minutes_between FROM o")
def f23(spark, d):
    """Rates of a gate's offers, where a reading stands for 30 seconds."""
    hours = F.col("readings") * 30 / 3600
    out = g01(spark, d).select("floor", hours.alias("hours"), F.try_divide(F.col("offers"), hours).alias("per_hour"), F.try_divide(hours * 60, F.col("offers")).alias("minutes_between"))
    return rounded(out, "hours", "per_hour", "minutes_between")
