"""Queries over prediction records: metrics, resampling, tests, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hypothesis_tests as tests
from ..operators import metrics, resampling, split_draws, splits
from ..sources import views
from ..sources.views import PRED_BIN, PRED_DOC, PRED_MULTI
from .event_queries import rounded
from .registry import query

CM = f"""{PRED_MULTI}, gr AS (SELECT a.i AS y_true, b.i AS y_pred FROM range(10) a(i), range(10) b(i)),
cm AS (SELECT gr.y_true, gr.y_pred, count(pq.id) AS n FROM gr LEFT JOIN pq ON gr.y_true = pq.y_true AND gr.y_pred = pq.y_pred GROUP BY ALL),
bc AS (SELECT c.i AS class, (SELECT sum(n) FROM cm WHERE y_true = c.i) AS support, (SELECT sum(n) FROM cm WHERE y_pred = c.i) AS predicted, (SELECT sum(n) FROM cm WHERE y_true = c.i AND y_pred = c.i) AS tp FROM range(10) c(i)),
bm AS (SELECT class::INTEGER AS class, support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM bc)"""


def multi(spark, d):
    return metrics.predicted(views.multiclass_predictions(spark, d))


@query("m01_confusion_matrix", f"WITH {CM} SELECT y_true::INTEGER AS y_true, y_pred::INTEGER AS y_pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0), 6) AS row_share, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY y_pred), 0), 0), 6) AS column_share FROM cm")
def m01(spark, d):
    return rounded(metrics.confusion(multi(spark, d), 10), "row_share", "column_share")


@query("m03_per_class", f"WITH {CM} SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM bm")
def m03(spark, d):
    return rounded(metrics.by_class(metrics.confusion(multi(spark, d), 10)), "precision", "recall", "f1")


@query("m04_summary", f"WITH {CM} SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round((sum(tp) / sum(support) - sum(support * predicted) / (sum(support) * sum(support))) / (1 - sum(support * predicted) / (sum(support) * sum(support))), 6) AS kappa FROM bm")
def m04(spark, d):
    return rounded(metrics.summary(metrics.by_class(metrics.confusion(multi(spark, d), 10))), "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "kappa")


def auc_sql(source: str, keys: str, y: str, p: str, weight: str = "1") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""SELECT {k}round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {k}{p} AS score, sum(CASE WHEN {y} = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN {y} = 1 THEN 0 ELSE {weight} END)::DOUBLE AS neg FROM {source} GROUP BY ALL)){f' GROUP BY {keys}' if keys else ''}"""


@query("m05_auc_by_group", f"WITH {PRED_BIN} {auc_sql('pb', 'grp', 'y', 'p')}")
def m05(spark, d):
    return rounded(metrics.auc(views.binary_predictions(spark, d), ["grp"]), "auc")


@query("m06_one_vs_rest_auc", f"WITH {PRED_MULTI}, x AS (SELECT k AS class, CAST(y_true = k AS INTEGER) AS y, y_prob[k + 1] AS p FROM pm, range(10) t(k)), a AS ({auc_sql('x', 'class', 'y', 'p')}) SELECT round(avg(auc), 5) AS macro_auc, count(auc) AS classes FROM a")
def m06(spark, d):
    x = views.multiclass_predictions(spark, d).select("y_true", F.posexplode("y_prob").alias("class", "p")).withColumn("y", (F.col("y_true") == F.col("class")).cast("int"))
    return rounded(metrics.auc(x, ["class"]).agg(F.avg(F.round("auc", 6)).alias("macro_auc"), F.count("auc").alias("classes")), "macro_auc", places=5)


@query("m07_average_precision", f"""WITH {PRED_DOC}, s AS (SELECT grp, pa, sum(y) AS pos, count(*) AS n FROM pd GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY grp ORDER BY pa DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT grp, sum(pos * tp / seen) / nullif(sum(pos), 0) AS ap, sum(pos) / sum(n) AS base_rate FROM c GROUP BY grp) SELECT grp, round(ap, 6) AS ap, round(base_rate, 6) AS base_rate, round(ap / nullif(base_rate, 0), 6) AS lift FROM r""")
def m07(spark, d):
    return rounded(metrics.average_precision(views.document_predictions(spark, d), ["grp"], p="pa"), "ap", "base_rate", "lift")


@query("m09_collapsed_classes", f"WITH {PRED_MULTI}, c AS (SELECT id, CASE WHEN y_true < 3 THEN 0 WHEN y_true < 6 THEN 1 ELSE 2 END AS y_true, [y_prob[1] + y_prob[2] + y_prob[3], y_prob[4] + y_prob[5] + y_prob[6], y_prob[7] + y_prob[8] + y_prob[9] + y_prob[10]] AS q FROM pm) SELECT id, y_true, (list_position(q, list_max(q)) - 1)::INTEGER AS y_pred FROM c")
def m09(spark, d):
    return metrics.collapsed(views.multiclass_predictions(spark, d), [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]).select("id", "y_true", "y_pred")


@query("m08_confused_pairs", f"WITH {CM} SELECT a.y_true::INTEGER AS low, a.y_pred::INTEGER AS high, (a.n + b.n) AS n, a.y_pred - a.y_true = 1 AS adjacent FROM cm a JOIN cm b ON a.y_true = b.y_pred AND a.y_pred = b.y_true WHERE a.y_true < a.y_pred AND a.n + b.n > 0")
def m08(spark, d):
    m = metrics.confusion(multi(spark, d), 10).filter("y_true <> y_pred and n > 0")
    out = m.groupBy(F.least("y_true", "y_pred").alias("low"), F.greatest("y_true", "y_pred").alias("high")).agg(F.sum("n").alias("n"))
    return out.withColumn("adjacent", F.col("high") - F.col("low") == 1)


REL = ", ".join(repr(k * 0.1) for k in range(1, 10))


@query("m12_reliability", f"WITH {PRED_BIN}, b AS (SELECT len(list_filter([{REL}]::DOUBLE[], lambda e: p >= e)) AS bin, p, y FROM pb) SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(abs(avg(p) - avg(y)), 6) AS gap FROM b GROUP BY bin")
def m12(spark, d):
    return rounded(metrics.reliability(views.binary_predictions(spark, d)), "mean_p", "mean_y", "gap")


@query("m12_brier_and_ece", f"WITH {PRED_BIN}, b AS (SELECT len(list_filter([{REL}]::DOUBLE[], lambda e: p >= e)) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap, sum(pow(p - y, 2)) AS s FROM pb GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(sum(s) / sum(n), 6) AS brier FROM b")
def m12b(spark, d):
    pb = views.binary_predictions(spark, d)
    ece = metrics.reliability(pb).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return rounded(ece.crossJoin(F.broadcast(pb.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")))), "ece", "brier")


@query("m16_leave_one_group_out", f"WITH {PRED_DOC}, g AS (SELECT DISTINCT grp AS held FROM pd), x AS (SELECT held, y, pa FROM pd JOIN g ON grp <> held) {auc_sql('x', 'held', 'y', 'pa')}")
def m16(spark, d):
    return rounded(metrics.auc_without_group(views.document_predictions(spark, d), "grp", p="pa"), "auc")


@query("m10_record_metrics", f"""WITH {PRED_BIN}, c AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS positives, avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS agree, count(*) FILTER (p >= 0.5) AS yes, count(*) FILTER (p >= 0.5 AND y = 1) AS tp FROM pb),
k AS (SELECT *, (yes * positives + (n - yes) * (n - positives)) / CAST(n * n AS DOUBLE) AS chance FROM c)
SELECT n, positives, round(agree, 6) AS accuracy, round(greatest(positives, n - positives) / CAST(n AS DOUBLE), 6) AS baseline, round(tp / CAST(nullif(yes, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(positives, 0) AS DOUBLE), 6) AS recall, round((agree - chance) / nullif(1 - chance, 0), 6) AS kappa FROM k""")
def m10(spark, d):
    return rounded(metrics.record_metrics(views.binary_predictions(spark, d)), "accuracy", "baseline", "precision", "recall", "kappa")


@query("m11_metrics_by_fold", f"""WITH {PRED_DOC}, c AS (SELECT fold, count(*) AS n, count(*) FILTER (y = 1) AS positives, avg(CAST((pa >= 0.5) = (y = 1) AS INTEGER)) AS a, avg(CAST((pb >= 0.5) = (y = 1) AS INTEGER)) AS b FROM (SELECT *, id % 5 AS fold FROM pd) GROUP BY fold)
SELECT fold, n, positives, round(a, 6) AS accuracy_a, round(b, 6) AS accuracy_b, round(a - b, 6) AS gain FROM c""")
def m11(spark, d):
    rows = views.document_predictions(spark, d).withColumn("fold", F.col("id") % 5)
    right = lambda p: F.avg(((F.col(p) >= 0.5) == (F.col("y") == 1)).cast("double"))
    out = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("positives"), right("pa").alias("accuracy_a"), right("pb").alias("accuracy_b"))
    return rounded(out.withColumn("gain", F.col("accuracy_a") - F.col("accuracy_b")), "accuracy_a", "accuracy_b", "gain")


@query("a29_auc_bands", f"WITH {PRED_BIN}, a AS ({auc_sql('pb', 'grp', 'y', 'p')}) SELECT count(auc) AS computable, round(avg(auc), 5) AS mean, round(quantile_cont(auc, 0.5), 5) AS median, min(auc) AS lowest, count(*) FILTER (auc < 0.5) AS below_half, count(*) FILTER (auc >= 0.7) AS good FROM a")
def a29(spark, d):
    a = rounded(metrics.auc(views.binary_predictions(spark, d), ["grp"]), "auc")
    return rounded(a.agg(F.count("auc").alias("computable"), F.avg("auc").alias("mean"), F.percentile("auc", F.lit(0.5)).alias("median"), F.min("auc").alias("lowest"), F.count_if(F.col("auc") < 0.5).alias("below_half"), F.count_if(F.col("auc") >= 0.7).alias("good")), "mean", "median", places=5)


#: Repetitions of the queries with SQL, few enough for DuckDB; and the reference's, of those named full and of r07.
REPS = 100
FULL_BOOT, FULL_PERM, FULL_AUC = 2000, 2000, 4000
DRAWS = """gs AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM {src})),
dr AS (SELECT rep, ('0x' || substr(md5('{seed}:' || rep || ':' || slot), 1, 8))::BIGINT % n AS slot FROM gs, range({reps}) t(rep)),
dm AS (SELECT rep, grp, count(*) AS times FROM dr JOIN gs ON dr.slot = gs.slot GROUP BY ALL)"""


@query("r01_cluster_bootstrap", f"WITH {PRED_DOC}, {DRAWS.format(src='pd', seed='r01', reps=REPS)}, x AS (SELECT rep, y, pa, times FROM pd JOIN dm USING (grp)), a AS ({auc_sql('x', 'rep', 'y', 'pa', 'times')}) SELECT round(quantile_cont(auc, 0.025), 5) AS low, round(quantile_cont(auc, 0.975), 5) AS high, count(auc) AS kept FROM a")
def r01(spark, d, reps=REPS):
    a = rounded(resampling.bootstrap_auc(views.document_predictions(spark, d), reps, "r01", ["pa"]), "auc_pa")
    return rounded(resampling.interval(a, "auc_pa"), "low", "high", places=5)


@query("r01_cluster_bootstrap_full")
def r01_full(spark, d):
    return r01(spark, d, FULL_AUC)


@query("r02_row_bootstrap", f"WITH {PRED_DOC}, p2 AS (SELECT id AS grp, y, pa FROM pd), {DRAWS.format(src='p2', seed='r02', reps=20)}, x AS (SELECT rep, y, pa, times FROM p2 JOIN dm USING (grp)), a AS ({auc_sql('x', 'rep', 'y', 'pa', 'times')}) SELECT round(quantile_cont(auc, 0.025), 5) AS low, round(quantile_cont(auc, 0.975), 5) AS high, count(auc) AS kept FROM a")
def r02(spark, d, reps=20):
    rows = views.document_predictions(spark, d).withColumn("grp", F.col("id"))
    return rounded(resampling.interval(rounded(resampling.bootstrap_auc(rows, reps, "r02", ["pa"]), "auc_pa"), "auc_pa"), "low", "high", places=5)


@query("r02_row_bootstrap_full")
def r02_full(spark, d):
    """At the reference's repetitions, with draws split over ranges of scores instead of repeated rows."""
    a = split_draws.bootstrap_auc_rows(views.document_predictions(spark, d), FULL_AUC, "r02", p="pa")
    return rounded(resampling.interval(rounded(a, "auc"), "auc"), "low", "high", places=5)


@query("r05_paired_bootstrap", f"WITH {PRED_DOC}, {DRAWS.format(src='pd', seed='r05', reps=REPS)}, x AS (SELECT rep, y, pa, pb, times FROM pd JOIN dm USING (grp)), a AS ({auc_sql('x', 'rep', 'y', 'pa', 'times')}), b AS ({auc_sql('x', 'rep', 'y', 'pb', 'times')}) SELECT round(quantile_cont(a.auc - b.auc, 0.025), 4) AS low, round(quantile_cont(a.auc - b.auc, 0.975), 4) AS high, round(avg(CAST(a.auc > b.auc AS INTEGER)), 6) AS share_above FROM a JOIN b USING (rep)")
def r05(spark, d, reps=REPS):
    a = rounded(resampling.bootstrap_auc(views.document_predictions(spark, d), reps, "r05", ["pa", "pb"]), "auc_pa", "auc_pb").withColumn("diff", F.col("auc_pa") - F.col("auc_pb"))
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    out = a.agg(q.alias("q"), F.avg((F.col("auc_pa") > F.col("auc_pb")).cast("int")).alias("share_above"))
    return rounded(rounded(out.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "share_above"), "low", "high", places=4), "share_above")


@query("r05_paired_bootstrap_full")
def r05_full(spark, d):
    return r05(spark, d, FULL_AUC)


@query("r06_accuracy_bootstrap", f"WITH {PRED_BIN}, pg AS (SELECT grp, count(*) FILTER ((p >= 0.5) = (y = 1)) AS hit, count(*) AS c FROM pb GROUP BY grp), {DRAWS.format(src='pg', seed='r06', reps=REPS)}, r AS (SELECT rep, round(sum(hit * times) / sum(c * times), 6) AS ratio FROM pg JOIN dm USING (grp) GROUP BY rep) SELECT round(quantile_cont(ratio, 0.025), 5) AS low, round(quantile_cont(ratio, 0.975), 5) AS high, count(ratio) AS kept FROM r")
def r06(spark, d, reps=REPS):
    g = views.binary_predictions(spark, d).groupBy("grp").agg(F.count_if((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("hit"), F.count(F.lit(1)).alias("c"))
    return rounded(resampling.interval(rounded(resampling.bootstrap_ratio(g, "hit", "c", reps, "r06"), "ratio"), "ratio"), "low", "high", places=5)


@query("r06_accuracy_bootstrap_full")
def r06_full(spark, d):
    return r06(spark, d, FULL_BOOT)


@query("r07_gated_precision_bootstrap")
def r07(spark, d):
    """Per-group offers and hits are counted once and summed by multiplicity: a gate starts anew in each group."""
    from ..operators import gate

    g = gate.replay(views.binary_predictions(spark, d), [0.6]).select("grp", "offers", "correct")
    return rounded(resampling.interval(resampling.bootstrap_ratio(g, "correct", "offers", FULL_BOOT, "r07"), "ratio"), "low", "high")


@query("r04_within_group_permutation", f"""WITH {PRED_BIN}, s AS (SELECT p, count(*) AS c FROM pb GROUP BY p), rk AS (SELECT p, coalesce(sum(c) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / CAST(2 AS DOUBLE) AS rank FROM s),
f AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY id) AS k, rank, y FROM pb JOIN rk USING (p)), h AS (SELECT rep, grp, y, row_number() OVER (PARTITION BY rep, grp ORDER BY ('0x' || substr(md5('r04:' || rep || ':' || id), 1, 8))::BIGINT, id) AS k FROM pb, range(20) t(rep)),
z AS (SELECT rep, sum(rank) AS v FROM h JOIN f ON h.grp = f.grp AND h.k = f.k WHERE h.y = 1 GROUP BY rep), o AS (SELECT sum(rank) AS obs FROM f WHERE y = 1)
SELECT count(*) FILTER (v >= obs) AS hits, round((count(*) FILTER (v >= obs) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_value FROM z, o""")
def r04(spark, d, reps=20):
    return rounded(resampling.permutation_p(views.binary_predictions(spark, d), reps, "r04"), "p_value")


@query("r04_within_group_permutation_full")
def r04_full(spark, d):
    """At the reference's repetitions, with positives split over blocks instead of repeated rows."""
    return rounded(split_draws.permutation_p(views.binary_predictions(spark, d), FULL_PERM, "r04"), "p_value")


@query("r10_benjamini_hochberg", f"WITH {PRED_DOC}, t AS (SELECT grp AS name, round((abs(hash_) % 1000 + 1) / CAST(1001 AS DOUBLE), 6) AS p FROM (SELECT grp, count(*) * 37 + sum(y) * 11 AS hash_ FROM pd GROUP BY grp)), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM t) SELECT name, p, rank::INTEGER AS rank, round(least(1, min(p * m / rank) OVER (ORDER BY p DESC, name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r")
def r10(spark, d):
    t = views.document_predictions(spark, d).groupBy(F.col("grp").alias("name")).agg((F.count(F.lit(1)) * 37 + F.sum("y") * 11).alias("h"))
    return rounded(metrics.benjamini_hochberg(t.select("name", F.round((F.col("h") % 1000 + 1) / 1001.0, 6).alias("p"))), "q")


@query("t01_mcnemar", f"WITH {PRED_DOC}, c AS (SELECT (pa >= 0.5) = (y = 1) AS a, (pb >= 0.5) = (y = 1) AS b FROM pd) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM c")
def t01(spark, d):
    right = lambda p: (F.col(p) >= 0.5) == (F.col("y") == 1)
    return tests.mcnemar(views.document_predictions(spark, d).select(right("pa").alias("a"), right("pb").alias("b")), "a", "b")


PRE_POST = "pp AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1998-04-25') AS pre, avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-04-25') AS post FROM orders GROUP BY 1), pr AS (SELECT round(pre, 4) AS pre, round(post, 4) AS post FROM pp WHERE pre IS NOT NULL AND post IS NOT NULL)"


@query("t05_paired_outcome", f"WITH {PRE_POST}, d AS (SELECT post - pre AS d FROM pr), s AS (SELECT abs(d) AS m, count(*) AS c, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1), r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / CAST(2 AS DOUBLE) AS rank FROM s) SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(d) FROM d), 3) AS mean, round((SELECT avg(d) / stddev_samp(d) FROM d), 6) AS d_z, round((SELECT avg(d) * sqrt(count(*)) / stddev_samp(d) FROM d), 6) AS t, sum(rank * up) AS w_plus, sum(rank * (c - up)) AS w_minus FROM r")
def t05(spark, d):
    cut = F.lit("1998-04-25").cast("timestamp_ntz")
    o = views.table(spark, d, "orders")
    pp = o.groupBy("o_custkey").agg(F.round(F.avg(F.when(F.col("o_orderdate") < cut, F.col("o_totalprice"))), 4).alias("pre"), F.round(F.avg(F.when(F.col("o_orderdate") >= cut, F.col("o_totalprice"))), 4).alias("post")).dropna()
    return rounded(rounded(tests.paired(pp, "pre", "post"), "d_z", "t"), "mean", places=3)


@query("t06_independent_outcome", """WITH r AS (SELECT c_mktsegment = 'BUILDING' AS one, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), b AS (SELECT v, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b FROM r GROUP BY v),
u AS (SELECT sum(a * (less + b / CAST(2 AS DOUBLE))) AS u FROM (SELECT *, coalesce(sum(b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM b)),
m AS (SELECT count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, avg(v) FILTER (one) AS m1, avg(v) FILTER (NOT one) AS m2, var_samp(v) FILTER (one) AS v1, var_samp(v) FILTER (NOT one) AS v2 FROM r)
SELECT n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df,
round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3 / CAST(4 * (n1 + n2) - 9 AS DOUBLE)), 6) AS hedges_g, u, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial FROM m, u""")
def t06(spark, d):
    out = tests.independent(views.table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return rounded(rounded(out, "t", "hedges_g", "rank_biserial"), "df", places=4)


@query("a11_modal_labels", f"WITH {PRED_MULTI}, n AS (SELECT grp, y_true, count(*) AS n, min(id) AS f FROM pm GROUP BY ALL) SELECT grp, y_true AS label FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) = 1")
def a11(spark, d):
    return splits.modal_labels(views.multiclass_predictions(spark, d).withColumnRenamed("y_true", "y"))


@query("l01_group_split", f"WITH {PRED_BIN}, g AS (SELECT grp, row_number() OVER (ORDER BY md5('l01:' || grp), grp) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM pb)) SELECT grp, CASE WHEN rn <= greatest(1, round_even(n * 0.7, 0)) THEN 'train' WHEN rn <= greatest(1, round_even(n * 0.7, 0)) + greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'test' END AS split FROM g")
def l01(spark, d):
    return splits.group_split(views.binary_predictions(spark, d).select("grp"), "l01")


USERS = f"{PRED_BIN}, lab AS (SELECT grp, CASE WHEN avg(y) < 0.15 THEN 0 WHEN avg(y) < 0.25 THEN 1 ELSE 2 END AS label FROM pb GROUP BY grp)"


def user_labels(spark, d):
    m = F.avg("y")
    return views.binary_predictions(spark, d).groupBy("grp").agg(F.when(m < 0.15, 0).when(m < 0.25, 1).otherwise(2).alias("label"))


@query("l02_stratified_split", f"""WITH {USERS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('l02:' || grp), grp) AS rn, count(*) OVER (PARTITION BY label) AS n FROM lab), c AS (SELECT *, greatest(1, round_even(n * 0.15, 0)) AS t, greatest(1, round_even(n * 0.15, 0)) AS v FROM r)
SELECT grp, label, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN rn = 1 THEN 'test' ELSE 'train' END WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS split FROM c""")
def l02(spark, d):
    return splits.stratified_split(user_labels(spark, d), "l02")


@query("l04_stratified_folds", f"WITH {USERS} SELECT grp, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('l04:' || grp), grp) - 1) % 5)::INTEGER AS fold FROM lab")
def l04(spark, d):
    return splits.stratified_folds(user_labels(spark, d), 5, "l04")


@query("l07_balanced_folds", f"""WITH RECURSIVE {PRED_BIN}, o AS (SELECT grp, count(*) AS n FROM pb GROUP BY grp), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp) AS k FROM o),
z AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS grp, CAST(0 AS BIGINT) AS n, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load UNION ALL
  SELECT k, grp, n, fold, list_transform(load, lambda v, i: CASE WHEN i = fold + 1 THEN v + n ELSE v END) FROM (SELECT r.k, r.grp, r.n, list_position(z.load, list_min(z.load)) - 1 AS fold, z.load FROM z JOIN r ON r.k = z.k + 1))
SELECT grp, n, fold FROM z WHERE k > 0""")
def l07(spark, d):
    return splits.balanced_folds(views.binary_predictions(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n")), 5)


@query("l03_missing_classes", f"WITH {USERS}, f AS (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY md5('l03:' || grp), grp) - 1) % 40) AS fold FROM lab) SELECT a.fold::INTEGER AS fold, b.label FROM (SELECT DISTINCT fold FROM f) a CROSS JOIN (SELECT DISTINCT label FROM f) b ANTI JOIN f ON f.fold = a.fold AND f.label = b.label")
def l03(spark, d):
    f = splits.stratified_folds(user_labels(spark, d), 40, "l03")
    labels = f.select("label").distinct()
    return f.select("fold").distinct().join(labels, how="cross").join(f, ["fold", "label"], "left_anti")


@query("l11_weighted_draws", f"WITH {PRED_BIN}, c AS (SELECT y, count(*) AS n FROM pb GROUP BY y), w AS (SELECT grp, id, 1 / sqrt(n) AS w FROM pb JOIN c USING (y)) SELECT id, round(sum(w) OVER (PARTITION BY grp ORDER BY id) / sum(w) OVER (PARTITION BY grp), 8) AS upto FROM w")
def l11(spark, d):
    """Where each row's share of its group's weight ends: a draw from 0 to 1 takes the first row that reaches it."""
    pb = views.binary_predictions(spark, d)
    w = pb.join(pb.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y").withColumn("w", 1 / F.sqrt("n"))
    own = Window.partitionBy("grp")
    return rounded(w.select("id", (F.sum("w").over(own.orderBy("id")) / F.sum("w").over(own)).alias("upto")), "upto", places=8)


@query("a30_correlation", f"WITH {PRED_DOC} SELECT round(corr(pa, pb), 6) AS r, round(max(abs(pa - pb)), 6) AS furthest, round(avg(abs(pa - pb)), 6) AS mean_gap FROM pd")
def a30(spark, d):
    g = F.abs(F.col("pa") - F.col("pb"))
    return rounded(views.document_predictions(spark, d).agg(F.corr("pa", "pb").alias("r"), F.max(g).alias("furthest"), F.avg(g).alias("mean_gap")), "r", "furthest", "mean_gap")


@query("a27_score_spread", f"WITH {PRED_BIN} SELECT round(min(p), 6) AS low, round(max(p), 6) AS high, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS sd, round(avg(CAST(p >= 0.5 AS INTEGER)), 6) AS share, round(quantile_cont(p, 0.8), 6) AS q80, round(quantile_cont(p, 0.9), 6) AS q90, round(quantile_cont(p, 0.95), 6) AS q95 FROM pb")
def a27(spark, d):
    q = F.percentile("p", F.array(F.lit(0.8), F.lit(0.9), F.lit(0.95)))
    out = views.binary_predictions(spark, d).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("sd"), F.avg((F.col("p") >= 0.5).cast("int")).alias("share"), q.alias("q"))
    return rounded(out.select("low", "high", "mean", "sd", "share", F.col("q")[0].alias("q80"), F.col("q")[1].alias("q90"), F.col("q")[2].alias("q95")), "low", "high", "mean", "sd", "share", "q80", "q90", "q95")


@query("a28_positives_by_group", f"WITH {PRED_DOC}, g AS (SELECT grp, sum(y)::BIGINT AS positives FROM pd GROUP BY grp) SELECT grp, positives, round(positives / sum(positives) OVER (), 6) AS share, row_number() OVER (ORDER BY positives DESC, grp) = 1 AS largest FROM g")
def a28(spark, d):
    g = views.document_predictions(spark, d).groupBy("grp").agg(F.sum("y").alias("positives"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rounded(g.select("grp", "positives", (F.col("positives") / F.sum("positives").over(every)).alias("share"), (F.row_number().over(Window.orderBy(F.desc("positives"), "grp")) == 1).alias("largest")), "share")


@query("p13_polarity_flip", f"WITH {PRED_DOC}, m AS (SELECT avg(y) > 0.5 AS flip FROM pd) SELECT id, CASE WHEN flip THEN 1 - y ELSE y END AS y, round(CASE WHEN flip THEN 1 - pa ELSE pa END, 6) AS p FROM pd, m")
def p13(spark, d):
    pd_ = views.document_predictions(spark, d)
    flip = pd_.agg((F.avg("y") > 0.5).alias("flip"))
    return rounded(pd_.crossJoin(F.broadcast(flip)).select("id", F.when(F.col("flip"), 1 - F.col("y")).otherwise(F.col("y")).alias("y"), F.when(F.col("flip"), 1 - F.col("pa")).otherwise(F.col("pa")).alias("p")), "p")
