"""Queries over tests with their p-values and intervals, families of tests, and the whole metric blocks of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypothesis_tests as tests
from ..operators import audits, metrics, resampling
from ..sources import views
from ..sources.views import PRED_DOC, PRED_MULTI
from .event_queries import rounded
from .prediction_queries import CM, DRAWS, FULL_PERM, PRE_POST, REPS, auc_sql, multi
from .registry import query

#: Intervals of Simpson's rule, by which SQL integrates the densities of t and of the normal distribution.
PARTS = 2000
_WEIGHTS = f"CASE WHEN i IN (0, {PARTS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def t_sql(t: str, df: str) -> str:
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    return f"(1 - 2 * abs({t}) / {PARTS} / 3 * {density} * list_sum(list_transform(range(0, {PARTS + 1}), lambda i: ({_WEIGHTS}) * pow(1 + pow(abs({t}) * i / {PARTS}, 2) / {df}, -({df} + 1) / 2))))"


def normal_sql(z: str) -> str:
    return f"(1 - 2 * abs({z}) / {PARTS} / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, {PARTS + 1}), lambda i: ({_WEIGHTS}) * exp(-pow(abs({z}) * i / {PARTS}, 2) / 2))))"


def quantile_sql(source: str, df: str) -> str:
    """The t beyond which 5 % lie, by halving, as table tq(q)."""
    mid = "(lo + hi) / 2"
    return f"bi AS (SELECT 0 AS k, 0::DOUBLE AS lo, 20::DOUBLE AS hi, {df} AS df FROM {source} UNION ALL SELECT k + 1, CASE WHEN p > 0.05 THEN {mid} ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE {mid} END, df FROM (SELECT *, {t_sql(mid, 'df')} AS p FROM bi WHERE k < 48)), tq AS (SELECT (lo + hi) / 2 AS q FROM bi WHERE k = 48)"


@query("t01_mcnemar_test", f"""WITH {PRED_DOC}, c AS (SELECT (pa >= 0.5) = (y = 1) AS a, (pb >= 0.5) = (y = 1) AS b FROM pd), k AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS bo, count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM c), s AS (SELECT *, x + y AS d, pow(abs(x - y) - 1, 2) / (x + y) AS chi FROM k)
SELECT n, bo AS both, x AS only_a, y AS only_b, n - bo - d AS neither, d AS discordant, d < 25 AS exact, round(CASE WHEN d < 25 THEN least(x, y) ELSE chi END, 6) AS statistic,
round(CASE WHEN d = 0 THEN 1 WHEN d < 25 THEN least(1, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1)) / pow(2, d)))) ELSE {normal_sql('sqrt(chi)')} END, 6) AS p, round(CASE WHEN x > 0 THEN y / x WHEN y > 0 THEN 'inf'::DOUBLE END, 6) AS odds_ratio, round((bo + x) / n, 6) AS accuracy_a, round((bo + y) / n, 6) AS accuracy_b FROM s""")
def t01(spark, d):
    right = lambda p: (F.col(p) >= 0.5) == (F.col("y") == 1)
    out = tests.mcnemar_test(views.document_predictions(spark, d).select(right("pa").alias("a"), right("pb").alias("b")), "a", "b")
    return rounded(out, "statistic", "p", "odds_ratio", "accuracy_a", "accuracy_b")


@query("t05_paired_test", f"""WITH RECURSIVE {PRE_POST}, d AS (SELECT post - pre AS d FROM pr), s AS (SELECT abs(d) AS m, count(*) AS c, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1), r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / CAST(2 AS DOUBLE) AS rank FROM s),
w AS (SELECT sum(rank * up) AS plus, sum(rank * (c - up)) AS minus, sum(c)::DOUBLE AS k, sum(pow(c, 3) - c) AS ties FROM r), z AS (SELECT *, (least(plus, minus) - k * (k + 1) / 4) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48) AS z FROM w),
m AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d), t AS (SELECT *, mean / sd * sqrt(n) AS t, (n - 1)::DOUBLE AS df FROM m), {quantile_sql('t', 'df')}
SELECT n, round(mean, 3) AS mean, round(mean / sd, 6) AS d_z, round(t, 6) AS t, df::BIGINT AS df, round({t_sql('t', 'df')}, 6) AS p_t, round(mean - q * sd / sqrt(n), 2) AS low, round(mean + q * sd / sqrt(n), 2) AS high, plus AS w_plus, minus AS w_minus, round({normal_sql('z')}, 6) AS p_wilcoxon FROM t, tq, z""")
def t05(spark, d):
    """Orders before and after a date of the same customers: t and signed ranks with p, and the interval of the mean difference."""
    cut = F.lit("1998-04-25").cast("timestamp_ntz")
    pp = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg(F.when(F.col("o_orderdate") < cut, F.col("o_totalprice"))), 4).alias("pre"), F.round(F.avg(F.when(F.col("o_orderdate") >= cut, F.col("o_totalprice"))), 4).alias("post")).dropna()
    out = tests.paired_test(pp, "pre", "post").select("n", "mean", "d_z", "t", "df", "p_t", "low", "high", "w_plus", "w_minus", "p_wilcoxon")
    return rounded(rounded(rounded(out, "d_z", "t", "p_t", "p_wilcoxon"), "low", "high", places=2), "mean", places=3)


@query("t06_independent_test", f"""WITH RECURSIVE r AS (SELECT c_mktsegment = 'BUILDING' AS one, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), b AS (SELECT v, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b FROM r GROUP BY v),
u AS (SELECT sum(a * (less + b / CAST(2 AS DOUBLE))) AS u, sum(pow(a + b, 3) - (a + b)) AS ties FROM (SELECT *, coalesce(sum(b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM b)),
m AS (SELECT count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, avg(v) FILTER (one) AS m1, avg(v) FILTER (NOT one) AS m2, var_samp(v) FILTER (one) AS v1, var_samp(v) FILTER (NOT one) AS v2 FROM r),
t AS (SELECT *, sqrt(v1 / n1 + v2 / n2) AS se, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM m), {quantile_sql('t', 'df')},
z AS (SELECT *, greatest(0, greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM t, u)
SELECT n1, n2, round(m1, 4) AS mean1, round(m2, 4) AS mean2, round(t, 6) AS t, round(df, 4) AS df, round({t_sql('t', 'df')}, 6) AS p_welch, round(m1 - m2 - q * se, 2) AS low, round(m1 - m2 + q * se, 2) AS high, u, round({normal_sql('z')}, 6) AS p_mann_whitney, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial FROM z, tq""")
def t06(spark, d):
    """Balances of two segments of customers: Welch's t and Mann and Whitney's U with p, and the interval of the difference."""
    out = tests.independent_test(views.table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").drop("hedges_g")
    return rounded(rounded(rounded(out, "t", "p_welch", "p_mann_whitney", "rank_biserial"), "mean1", "mean2", "df", places=4), "low", "high", places=2)


@query("r09_independent_bootstrap", f"""WITH s AS (SELECT c_mktsegment = 'BUILDING' AS side, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment = 'BUILDING' ORDER BY c_custkey) - 1 AS slot, count(*) OVER (PARTITION BY c_mktsegment = 'BUILDING') AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
d AS (SELECT rep, side, ('0x' || substr(md5('r09i:' || rep || ':' || side || ':' || slot), 1, 8))::BIGINT % n AS slot FROM s, range({REPS}) t(rep)), x AS (SELECT rep, round(avg(v) FILTER (side) - avg(v) FILTER (NOT side), 3) AS diff FROM d JOIN s USING (side, slot) GROUP BY rep)
SELECT round(quantile_cont(diff, 0.025), 1) AS low, round(quantile_cont(diff, 0.975), 1) AS high, count(diff) AS kept FROM x""")
def r09_independent(spark, d):
    """The interval of the difference of two segments' mean balances, each segment drawn by itself."""
    rows = views.table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    means = resampling.independent_means(rows, F.col("c_mktsegment") == "BUILDING", "c_acctbal", REPS, "r09i", "c_custkey")
    return rounded(resampling.interval(rounded(means, "diff", places=3), "diff"), "low", "high", places=1)


@query("r10_two_families", f"""WITH {PRED_DOC}, g AS (SELECT grp AS name, substr(grp, length(grp), 1) AS construct, avg(CAST((pa >= 0.5) = (y = 1) AS INTEGER)) AS acc, count(*) AS n FROM pd GROUP BY grp),
t AS (SELECT name, construct, round(acc, 6) AS acc, round(acc - 1.96 * sqrt(acc * (1 - acc) / n), 6) AS low, round({normal_sql('((acc - 0.5) / sqrt(0.25 / n))')}, 6) + CAST(0 AS DOUBLE) AS p FROM g),
f AS (SELECT *, 'all' AS family FROM t UNION ALL SELECT *, 'constructs' FROM t QUALIFY row_number() OVER (PARTITION BY construct ORDER BY p, name) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS rank, count(*) OVER (PARTITION BY family) AS m FROM f),
q AS (SELECT *, least(1, min(p * m / rank) OVER (PARTITION BY family ORDER BY p DESC, name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
SELECT family, name, construct, acc, low, p, rank::INTEGER AS rank, round(q, 6) AS q, q < 0.05 AS survives, q < 0.05 AND low > 0.5 AS survives_both FROM q""")
def r10(spark, d):
    """Whether each source's accuracy is other than a coin's: p by the normal distribution, q over all sources and over the best of each last digit."""
    right = ((F.col("pa") >= 0.5) == (F.col("y") == 1)).cast("double")
    g = views.document_predictions(spark, d).groupBy(F.col("grp").alias("name")).agg(F.avg(right).alias("acc"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("construct", F.substring("name", -1, 1)).withColumn("low", F.col("acc") - 1.96 * F.sqrt(F.col("acc") * (1 - F.col("acc")) / F.col("n"))).withColumn("z", (F.col("acc") - 0.5) / F.sqrt(0.25 / F.col("n")))
    t = rounded(g.withColumn("p", tests.tail(tests.normal_two_sided, "z")), "acc", "low", "p").drop("n", "z")
    return rounded(metrics.two_families(t, "construct"), "q")


BLOCK = f"""WITH {PRED_DOC}, px AS (SELECT id, grp, y, pa AS p FROM pd), c AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS positives, avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS agree, count(*) FILTER (p >= 0.5) AS yes, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(DISTINCT grp) AS groups, min(p) AS score_min, max(p) AS score_max, avg(p) AS score_mean FROM px),
k AS (SELECT *, (yes * positives + (n - yes) * (n - positives)) / CAST(n * n AS DOUBLE) AS chance FROM c), au AS ({auc_sql('px', '', 'y', 'p')}),
{DRAWS.format(src='px', seed='m10-boot', reps=REPS)}, bx AS (SELECT rep, y, p, times FROM px JOIN dm USING (grp)), ba AS ({auc_sql('bx', 'rep', 'y', 'p', 'times')}), bi AS (SELECT quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high, count(auc) AS kept FROM ba),
rs AS (SELECT p, count(*) AS c FROM px GROUP BY p), rk AS (SELECT p, coalesce(sum(c) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / CAST(2 AS DOUBLE) AS rank FROM rs), fk AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY id) AS k, rank, y FROM px JOIN rk USING (p)),
hk AS (SELECT rep, grp, y, row_number() OVER (PARTITION BY rep, grp ORDER BY ('0x' || substr(md5('m10-perm:' || rep || ':' || id), 1, 8))::BIGINT, id) AS k FROM px, range(20) t(rep)), zk AS (SELECT rep, sum(rank) AS v FROM hk JOIN fk ON hk.grp = fk.grp AND hk.k = fk.k WHERE hk.y = 1 GROUP BY rep), pk AS (SELECT (count(*) FILTER (v >= obs) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value FROM zk, (SELECT sum(rank) AS obs FROM fk WHERE y = 1)),
ap AS (SELECT sum(pos * tp / seen) / sum(pos) AS ap, sum(pos) / sum(n) AS base_rate FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM px GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
SELECT n, positives, groups, round(agree, 6) AS accuracy, round(greatest(positives, n - positives) / n, 6) AS baseline, agree > greatest(positives, n - positives) / n AS beats_baseline, round(tp / nullif(yes, 0), 6) AS precision, round(tp / nullif(positives, 0), 6) AS recall, round((agree - chance) / nullif(1 - chance, 0), 6) AS kappa,
auc, round(low, 5) AS low, round(high, 5) AS high, kept, low > 0.5 AS excludes_chance, round(p_value, 6) AS p_value, round(ap, 6) AS ap, round(base_rate, 6) AS base_rate, round(ap / base_rate, 6) AS lift, score_min, score_max, round(score_mean, 6) AS score_mean, round(score_max - score_min, 6) AS score_spread FROM k, au, bi, pk, ap"""


@query("m10_record_block", BLOCK)
def m10(spark, d, reps=REPS, permutations=20, split=False):
    """All metrics of one record in one row; at few repetitions, as SQL repeats them."""
    rows = views.document_predictions(spark, d).withColumnRenamed("pa", "p")
    out = metrics.record_block(rows, reps, permutations, "m10", split=split)
    return rounded(rounded(out, "accuracy", "baseline", "precision", "recall", "kappa", "auc", "p_value", "ap", "base_rate", "lift", "score_mean", "score_spread"), "low", "high", places=5)


@query("m10_record_block_full")
def m10_full(spark, d):
    """At the reference's repetitions; permutations are split over blocks, as in the full form of r04."""
    return m10(spark, d, FULL_PERM, FULL_PERM, split=True)


@query("m11_fold_block", f"""WITH {PRED_MULTI}, f AS (SELECT *, (grp * 7 + y_true) % 5 AS fold, y_prob[4] AS p FROM pq WHERE NOT (grp % 5 = 0 AND y_true < 2)), gr AS (SELECT fo.fold, c.i AS class FROM (SELECT DISTINCT fold FROM f) fo, range(10) c(i)),
e AS (SELECT gr.fold, gr.class, count(*) FILTER (f.y_true = gr.class) AS support, count(*) FILTER (f.y_pred = gr.class) AS predicted, count(*) FILTER (f.y_true = gr.class AND f.y_pred = gr.class) AS tp FROM gr JOIN f USING (fold) GROUP BY ALL),
x AS (SELECT *, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM e),
s AS (SELECT fold, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS accuracy, avg(f1) FILTER (support + predicted > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(support * predicted) / (sum(support) * sum(support)) AS chance, list(recall ORDER BY class) AS recalls, list(class ORDER BY class) FILTER (support = 0) AS missing FROM x GROUP BY fold),
tw AS (SELECT fold, CAST(y_true = 3 AS INTEGER) AS y, p FROM f), a AS ({auc_sql('tw', 'fold', 'y', 'p')}), o AS (SELECT fold, CASE WHEN max(y) = 1 AND min(y) = 0 THEN coalesce(2 * count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5) + count(*) FILTER (y = 1), 0), 0) END AS f1 FROM tw GROUP BY fold)
SELECT s.fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round((accuracy - chance) / nullif(1 - chance, 0), 6) AS kappa, array_to_string(list_transform(recalls, lambda r: CAST(round(1000 * r, 0) AS BIGINT)), ',') AS recalls, coalesce(array_to_string(missing, ','), '') AS missing, auc, round(f1, 6) AS f1 FROM s JOIN a USING (fold) JOIN o USING (fold)""")
def m11(spark, d):
    """Every fold's metrics with its classes' recalls in thousandths and the classes that it lacks; AUC and F1 are those of class 3."""
    rows = multi(spark, d).filter(~((F.col("grp") % 5 == 0) & (F.col("y_true") < 2))).withColumn("fold", (F.col("grp") * 7 + F.col("y_true")) % 5).withColumn("p", F.col("y_prob")[3])
    out = metrics.by_fold(rows, 10, 3)
    out = out.withColumn("recalls", F.array_join(F.transform("recalls", lambda r: F.round(1000 * r, 0).cast("long").cast("string")), ",")).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))
    return rounded(out, "accuracy", "macro_f1", "weighted_f1", "kappa", "auc", "f1")


@query("m08_matrix_report", f"""WITH {CM}, kk AS (SELECT y_true AS class, sum(n) AS support, sum(n) FILTER (y_true = y_pred) AS tp FROM cm GROUP BY y_true), er AS (SELECT sum(n) FILTER (y_true <> y_pred)::BIGINT AS errors, sum(n) FILTER (abs(y_true - y_pred) = 1)::BIGINT AS adjacent, arg_max({{'t': y_true, 'p': y_pred, 'n': n}}, (n, -y_true, -y_pred)) FILTER (y_true <> y_pred) AS w FROM cm)
SELECT errors, adjacent, w.t::INTEGER AS worst_true, w.p::INTEGER AS worst_pred, w.n AS worst_n, (SELECT coalesce(string_agg(class, ',' ORDER BY class), '') FROM kk WHERE support > 0 AND tp = 0) AS zero_recall, (SELECT coalesce(string_agg(class, ',' ORDER BY class), '') FROM kk WHERE support = 0) AS absent, (SELECT (10 - count(*)) / 10::DOUBLE FROM kk WHERE support = 0) AS ceiling FROM er""")
def m08(spark, d):
    """Errors of the ten classes: neighbours, the worst pair, classes that are never found or never occur."""
    out = metrics.matrix_report(metrics.confusion(multi(spark, d), 10), 10)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("zero_recall", "absent")})


@query("m16_without_groups", f"WITH {PRED_DOC}, g AS (SELECT DISTINCT grp AS held FROM pd), x AS (SELECT held, y, pa FROM pd JOIN g ON grp <> held), a AS ({auc_sql('x', 'held', 'y', 'pa')}), n AS (SELECT grp AS held, count(*) AS n FROM pd GROUP BY grp) SELECT min(auc) AS low, max(auc) AS high, arg_min(held, (-n, held)) AS largest, arg_min(auc, (-n, held)) AS auc_without_largest FROM a JOIN n USING (held)")
def m16(spark, d):
    return rounded(metrics.without_groups(views.document_predictions(spark, d), "grp", p="pa"), "low", "high", "auc_without_largest")


@query("d04_codebook_checks", """WITH b AS (SELECT p_brand || ' ' || p_size AS title, p_type AS marker FROM part WHERE p_size < 20), u AS (SELECT p_brand || ' ' || p_size AS title FROM part WHERE p_size >= 15 AND p_size < 30)
SELECT 'duplicate_title' AS problem, title AS name, count(*) AS n FROM b GROUP BY title HAVING count(*) > 1 UNION ALL SELECT 'duplicate_marker', marker, count(*) FROM b GROUP BY marker HAVING count(*) > 1
UNION ALL SELECT 'missing', title, count(*) FROM u WHERE title NOT IN (SELECT title FROM b) GROUP BY title UNION ALL SELECT 'orphan', title, count(*) FROM b WHERE title NOT IN (SELECT title FROM u) GROUP BY title""")
def d04(spark, d):
    """A codebook of small parts against the titles of larger ones: what stands twice, what is missing, what nothing uses."""
    p = views.table(spark, d, "part").withColumn("title", F.concat_ws(" ", "p_brand", "p_size"))
    return audits.codebook_checks(p.filter("p_size < 20").withColumn("marker", F.col("p_type")), p.filter("p_size >= 15 and p_size < 30"))
