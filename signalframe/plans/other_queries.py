"""Queries over text, dimension tables, sets and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audits
from ..sources import views
from ..sources.views import EV, PRED_DOC, PRED_MULTI
from .event_queries import rounded
from .registry import query

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP) + "]"


def term_sql(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z_][a-z0-9_]{{3,}}')), lambda w: NOT list_contains({STOP_SQL}, w))"


REPLIES = "rp AS (SELECT a.conv_id, a.turn, a.text AS reply, b.text AS source FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant' AND b.role = 'user')"


def replies(spark, d):
    c = views.table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
    b = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return a.join(b, ["conv_id", "turn"])


@query("u06_grounding", f"WITH {REPLIES}, t AS (SELECT conv_id, turn, {term_sql('reply')} AS m, {term_sql('source')} AS s FROM rp) SELECT conv_id, turn, round(coalesce(len(list_intersect(m, s)) / nullif(len(m), 0), 0), 6) AS grounding, len(m)::INTEGER AS n_terms FROM t")
def u06(spark, d):
    r = replies(spark, d)
    return rounded(r.select("conv_id", "turn", text.grounding(F.col("reply"), F.col("source")).alias("grounding"), F.size(text.terms(F.col("reply"))).alias("n_terms")), "grounding")


@query("a33_reply_summary", "SELECT role, count(*) AS n, round(avg(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))), 6) AS mean_words, round(avg(CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) > 60 AS INTEGER)), 6) AS over_budget, count(*) FILTER (contains(text, '**') OR contains(text, '__') OR contains(text, '`')) AS markdown FROM conversations GROUP BY role")
def a33(spark, d):
    n = text.words(F.col("text"))
    g = views.table(spark, d, "conversations").groupBy("role")
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_words"), F.avg((n > 60).cast("int")).alias("over_budget"), F.count_if(text.has_markdown(F.col("text"))).alias("markdown")), "mean_words", "over_budget")


@query("f14_json_fields", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'invalid') AS k, coalesce(json_extract_string(props, '$.missing'), 'no_action') AS action FROM events")
def f14(spark, d):
    return views.table(spark, d, "events").select("event_id", text.field_or(F.col("props"), "k").alias("k"), text.field_or(F.col("props"), "missing", "no_action").alias("action"))


@query("f13_valid_strategies", "SELECT event_type, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 AND event_type IN ('click', 'view')) AS valid, count(*) AS n FROM events GROUP BY event_type")
def f13(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    made = F.to_json(F.struct(F.col("event_type").alias("action_type"), F.when(k % 3 == 0, "high").otherwise("unknown").alias("urgency")))
    return views.table(spark, d, "events").groupBy("event_type").agg(F.count_if(text.valid_strategy(made, ["click", "view"])).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("f02_softmax", f"WITH {PRED_MULTI}, e AS (SELECT id, list_transform(y_prob, lambda x: exp(x - list_max(y_prob))) AS e FROM pm) SELECT id, round(list_max(e) / list_sum(e), 6) AS top, (list_position(e, list_max(e)) - 1)::INTEGER AS y_pred FROM e")
def f02(spark, d):
    m = views.multiclass_predictions(spark, d).withColumn("s", text.softmax(F.col("y_prob")))
    return rounded(m.select("id", F.array_max("s").alias("top"), (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("y_pred")), "top")


@query("f03_logits_and_fusion", f"WITH {PRED_DOC}, q AS (SELECT *, least(greatest(pa, 1e-6), 1 - 1e-6) AS q FROM pd) SELECT id, round(ln(q / (1 - q)), 6) AS logit, round((pa + pb) / 2, 7) AS mean, greatest(pa, pb) AS top FROM q")
def f03(spark, d):
    p = views.document_predictions(spark, d)
    return rounded(rounded(p.select("id", text.logit(F.col("pa")).alias("logit"), ((F.col("pa") + F.col("pb")) / 2).alias("mean"), F.greatest("pa", "pb").alias("top")), "logit"), "mean", places=7)


@query("f04_two_stage", f"WITH {PRED_MULTI}, s AS (SELECT id, y_prob[1] AS p, [y_prob[2], y_prob[3], y_prob[4]] AS q FROM pm) SELECT id, round(1 - p, 6) AS p0, round(p * q[1] / list_sum(q), 6) AS p1, round(p * q[2] / list_sum(q), 6) AS p2, round(p * q[3] / list_sum(q), 6) AS p3 FROM s")
def f04(spark, d):
    y = F.col("y_prob")
    s = views.multiclass_predictions(spark, d).select("id", text.two_stage(y[0], F.array(y[1], y[2], y[3])).alias("s"))
    return rounded(s.select("id", *[F.col("s")[k].alias(f"p{k}") for k in range(4)]), "p0", "p1", "p2", "p3")


@query("f22_corn_rank", "WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: 1 / (1 + exp(-(CAST(x AS DOUBLE) * 4 + 1)))) AS s FROM embeddings) SELECT vec_id AS id, (CAST(s[1] > 0.5 AS INTEGER) + CAST(s[1] * s[2] > 0.5 AS INTEGER) + CAST(s[1] * s[2] * s[3] > 0.5 AS INTEGER))::INTEGER AS rank FROM e")
def f22(spark, d):
    e = views.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), text.corn_rank(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 4 + 1)).cast("int").alias("rank"))


@query("f08_class_weights", f"WITH {PRED_MULTI}, c AS (SELECT y_true AS label, count(*) AS n FROM pm GROUP BY 1) SELECT label, n, round((1 / sqrt(n)) * count(*) OVER () / sum(1 / sqrt(n)) OVER (), 6) AS weight, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced FROM c")
def f08(spark, d):
    c = views.multiclass_predictions(spark, d).groupBy(F.col("y_true").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k, w = F.count(F.lit(1)).over(every), 1 / F.sqrt("n")
    return rounded(c.select("label", "n", (w * k / F.sum(w).over(every)).alias("weight"), (F.sum("n").over(every) / (k * F.col("n"))).alias("balanced")), "weight", "balanced")


@query("f09_numeric_order", "SELECT doc_id, source, CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) AS number, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place FROM documents")
def f09(spark, d):
    """The number that a name holds, and a row's place within it; a name without one fails the job."""
    part = F.regexp_extract("source", r"^src([0-9]+)$", 1)
    number = F.when(part != "", part).otherwise(F.raise_error(F.concat(F.lit("no number in "), F.col("source")))).cast("int")
    docs = views.table(spark, d, "documents").select("doc_id", "source", number.alias("number"))
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy("doc_id")))


@query("f07_magnitudes", f"WITH {EV} SELECT participant, round(avg(value) / stddev_samp(value), 6) AS d, CASE WHEN abs(avg(value) / stddev_samp(value)) < 0.2 THEN 'negligible' WHEN abs(avg(value) / stddev_samp(value)) < 0.5 THEN 'small' WHEN abs(avg(value) / stddev_samp(value)) < 0.8 THEN 'medium' ELSE 'large' END AS size, round(1.96 * sqrt(0.25 / count(*)), 6) AS half_width FROM ev GROUP BY participant")
def f07(spark, d):
    g = views.events(spark, d).groupBy("participant").agg((F.avg("value") / F.stddev_samp("value")).alias("d"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("participant", "d", text.magnitude(F.col("d")).alias("size"), text.half_width(F.col("n")).alias("half_width")), "d", "half_width")


@query("j05_dimension_lookup", "SELECT n_name, r_name, count(*) AS customers, count(*) FILTER (r_name = 'ASIA') AS hits, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def j05(spark, d):
    c, n, r = (views.table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("r_name") == "ASIA").alias("hits"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("j06_complete_lookup", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j06(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return audits.complete(o, c, "k").select("o_orderkey", "c_mktsegment")


@query("j07_paired_alignment", f"WITH {PRED_DOC} SELECT id, grp, y, pa, pb FROM pd")
def j07(spark, d):
    p = views.document_predictions(spark, d)
    return audits.aligned(p.select("id", "grp", "y", "pa"), p.select("id", "grp", "y", "pb"), "id", same=["grp", "y"]).select("id", "grp", "y", "pa", F.col("r_pb").alias("pb"))


@query("j10_composite_join", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def j10(spark, d):
    li = views.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    o = views.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("j11_unlabelled", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def j11(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "source").join(views.table(spark, d, "labels"), "doc_id", "left_anti")


@query("j12_members", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j12(spark, d):
    o = views.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return views.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j14_class_pairs", f"WITH {PRED_MULTI}, c AS (SELECT y_true AS label, count(*) AS n FROM pm GROUP BY 1) SELECT a.label AS low, b.label AS high, a.n + b.n AS n FROM c a JOIN c b ON a.label < b.label")
def j14(spark, d):
    c = views.multiclass_predictions(spark, d).groupBy(F.col("y_true").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    a, b = c.select(F.col("label").alias("low"), F.col("n").alias("x")), c.select(F.col("label").alias("high"), F.col("n").alias("z"))
    return a.join(b, F.col("low") < F.col("high")).select("low", "high", (F.col("x") + F.col("z")).alias("n"))


@query("u01_union_all", "SELECT 'c' AS side, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def u01(spark, d):
    c = views.table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"))
    s = views.table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("side", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("u02_shared_keys", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u02(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("u04_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u04(spark, d):
    urgent = views.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return views.table(spark, d, "customer").select("c_custkey").subtract(urgent.select("o_custkey"))


@query("o04_top_customers", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 10")
def o04(spark, d):
    """The ten largest of each segment: Spark keeps ten a segment in each partition before the shuffle."""
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return views.table(spark, d, "customer").withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("u05_duplicates", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def u05(spark, d):
    return views.table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("d03_group_quality", f"WITH {PRED_DOC} SELECT grp, count(*) AS n, count(DISTINCT y) AS labels, count(DISTINCT y) < 2 AS degenerate FROM pd GROUP BY grp")
def d03(spark, d):
    return audits.quality(views.document_predictions(spark, d), "grp", "y")


@query("d06_reconciled_totals", "WITH o AS (SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT o_orderstatus AS status, count(DISTINCT l_orderkey) AS with_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT status, orders, coalesce(with_lines, 0) AS with_lines, orders = coalesce(with_lines, 0) AS equal FROM o LEFT JOIN l USING (status)")
def d06(spark, d):
    """Orders of each status as their own table counts them, and as the lines name them."""
    o = views.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    named = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    lines = o.join(named, "o_orderkey").groupBy("status").agg(F.count(F.lit(1)).alias("with_lines"))
    both = o.groupBy("status").agg(F.count(F.lit(1)).alias("orders")).join(lines, "status", "left").na.fill(0, ["with_lines"])
    return both.withColumn("equal", F.col("orders") == F.col("with_lines"))


@query("d08_split_overlap", "SELECT o_custkey, 'a,b' AS parts FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def d08(spark, d):
    o = views.table(spark, d, "orders")
    return audits.disjoint({"a": o.filter("o_orderstatus = 'F'"), "b": o.filter("o_orderstatus = 'P'")}, "o_custkey")


@query("a19_label_audit", "SELECT target, count(*) AS n, count(*) FILTER (level = 1) AS positives, CASE WHEN least(count(*) FILTER (level = 1), count(*) FILTER (level <> 1)) < 10 THEN 'unusable' WHEN least(count(*) FILTER (level = 1), count(*) FILTER (level <> 1)) < 50 THEN 'very weak' WHEN least(count(*) FILTER (level = 1), count(*) FILTER (level <> 1)) < 200 THEN 'weak' ELSE 'usable' END AS verdict FROM (UNPIVOT (SELECT doc_id, quality, toxic FROM labels) ON quality, toxic INTO NAME target VALUE level) GROUP BY target")
def a19(spark, d):
    u = views.table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "target", "level")
    g = u.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == 1).alias("positives"))
    return g.withColumn("verdict", audits.verdict(F.least(F.col("positives"), F.col("n") - F.col("positives"))))


@query("a20_log_summary", "SELECT k, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high, count(*) AS n FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME k VALUE v) GROUP BY k")
def a20(spark, d):
    u = views.table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "k", "v")
    return rounded(u.groupBy("k").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")), "mean", "low", "high", places=4)


@query("a23_fold_summary", f"WITH {PRED_DOC}, f AS (SELECT grp, avg(CAST((pa >= 0.5) = (y = 1) AS INTEGER)) AS acc FROM pd GROUP BY grp) SELECT round(avg(acc), 6) AS mean, round(coalesce(stddev_samp(acc), 0), 6) AS sd, round(min(acc), 6) AS low, round(max(acc), 6) AS high, arg_max(grp, (acc, grp)) AS best FROM f")
def a23(spark, d):
    f = views.document_predictions(spark, d).groupBy("grp").agg(F.avg(((F.col("pa") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("acc"))
    return rounded(f.agg(F.avg("acc").alias("mean"), F.coalesce(F.stddev_samp("acc"), F.lit(0.0)).alias("sd"), F.min("acc").alias("low"), F.max("acc").alias("high"), F.max_by("grp", F.struct("acc", "grp")).alias("best")), "mean", "sd", "low", "high")


@query("p21_held_out_prefix", "SELECT starts_with(source, 'src1') OR starts_with(source, 'src7') AS held, count(*) AS n FROM documents GROUP BY 1")
def p21(spark, d):
    return views.table(spark, d, "documents").groupBy(text.any_prefix(F.col("source"), ["src1", "src7"]).alias("held")).agg(F.count(F.lit(1)).alias("n"))


@query("s02_log_round_trip", f"WITH {EV} SELECT 'log_' || participant AS participant, count(*) AS n, count(*) FILTER (type = 'key') AS keys, count(*) FILTER (key = 'Backspace') AS backspaces, round(sum(coalesce(value - prev, 0)) FILTER (type = 'scroll'), 4) AS scrolled FROM (SELECT *, lag(value) OVER (PARTITION BY participant, type ORDER BY ts, event_id) AS prev FROM ev) WHERE type <> 'visibility' GROUP BY participant")
def s02(spark, d):
    """The events table written as a tab-separated interaction log and read back; logs have no kind for visibility."""
    import uuid

    from ..session import scratch_dir
    from ..sources import files

    names = {v: k for k, v in reversed(files.LOG_KINDS.items())}
    e = views.events(spark, d)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("type"))
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    out = e.select(F.col("participant").alias("session"), F.col("ts").alias("timestamp"), kind.alias("type"), F.when(F.col("key") == "Backspace", "BACK_SPACE").otherwise(F.col("key")).alias("key"), "x", "y", F.col("value").alias("yPosition"), "event_id")
    # a session is whole in one of the files, as its differences need
    out.repartition("session").sortWithinPartitions("ts", "event_id").drop("event_id").write.option("sep", "\t").option("header", True).csv(path)
    log = files.interaction_log(spark, [path]).withColumn("participant", F.concat(F.lit("log_"), F.regexp_extract("participant", r"_([^_]+)$", 1)))
    g = log.groupBy("participant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "key").alias("keys"), F.count_if(F.col("key") == "Backspace").alias("backspaces"), F.round(F.sum(F.when(F.col("type") == "scroll", F.col("dy"))), 4).alias("scrolled"))
    return g


@query("x02_logistic_arm")
def x02(spark, d):
    """A logistic model (standardised, classes balanced) of the feature windows, scored out of fold by participant."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..session import kept
    from .event_queries import a06

    names = [f"{c}_{s}" for c in ("click_count", "keystroke_count", "idle_time_pct") for s in ("mean", "std", "trend")]
    w = a06(spark, d).withColumn("y", (F.col("tab_switch_count_mean") > 0.45).cast("double")).withColumn("fold", F.pmod(F.xxhash64("participant"), F.lit(3)))
    w = kept(w.select("participant", "window_index", "y", "fold", *names), "arm-windows")  # each fold reads them several times
    rows = VectorAssembler(inputCols=names, outputCol="raw").transform(w)
    out = None
    for k in range(3):  # the folds of a fit on the driver's schedule; each fit is a Spark job
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        sizes = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
        train = train.withColumn("weight", sum((F.when(F.col("y") == y, F.lit(sum(sizes.values()) / len(sizes) / n)).otherwise(0.0) for y, n in sizes.items()), F.lit(0.0)))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        model = LogisticRegression(labelCol="y", weightCol="weight", regParam=0.01).fit(scaler.transform(train))
        one = model.transform(scaler.transform(test)).select("participant", "window_index", F.col("y").cast("int").alias("y"), F.round(vector_to_array("probability")[1], 6).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out
