"""Canonical views over the driver tables, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000
#: Native event kinds and the five that features know.
EVENT_KINDS = {"view": "move", "click": "click", "signup": "key", "purchase": "scroll", "error": "visibility"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remapped(kind, mapping: dict[str, str] = EVENT_KINDS):
    """The feature kind of a native event kind; null for kinds that no feature knows."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), kind)


def micros(ts):
    """Microseconds since 1970 of a time stamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, event_id, ts (ms), type, x, y, key, dy, value: the events table as an interaction log."""
    e = table(spark, sf_dir, "events")
    kind = remapped(F.col("event_type"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select(
        F.col("user_id").alias("participant"), "event_id", F.floor(micros(F.col("ts")) / 1000).alias("ts"), kind.alias("type"),
        (F.pmod(F.col("event_id") * 37, F.lit(1000)) / 1000.0).alias("x"), (F.pmod(F.col("event_id") * 91, F.lit(1000)) / 1000.0).alias("y"),
        F.when(kind == "key", F.when(F.pmod(k, F.lit(16)) == 0, "Backspace").otherwise("a")).otherwise("").alias("key"),
        F.when(kind == "scroll", F.col("value") - 50).when(kind == "visibility", F.pmod("event_id", F.lit(2)).cast("double")).otherwise(0.0).alias("dy"), "value",
    )


EV = """ev AS (
  SELECT user_id AS participant, event_id, epoch_us(ts) // 1000 AS ts,
         CASE event_type WHEN 'view' THEN 'move' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'key' WHEN 'purchase' THEN 'scroll' WHEN 'error' THEN 'visibility' END AS type,
         (event_id * 37 % 1000) / CAST(1000 AS DOUBLE) AS x, (event_id * 91 % 1000) / CAST(1000 AS DOUBLE) AS y,
         CASE WHEN event_type = 'signup' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 = 0 THEN 'Backspace' ELSE 'a' END ELSE '' END AS key,
         CASE event_type WHEN 'purchase' THEN value - 50 WHEN 'error' THEN CAST(event_id % 2 AS DOUBLE) ELSE 0.0 END AS dy, value
  FROM events)"""


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, idx, y, p: one scored reading an event, in time order within a participant."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("grp"), (F.row_number().over(order) - 1).cast("long").alias("idx"),
        (F.col("event_type") == "error").cast("int").alias("y"), F.round(F.col("value") / (F.col("value") + 50.0), 6).alias("p"),
    )


PRED_BIN = """pb AS (
  SELECT event_id AS id, user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         CAST(event_type = 'error' AS INTEGER) AS y, round(value / (value + 50.0), 6) AS p
  FROM events)"""


def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, y, pa, pb: two arms of scores of the labelled documents; sources are the clusters."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("grp"), F.col("quality").alias("y"),
        F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 6).alias("pa"), F.round(F.pmod(F.col("doc_id") * 53, F.lit(1000)) / 1000.0, 6).alias("pb"),
    )


PRED_DOC = """pd AS (
  SELECT d.doc_id AS id, source AS grp, quality AS y, round(n_chars / (n_chars + CAST(1500 AS DOUBLE)), 6) AS pa, round((d.doc_id * 53 % 1000) / CAST(1000 AS DOUBLE), 6) AS pb
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, y_true, y_prob: ten-class probabilities from the first ten dimensions of each vector."""
    head = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(head, F.lit(0.0), lambda a, x: a + x)
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(20)).alias("grp"), F.col("label").alias("y_true"), F.transform(head, lambda x: F.round(x / total, 6)).alias("y_prob"))


PRED_MULTI = """pm0 AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE))) AS h FROM embeddings),
pm AS (SELECT vec_id AS id, vec_id % 20 AS grp, label AS y_true, list_transform(h, lambda x: round(x / list_sum(h), 6)) AS y_prob FROM pm0),
pq AS (SELECT id, grp, y_true, list_position(y_prob, list_max(y_prob)) - 1 AS y_pred, y_prob FROM pm)"""
