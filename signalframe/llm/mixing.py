"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bernoulli_key, written


def targets(by_source: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets for a table (source, source_size) of one row per source.

    The sources in order of code points, null last, weigh ``weights``, repeating. They share ``share`` times the total
    in proportion, each up to ``cap`` times its own size; what is cut off is shared again by weight until none is above.
    In order of cap over weight, the first source that the remaining level doesn't fill sets the level of all after it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    level = (F.col("total") - F.col("caps")) / F.col("rest")
    return (
        by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("caps", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.when(level * F.col("weight") < F.col("cap"), level))
        .withColumn("level", F.first("open", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.round(F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")), 6).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), and a struct ``row`` of the columns ``keep`` if any are named.

    Each source takes exactly floor(target) words: every document as many whole times as the target holds its source,
    then whole documents in a seeded order, and of the document at the end as many words as are left. The sums of 4096
    hash ranges of each source place all rows but those of the one range where the mix ends, so a source that holds a
    third of all rows is neither gathered nor ordered. Null text has size 0; null sources are one source; repeated rows
    are rows of their own; equal keys fall back on size, and equal sizes then take alike whichever comes first. No rows
    give no rows. Other columns of ``docs`` are not looked at, whatever their names.
    """
    key = bernoulli_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *([F.struct(*keep).alias("row")] if keep else []))
    base = base.withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sums = written(base.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    target = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sums.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(target.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("extra", F.floor("target").cast("long") - F.col("times") * F.col("source_size"))
        .select(F.col("source").alias("of"), F.col("range").alias("at"), "range_size", "range_before", "source_size", "target", "times", "extra")
    )
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    left = F.col("extra") - F.col("range_before")
    ends = (left > 0) & (left < F.col("range_size"))
    settled = rows.filter(~ends).withColumn("more", F.when(left > 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    upto = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ending = rows.filter(ends).withColumn("seen", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    ending = ending.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least("size", left - F.col("seen")))).drop("seen")
    taken = (F.col("times") * F.col("size") + F.col("more")).alias("taken")
    return settled.unionByName(ending).select("doc_id", "size", "source_size", "target", taken, *(["row"] if keep else []))


def head_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each document as often as it is taken whole, then its first words.

    n_chars, where there, is that of the text that stands in the row. Documents without words have nothing to take.
    """
    rows = mix(docs, keep=tuple(docs.columns), **options).filter("taken > 0").select("row", "size", "taken")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    text = F.when(words < F.col("size"), head_words(F.col("row.text"), words)).otherwise(F.col("row.text"))
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT *, 2.0 * source_size AS cap, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         CAST(([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight
  FROM by_source
), turns AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), opened AS (
  SELECT *, CASE WHEN (total - caps) / rest * weight < cap THEN (total - caps) / rest END AS open FROM turns
), targets AS (
  SELECT source, source_size,
         round(coalesce(least(cap, weight * (SELECT open FROM opened WHERE open IS NOT NULL ORDER BY cap / weight, source IS NULL, source LIMIT 1)), cap), 6) AS target
  FROM opened
), rows_ AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS times,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(times * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - times * source_size - seen)) AS BIGINT) AS taken
FROM rows_
"""
