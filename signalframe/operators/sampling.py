"""Weighted draws with replacement: multiplicities by looking seeded draws up in running sums of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def position(seed: str, slot: Column, total: Column) -> Column:
    """A whole number from 0 to total - 1: 60 bits of md5, which any engine repeats."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), slot.cast("string"))), 1, 15), 16, 10).cast("bigint")
    return F.pmod(bits, total)


def balanced_weight(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with weight: 2**32 over the square root of the number of rows of the label, as a whole number."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(F.broadcast(n), label).withColumn("weight", F.floor(F.lit(float(1 << 32)) / F.sqrt("_n")).cast("bigint")).drop("_n")  # one row a label


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """(key, times): how often each row is drawn in ``n`` draws with replacement, in proportion to whole weights.

    Each draw is a place in the running sum of weights. The sums are made by ranges; a draw goes to the range that it
    falls into, by the ranges' totals, and there meets the rows in one sorted stream. Rows that aren't drawn are left
    out; nothing is repeated. ``key`` tells rows apart; weights of 0 and null are never drawn.
    """
    spark = rows.sparkSession
    some = rows.filter(F.col(weight) > 0).select(key, F.col(weight).cast("bigint").alias("_w"))
    placed = running(some, [key], {"_from": F.col("_w")})
    ends = placed.groupBy("part").agg(F.min("_from").alias("low"), F.sum("_w").alias("w")).orderBy("low").collect()  # a row a range
    if not ends:
        return placed.select(key, F.lit(0).cast("bigint").alias("times")).limit(0)
    total, lows = sum(r.w for r in ends), F.array(*[F.lit(r.low) for r in ends])
    parts = F.array(*[F.lit(r.part) for r in ends])
    draws = spark.range(n).select(position(seed, F.col("id"), F.lit(total)).alias("_at"))
    draws = draws.groupBy("_at").agg(F.count(F.lit(1)).alias("_c")).withColumn("part", F.get(parts, F.aggregate(lows, F.lit(-1), lambda a, x: a + (x <= F.col("_at")).cast("int"))))
    kind = rows.schema[key].dataType
    both = placed.select("part", F.col("_from").alias("_at"), F.lit(0).alias("side"), key, F.lit(0).cast("bigint").alias("_c")).unionByName(draws.select("part", "_at", F.lit(1).alias("side"), F.lit(None).cast(kind).alias(key), "_c"))
    near = F.last(key, ignorenulls=True).over(Window.partitionBy("part").orderBy("_at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(key, near).filter("side = 1").groupBy(key).agg(F.sum("_c").alias("times"))
