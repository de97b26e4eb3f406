"""A grid over window lengths from one scan: states of short bins that merge into those of longer windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def states(events: DataFrame, bin_ms: int, counts: dict[str, Column], value: str = "value") -> DataFrame:
    """One row a participant and bin: count, moments and extremes of the value and of the gaps between events, edges, named counts.

    A bin's first gap needs an event of the bin before, so it isn't in the bin's state; the edges give it when bins merge.
    """
    e = events.withColumn("bin", F.floor(F.col("ts") / bin_ms))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("participant", "bin").orderBy("ts", "event_id"))
    g = e.withColumn("gap", gap.cast("double")).groupBy("participant", "bin")
    moments = [x for c, p in ((value, "v"), ("gap", "g")) for x in (F.count(c).alias(f"{p}n"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{p}m"), F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias(f"{p}s"))]
    return g.agg(F.count(F.lit(1)).alias("n"), *moments, F.min(value).alias("low"), F.max(value).alias("high"), F.max("gap").alias("gap_max"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def merged(bins: DataFrame, factors: list[int], counts: list[str]) -> DataFrame:
    """(factor, participant, w, n, mean, sd, low, high, gap_mean, gap_sd, gap_max, counts) of windows of ``factor`` bins each.

    All lengths are one pass over the bins. Means are merged by weight, sums of squares around the merged mean; the gap
    between two neighbouring bins' edges is one more gap. A window of one event has null gaps.
    """
    b = bins.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors]))).withColumn("w", F.floor(F.col("bin") / F.col("factor")))
    own = Window.partitionBy("factor", "participant", "w")
    edge = F.col("first_ts") - F.lag("last_ts").over(own.orderBy("bin"))
    b = b.withColumn("edge", edge.cast("double"))
    gn = F.sum("gn").over(own) + F.count("edge").over(own)
    mean = F.sum(F.col("vn") * F.col("vm")).over(own) / F.sum("vn").over(own)
    gap_mean = F.try_divide(F.sum(F.col("gn") * F.col("gm") + F.coalesce("edge", F.lit(0.0))).over(own), gn)
    b = b.withColumns({"mean": mean, "gap_mean": gap_mean, "gaps": gn})
    off = lambda n, s, m, at: F.col(s) + F.col(n) * F.pow(F.col(m) - F.col(at), 2)
    alone = F.coalesce(F.pow(F.col("edge") - F.col("gap_mean"), 2), F.lit(0.0))
    g = b.groupBy("factor", "participant", "w").agg(
        F.sum("n").alias("n"), F.first("mean").alias("mean"), F.sqrt(F.sum(off("vn", "vs", "vm", "mean")) / F.sum("vn")).alias("sd"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.first("gap_mean").alias("gap_mean"), F.sqrt(F.try_divide(F.sum(F.when(F.col("gn") > 0, off("gn", "gs", "gm", "gap_mean")).otherwise(0.0) + alone), F.first("gaps"))).alias("gap_sd"),
        F.greatest(F.max("gap_max"), F.max("edge")).alias("gap_max"), *[F.sum(c).alias(c) for c in counts],
    )
    return g
