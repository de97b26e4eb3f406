"""Windows of a log with the labels that people gave them and the channels beside: one aggregation of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import unpaired


def placed(rows: DataFrame, window_ms: int) -> DataFrame:
    """``rows`` (participant, ts, ...) with t0, the participant's first time over all rows, and window_index from it."""
    first = rows.groupBy("participant").agg(F.min("ts").alias("t0"))
    return rows.join(first, "participant").withColumn("window_index", F.floor((F.col("ts") - F.col("t0")) / window_ms))


def labelled_windows(rows: DataFrame, window_ms: int, counts: Column, manual: list[str], channels: list[str], least: int) -> DataFrame:
    """(participant, window_index, n_events, max_<manual>, <channel>) of windows with ``least`` rows that ``counts`` holds for.

    The greatest annotation (null counts as 0) and the channels' means (nulls skipped) come from all rows of a window, also
    of kinds that no feature knows, so that dropping such rows moves no label. Rows without a time are left out.
    """
    w = placed(rows.filter(F.col("ts").isNotNull()), window_ms)
    out = w.groupBy("participant", "window_index").agg(
        F.count_if(counts).alias("n_events"), *[F.max(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(f"max_{m}") for m in manual], *[F.avg(F.col(c).cast("double")).alias(c) for c in channels]
    )
    return out.filter(F.col("n_events") >= least)


def platform_windows(rows: DataFrame, window_ms: int, slot_ms: int, pair_ms: int, manual: list[str], channels: list[str], least: int = 1) -> DataFrame:
    """Windows as a running platform would count them: moves once a slot, clicks without those that a down answers.

    ``rows`` has participant, event_id, ts, type (null for kinds that aren't recorded) and down for clicks. Labels and
    channels still come from all rows.
    """
    slot = F.floor(F.col("ts") / slot_ms)
    last = Window.partitionBy("participant", slot).orderBy(F.desc("ts"), F.desc("event_id"))
    moves = rows.filter("type = 'move'").withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    clicks = unpaired(rows.filter("type = 'click'").select("participant", "ts", "event_id", "down"), pair_ms)
    others = rows.filter("type is not null and type not in ('move', 'click')")
    seen = moves.select("participant", "event_id").unionByName(clicks.select("participant", "event_id")).unionByName(others.select("participant", "event_id")).withColumn("_seen", F.lit(True))
    return labelled_windows(rows.join(seen, ["participant", "event_id"], "left"), window_ms, F.coalesce(F.col("_seen"), F.lit(False)), manual, channels, least)


def any_annotation(window: DataFrame, column: str, threshold: float) -> DataFrame:
    """With label 1 where the greatest annotation reaches the threshold, else 0."""
    return window.withColumn("label", (F.col(column) >= threshold).cast("int"))


def exclusive(window: DataFrame, column: str, intense: float) -> DataFrame:
    """With label 1 for intense annotations and 0 for none; windows with milder ones go."""
    return window.filter((F.col(column) >= intense) | (F.col(column) == 0)).withColumn("label", (F.col(column) >= intense).cast("int"))


def proxy(window: DataFrame, neutral: str, below: float = 90.0) -> DataFrame:
    """With label 1 where the neutral channel's mean is below ``below``; a window without any is 0."""
    return window.withColumn("label", F.coalesce(F.col(neutral) < below, F.lit(False)).cast("int"))


def state(window: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """With label 0 where no annotation reaches the threshold, else the number, from 1, of the first greatest."""
    m = F.array(*[F.col(c) for c in columns])
    return window.withColumn("label", F.when(F.array_max(m) < threshold, 0).otherwise(F.array_position(m, F.array_max(m))).cast("int"))


def with_all(window: DataFrame, channels: list[str]) -> DataFrame:
    """Windows whose channels are all there."""
    return window.dropna(subset=channels)
