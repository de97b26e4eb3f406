"""Session-relative windows, sub-bins and the sixteen interaction features, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feature order (fixed values: the tensor's column order).
FEATURES = [
    "mouse_entropy", "mouse_velocity_mean", "mouse_velocity_std", "click_count", "hover_dwell_mean",
    "keystroke_count", "typing_rhythm_std", "backspace_pct", "pause_count",
    "scroll_velocity_mean", "scroll_direction_changes", "scroll_back_runs", "scroll_inactivity_pct",
    "idle_time_pct", "blur_time_pct", "tab_switch_count",
]
#: Values of a bin in which nothing happened; all others are 0.
QUIET = {"scroll_inactivity_pct": 1.0, "idle_time_pct": 1.0}


def tumbling(events: DataFrame, window_ms: int, key: str = "participant", by: Column | None = None) -> DataFrame:
    """Add window_index and window_start: windows count from each session's first event (of those where ``by`` holds)."""
    start = F.min(F.when(by, F.col("ts")) if by is not None else F.col("ts")).over(Window.partitionBy(key))
    index = F.floor((F.col("ts") - start) / window_ms)
    return events.withColumn("window_index", index).withColumn("window_start", start + index * window_ms)


def bin_features(events: DataFrame, window_ms: int, bin_ms: int, activity_ms: int = 200, sample_hz: int = 10, low_velocity: float = 0.05, pause_s: float = 0.5) -> DataFrame:
    """(participant, window_index, bin, 16 features) for every bin of every window that has an event; bins are complete.

    Two shuffles: one by participant for the windows, which the window functions and the aggregation within a window
    reuse. Velocities, intervals and runs look only at neighbours within a bin.
    """
    n_bins = window_ms // bin_ms
    keys = ["participant", "window_index", "bin"]
    e = tumbling(events, window_ms).withColumn("bin", F.floor((F.col("ts") - F.col("window_start")) / bin_ms)).filter(F.col("bin") < n_bins)
    # runs within (bin, type): by participant first, so that the exchange for windows serves all that follow
    w = Window.partitionBy(*keys, "type").orderBy("ts", "event_id")
    inputs = F.col("type").isin("move", "click", "key", "scroll")
    act = Window.partitionBy(*keys, inputs).orderBy("ts", "event_id")
    gap = (F.col("ts") - F.lag("ts").over(w)) / 1000.0
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    hi = F.col("window_start") + (F.col("bin") + 1) * bin_ms
    e = e.withColumn("gap", gap).withColumn("vel", F.when(F.col("type") == "move", step / F.greatest(F.col("gap"), F.lit(1e-3))))
    e = e.withColumn("slow", F.coalesce(F.col("vel") < low_velocity, F.lit(False))).withColumn("sign", F.when(F.col("type") == "scroll", F.signum("dy")))
    e = e.withColumn("slow_start", F.col("slow") & ~F.coalesce(F.lag("slow").over(w), F.lit(False)))
    e = e.withColumn("back", F.coalesce(F.col("sign") < 0, F.lit(False))).withColumn("back_start", F.col("back") & ~F.coalesce(F.lag("back").over(w), F.lit(False)))
    nonzero = F.when(F.col("sign") != 0, F.col("sign"))
    before = F.last(nonzero, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("turn", F.coalesce((F.col("sign") != 0) & (F.col("sign") != before), F.lit(False)))
    cover = F.when(inputs, F.least(F.lit(float(activity_ms)), F.coalesce(F.lead("ts").over(act), hi) - F.col("ts"), hi - F.col("ts")))
    e = e.withColumn("cover", cover).withColumn("cell", F.when((F.col("type") == "move") & F.col("x").between(0, 1) & F.col("y").between(0, 1), F.least(F.floor(F.col("x") * 6), F.lit(5)) * 6 + F.least(F.floor(F.col("y") * 6), F.lit(5))))
    is_ = lambda t: F.col("type") == t
    cells = F.array(*[F.count_if(F.col("cell") == c) for c in range(36)])
    agg = e.groupBy(*keys).agg(
        F.count_if(is_("move")).alias("moves"), cells.alias("cells"),
        F.avg("vel").alias("mouse_velocity_mean"), F.stddev_pop("vel").alias("mouse_velocity_std"),
        F.count_if(is_("click")).cast("double").alias("click_count"),
        (F.count_if("slow") / F.nullif(F.count_if("slow_start"), F.lit(0)) / float(sample_hz)).alias("hover_dwell_mean"),
        F.count_if(is_("key")).cast("double").alias("keystroke_count"), F.stddev_pop(F.when(is_("key"), F.col("gap"))).alias("typing_rhythm_std"),
        F.avg(F.when(is_("key"), (F.col("key") == "Backspace").cast("double"))).alias("backspace_pct"),
        F.count_if(is_("key") & (F.col("gap") > pause_s)).cast("double").alias("pause_count"),
        F.avg(F.when(is_("scroll"), F.abs("dy"))).alias("scroll_velocity_mean"), F.count_if("turn").cast("double").alias("scroll_direction_changes"),
        F.count_if("back_start").cast("double").alias("scroll_back_runs"),
        F.greatest(F.lit(0.0), 1 - F.count_if(is_("scroll")) / float(sample_hz)).alias("scroll_inactivity_pct"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("cover"), F.lit(0.0)) / bin_ms)).alias("idle_time_pct"),
        F.count_if(is_("visibility")).cast("double").alias("tab_switch_count"),
    )
    inside = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c)
    entropy = -F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(c > 0, c / inside * F.log2(c / inside)).otherwise(0.0))
    agg = agg.withColumn("mouse_entropy", F.when((F.col("moves") >= 2) & (inside > 0), entropy).otherwise(0.0)).drop("moves", "cells")
    windows = e.groupBy("participant", "window_index").agg(F.first("window_start").alias("window_start"))
    grid = windows.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    out = grid.join(agg, keys, "left").join(hidden_share(e, window_ms, bin_ms), keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(f), F.lit(QUIET.get(f, 0.0))).alias(f) for f in FEATURES])


def hidden_share(events: DataFrame, window_ms: int, bin_ms: int) -> DataFrame:
    """(participant, window_index, bin, blur_time_pct): the share of a bin in which the page is hidden.

    A visibility event holds until the next one of the window; each hidden stretch is cut at the bins it touches.
    """
    w = Window.partitionBy("participant", "window_index").orderBy("ts", "event_id")
    end = F.col("window_start") + window_ms
    v = events.filter(F.col("type") == "visibility").withColumn("until", F.coalesce(F.lead("ts").over(w), end)).filter("dy > 0 and until > ts")
    last = F.floor((F.col("until") - 1 - F.col("window_start")) / bin_ms)
    v = v.withColumn("b", F.explode(F.sequence("bin", last)))
    lo = F.col("window_start") + F.col("b") * bin_ms
    part = F.least(F.col("until"), lo + bin_ms) - F.greatest(F.col("ts"), lo)
    return v.groupBy("participant", "window_index", F.col("b").alias("bin")).agg((F.sum(part) / bin_ms).alias("blur_time_pct"))


def five_statistics(bins: DataFrame, channels: list[str], keys: list[str], order: str, n: int) -> DataFrame:
    """mean, population deviation, min, max and trend (last third less first third) of every channel; nulls are skipped."""
    third = max(1, n // 3)
    out = []
    for c in channels:
        late, early = F.avg(F.when(F.col(order) >= n - third, F.col(c))), F.avg(F.when(F.col(order) < third, F.col(c)))
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), (late - early).alias(f"{c}_trend")]
    return bins.groupBy(*keys).agg(*out)


def down_sampled(events: DataFrame, slot_ms: int) -> DataFrame:
    """The last move of every slot of a participant, at the slot's end less one; other events stay."""
    slot = F.floor(F.col("ts") / slot_ms)
    w = Window.partitionBy("participant", slot).orderBy(F.desc("ts"), F.desc("event_id"))
    moves = events.filter("type = 'move'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").withColumn("ts", slot * slot_ms + slot_ms - 1)
    return moves.unionByName(events.filter("type <> 'move'"))


def filled(series: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Carry values forward, then backward; a series without any value is 0."""
    w = Window.partitionBy(*key).orderBy(order)
    on, back = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return series.select(*key, order, *[F.coalesce(F.last(c, ignorenulls=True).over(on), F.first(c, ignorenulls=True).over(back), F.lit(0.0)).alias(c) for c in columns])


def causal_z(rows: DataFrame, columns: list[str], group: str = "grp", order: str = "idx", warm: int = 4) -> DataFrame:
    """z-scores by the mean and variance of strictly earlier rows; the first ``warm`` rows take those of all rows."""
    w = Window.partitionBy(group).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("v", F.var_pop))])
    out = rows.withColumn("rn", F.row_number().over(w)).crossJoin(F.broadcast(whole))  # one row
    for c in columns:
        mean = F.when(F.col("rn") <= warm, F.col(f"m_{c}")).otherwise(F.avg(c).over(past))
        var = F.when(F.col("rn") <= warm, F.col(f"v_{c}")).otherwise(F.var_pop(c).over(past))
        out = out.withColumn(f"{c}_z", (F.col(c) - mean) / F.when(var < 1e-18, 1.0).otherwise(F.sqrt(var)))
    return out.drop("rn", *whole.columns)


def group_z(rows: DataFrame, columns: list[str], group: str = "grp") -> DataFrame:
    """z-scores by the mean and population deviation of the group; deviations under 1e-9 count as 1."""
    w = Window.partitionBy(group)
    for c in columns:
        s = F.stddev_pop(c).over(w)
        rows = rows.withColumn(f"{c}_z", (F.col(c) - F.avg(c).over(w)) / F.when(s < 1e-9, 1.0).otherwise(s))
    return rows
