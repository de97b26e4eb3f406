"""Labels for windows: as-of, band and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, forward: bool = False) -> DataFrame:
    """Each row of ``left`` (key, ts, seq, ...) with the nearest ``right`` (key, ts as r_ts, seq as r_seq) at or before it.

    ``forward`` takes the nearest at or after it. One shuffle by key and one sort: both sides in one stream, the last
    row of the right side carried along. Ties in time: the right row counts as before (forward: after).
    """
    a = left.select(key, "ts", F.lit(1 if not forward else 0).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast("struct<r_ts:bigint,r_seq:bigint>").alias("r"))
    b = right.select(key, "ts", F.lit(0 if not forward else 1).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), F.struct(F.col("ts").cast("bigint").alias("r_ts"), F.col("seq").cast("bigint").alias("r_seq")).alias("r"))
    w = Window.partitionBy(key).orderBy("ts", "side", F.col("r.r_seq"))
    near = F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("near", near).filter("l is not null").select("l.*", "near.r_ts", "near.r_seq")


def as_of_labels(reports: DataFrame, windows: DataFrame, key: str = "participant") -> DataFrame:
    """Every report labels the latest window at or before it; of several reports of a window the last stays."""
    hit = as_of(reports, windows, key).filter("r_ts is not null")
    w = Window.partitionBy(key, "r_seq").orderBy(F.desc("ts"), F.desc("seq"))
    return hit.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(key, F.col("r_seq").alias("window_seq"), F.col("r_ts").alias("window_ts"), F.col("seq").alias("report_seq"), "label")


def band_labels(reports: DataFrame, windows: DataFrame, band_ms: int, key: str = "participant") -> DataFrame:
    """Every report labels all windows of the ``band_ms`` up to it, both ends included; the last report stays.

    An equi-join on the key and a slot of the band's length: a window meets reports of its own slot and the next, so a
    participant with a great share of all rows is spread over slots.
    """
    slot = lambda c: F.floor(F.col(c) / band_ms)
    w_ = windows.select(F.col(key).alias("k"), F.col("ts").alias("window_ts"), F.col("seq").alias("window_seq"))
    w_ = w_.withColumn("slot", F.explode(F.array(slot("window_ts"), slot("window_ts") + 1)))
    r = reports.withColumn("slot", slot("ts"))
    hit = r.join(w_, (r[key] == w_["k"]) & (r["slot"] == w_["slot"]) & (F.col("window_ts") <= F.col("ts")) & (F.col("window_ts") >= F.col("ts") - band_ms))
    w = Window.partitionBy(key, "window_seq").orderBy(F.desc("ts"), F.desc("seq"))
    return hit.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(key, "window_seq", "window_ts", F.col("seq").alias("report_seq"), "label")


def section_windows(windows: DataFrame, completions: DataFrame, cap_ms: int, first_ms: int, key: str = "participant") -> DataFrame:
    """Windows with the first completion at or after them, kept if they lie after its start.

    A section starts at the completion before, but ``cap_ms`` before its end at most, the first one ``first_ms`` before.
    """
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "seq"))
    c = completions.withColumn("start", F.when(before.isNull(), F.col("ts") - first_ms).otherwise(F.greatest(before, F.col("ts") - cap_ms)))
    hit = as_of(windows, completions, key, forward=True).filter("r_ts is not null")
    starts = c.select(F.col(key).alias("k"), F.col("seq").alias("s"), "start")
    return hit.join(starts, (F.col(key) == F.col("k")) & (F.col("r_seq") == F.col("s"))).filter("ts > start").select(key, F.col("seq").alias("window_seq"), F.col("ts").alias("window_ts"), F.col("r_seq").alias("section_seq"), "start")


def unpaired(events: DataFrame, within_ms: int, key: str = "participant") -> DataFrame:
    """(key, ts, event_id, down) without the clicks that take a down: the latest unmatched one of the ``within_ms`` before.

    What a click takes depends on the events of that span before it alone: later downs are taken before earlier ones, so
    nothing older can change which of the span's downs are left. So a participant is cut into slots of that length, and
    each is folded with the slot before it; a row holds two slots of one participant, not all of it.
    """
    slot = F.floor(F.col("ts") / within_ms)
    s = events.select(key, F.explode(F.array(slot, slot + 1)).alias("slot"), "ts", "event_id", "down")
    s = s.groupBy(key, "slot").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "down"))).alias("s"))
    own = lambda t: F.floor(t / within_ms) == F.col("slot")
    kind = "array<struct<ts:bigint,event_id:bigint,down:boolean>>"
    zero = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast(kind).alias("kept"))

    def step(a, r):
        live = F.filter(a["open"], lambda t: r["ts"] - t <= within_ms)
        keep = (r["down"] | (F.size(live) == 0)) & own(r["ts"])
        left = F.when(r["down"], F.array_append(live, r["ts"])).otherwise(F.slice(live, F.lit(1), F.greatest(F.size(live) - 1, F.lit(0))))
        return F.struct(left.alias("open"), F.when(keep, F.array_append(a["kept"], r)).otherwise(a["kept"]).alias("kept"))

    return s.select(key, F.explode(F.aggregate("s", zero, step)["kept"]).alias("e")).select(key, "e.ts", "e.event_id", "e.down")
