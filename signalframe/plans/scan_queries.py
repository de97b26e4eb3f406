"""Queries over labelled window scans: annotations and channels beside the events of a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labelled_scan as scan
from ..sources import views
from ..sources.views import DAY, EV
from .event_queries import rounded
from .registry import query

SPAN, SLOT = 2 * DAY, DAY // 2
MANUAL, CHANNELS = ["confusion", "boredom", "frustration"], ["neutral", "joy"]
RAW = f"""{EV}, raw AS (SELECT participant, event_id, ts, CASE WHEN type <> 'visibility' THEN type END AS type, event_id % 2 = 0 AS down, CASE WHEN type = 'visibility' THEN value END AS confusion, CASE WHEN event_id % 7 = 0 THEN value END AS boredom, CASE WHEN event_id % 7 = 3 THEN value END AS frustration,
  CASE WHEN event_id % 3 = 0 THEN value END AS neutral, CASE WHEN event_id % 4 = 1 THEN value END AS joy FROM ev),
pl AS (SELECT raw.*, (ts - min(ts) OVER (PARTITION BY participant)) // {SPAN} AS window_index FROM raw)"""
COLUMNS = "max(coalesce(confusion, 0)) AS max_confusion, max(coalesce(boredom, 0)) AS max_boredom, max(coalesce(frustration, 0)) AS max_frustration, avg(neutral) AS neutral, avg(joy) AS joy"
NATIVE = f"WITH {RAW}, wi AS (SELECT participant, window_index, count(type) AS n_events, {COLUMNS} FROM pl GROUP BY participant, window_index HAVING count(type) >= 3)"


def annotated(spark, d):
    """The events as a log with annotations: rows of a kind that no feature knows carry confusion, some others more."""
    e = views.events(spark, d)
    some = lambda m, k: F.when(F.col("event_id") % m == k, F.col("value"))
    return e.select(
        "participant", "event_id", "ts", F.when(F.col("type") != "visibility", F.col("type")).alias("type"), (F.col("event_id") % 2 == 0).alias("down"), F.when(F.col("type") == "visibility", F.col("value")).alias("confusion"),
        some(7, 0).alias("boredom"), some(7, 3).alias("frustration"), some(3, 0).alias("neutral"), some(4, 1).alias("joy"),
    )


def native(spark, d):
    return scan.labelled_windows(annotated(spark, d), SPAN, F.col("type").isNotNull(), MANUAL, CHANNELS, 3)


@query("s02_labelled_windows", NATIVE + " SELECT participant, window_index, n_events, round(neutral, 6) AS neutral, round(joy, 6) AS joy, CAST(max_confusion >= 60 AS INTEGER) AS label FROM wi WHERE neutral IS NOT NULL AND joy IS NOT NULL")
def s02(spark, d):
    """Windows with the label that people gave and the channels beside, of those whose channels are all there."""
    out = scan.any_annotation(scan.with_all(native(spark, d), CHANNELS), "max_confusion", 60)
    return rounded(out.select("participant", "window_index", "n_events", *CHANNELS, "label"), *CHANNELS)


@query("s03_multi_state_windows", NATIVE + " SELECT participant, window_index, CASE WHEN greatest(max_confusion, max_boredom, max_frustration) < 60 THEN 0 WHEN max_confusion = greatest(max_confusion, max_boredom, max_frustration) THEN 1 WHEN max_boredom = greatest(max_confusion, max_boredom, max_frustration) THEN 2 ELSE 3 END AS label FROM wi")
def s03(spark, d):
    return scan.state(native(spark, d), [f"max_{m}" for m in MANUAL], 60).select("participant", "window_index", "label")


@query("s04_platform_windows", f"""WITH RECURSIVE {RAW}, mo AS (SELECT participant, event_id FROM raw WHERE type = 'move' QUALIFY row_number() OVER (PARTITION BY participant, ts // {SLOT} ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT participant, ts, event_id, down, row_number() OVER (PARTITION BY participant ORDER BY ts, event_id) AS k FROM raw WHERE type = 'click'),
z AS (SELECT DISTINCT participant, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, false AS keep, []::BIGINT[] AS open FROM c UNION ALL
  SELECT participant, k, event_id, down OR len(live) = 0, CASE WHEN down THEN list_append(open, ts) ELSE live[1:-2] END FROM (SELECT c.participant, c.k, c.event_id, c.ts, c.down, z.open, list_filter(z.open, lambda t: c.ts - t <= {DAY}) AS live FROM z JOIN c ON c.participant = z.participant AND c.k = z.k + 1)),
se AS (SELECT participant, event_id FROM mo UNION ALL SELECT participant, event_id FROM z WHERE keep UNION ALL SELECT participant, event_id FROM raw WHERE type IN ('key', 'scroll')),
wi AS (SELECT pl.participant, window_index, count(se.event_id) AS n_events, {COLUMNS} FROM pl LEFT JOIN se ON pl.participant = se.participant AND pl.event_id = se.event_id GROUP BY pl.participant, window_index HAVING count(se.event_id) >= 1)
SELECT participant, window_index, n_events, CAST(max_confusion >= 60 AS INTEGER) AS label FROM wi""")
def s04(spark, d):
    """The windows as a platform would count them: moves once in half a day, clicks without those that a down answers."""
    out = scan.platform_windows(annotated(spark, d), SPAN, SLOT, DAY, MANUAL, CHANNELS)
    return scan.any_annotation(out, "max_confusion", 60).select("participant", "window_index", "n_events", "label")


@query("p18_exclusive_labels", NATIVE + " SELECT participant, window_index, CAST(max_confusion >= 60 AS INTEGER) AS label FROM wi WHERE max_confusion >= 60 OR max_confusion = 0")
def p18(spark, d):
    return scan.exclusive(native(spark, d), "max_confusion", 60).select("participant", "window_index", "label")


@query("a04_proxy_labels", NATIVE + " SELECT participant, window_index, coalesce(CAST(neutral < 40 AS INTEGER), 0) AS label FROM wi")
def a04(spark, d):
    return scan.proxy(native(spark, d), "neutral", 40).select("participant", "window_index", "label")
