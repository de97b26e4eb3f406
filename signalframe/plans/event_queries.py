"""Queries over the interaction log: cleaning, windows, features, label joins, gates and normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gate, labels, windows
from ..sources import views
from ..sources.views import DAY, EV, PRED_BIN
from .registry import query

MONTH = 30 * DAY
ACTIVITY = DAY // 4


def rounded(df, *columns, places=6):
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), places) + F.lit(0.0))
    return df


@query("p02_event_remap", f"WITH {EV} SELECT type, count(*) AS n, count(DISTINCT participant) AS participants FROM ev GROUP BY type")
def p02(spark, d):
    return views.events(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("participant").alias("participants"))


@query("p03_coerced_payload", "SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 10 AS bucket, count(*) AS n, sum(CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NULL THEN 1 ELSE 0 END)::BIGINT AS not_numeric FROM events GROUP BY 1")
def p03(spark, d):
    e = views.table(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    return e.groupBy(F.pmod(k, F.lit(10)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").try_cast("double").isNull()).alias("not_numeric"))


@query("p04_clipped_coordinates", "SELECT event_id, round(least(greatest(value * 40 / 1920.0, 0), 1), 6) AS x, round(least(greatest((value - 60) * 30 / 1080.0, 0), 1), 6) AS y FROM events")
def p04(spark, d):
    clip = lambda v, top: F.round(F.least(F.greatest(v / top, F.lit(0.0)), F.lit(1.0)), 6)
    return views.table(spark, d, "events").select("event_id", clip(F.col("value") * 40, 1920.0).alias("x"), clip((F.col("value") - 60) * 30, 1080.0).alias("y"))


@query("p05_backspace_masking", f"WITH {EV} SELECT participant, count(*) FILTER (key = 'Backspace') AS backspaces, count(*) FILTER (key = 'a') AS others, count(*) FILTER (key = '') AS blank FROM ev GROUP BY participant")
def p05(spark, d):
    key = F.lower(F.trim("key"))
    masked = F.when(key.isin("backspace", "back_space", "\\b", "\b"), "Backspace").when(F.col("key") == "", "").otherwise("a")
    e = views.events(spark, d).withColumn("masked", masked)
    return e.groupBy("participant").agg(F.count_if(F.col("masked") == "Backspace").alias("backspaces"), F.count_if(F.col("masked") == "a").alias("others"), F.count_if(F.col("masked") == "").alias("blank"))


TUMBLED = f"""{EV}, t0 AS (SELECT participant AS pp, min(ts) AS t0 FROM ev GROUP BY 1),
tw AS (SELECT ev.*, (ts - t0) // {{w}} AS window_index, t0 + (ts - t0) // {{w}} * {{w}} AS window_start FROM ev JOIN t0 ON participant = pp)"""


@query("w01_tumbling_windows", f"WITH {TUMBLED.format(w=DAY)} SELECT participant, window_index, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM tw GROUP BY ALL")
def w01(spark, d):
    return windows.tumbling(views.events(spark, d), DAY).groupBy("participant", "window_index").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p10_min_events_windows", f"WITH {TUMBLED.format(w=DAY)} SELECT participant, window_index, count(*) AS n FROM tw GROUP BY ALL HAVING count(*) >= 5")
def p10(spark, d):
    return windows.tumbling(views.events(spark, d), DAY).groupBy("participant", "window_index").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("a01_window_aggregates", f"WITH {TUMBLED.format(w=DAY)} SELECT participant, window_index, round(max(value), 6) AS peak, round(avg(value), 6) AS mean, count(*) FILTER (type IS NOT NULL) AS n, max(value) >= 80 AS label FROM tw GROUP BY ALL")
def a01(spark, d):
    g = windows.tumbling(views.events(spark, d), DAY).groupBy("participant", "window_index")
    return rounded(g.agg(F.max("value").alias("peak"), F.avg("value").alias("mean"), F.count("type").alias("n"), (F.max("value") >= 80).alias("label")), "peak", "mean")


@query("a03_multi_state_label", f"WITH {TUMBLED.format(w=DAY)}, m AS (SELECT participant, window_index, coalesce(max(value) FILTER (type = 'click'), 0) AS a, coalesce(max(value) FILTER (type = 'key'), 0) AS b, coalesce(max(value) FILTER (type = 'scroll'), 0) AS c FROM tw GROUP BY ALL) SELECT participant, window_index, CASE WHEN greatest(a, b, c) < 60 THEN 0 WHEN a = greatest(a, b, c) THEN 1 WHEN b = greatest(a, b, c) THEN 2 ELSE 3 END AS state FROM m")
def a03(spark, d):
    peak = lambda t: F.coalesce(F.max(F.when(F.col("type") == t, F.col("value"))), F.lit(0.0))
    g = windows.tumbling(views.events(spark, d), DAY).groupBy("participant", "window_index").agg(F.array(peak("click"), peak("key"), peak("scroll")).alias("m"))
    return g.select("participant", "window_index", F.when(F.array_max("m") < 60, 0).otherwise(F.array_position("m", F.array_max("m"))).cast("int").alias("state"))


@query("a05_filled_bins", f"""WITH {TUMBLED.format(w=MONTH)}, b AS (SELECT participant, window_index, (ts - window_start) // {DAY} AS bin, avg(value) FILTER (type = 'click') AS v FROM tw GROUP BY ALL),
g AS (SELECT participant, window_index, unnest(range(30)) AS bin FROM (SELECT DISTINCT participant, window_index FROM tw)),
j AS (SELECT g.*, v FROM g LEFT JOIN b USING (participant, window_index, bin))
SELECT participant, window_index, bin, round(coalesce(last_value(v IGNORE NULLS) OVER w1, first_value(v IGNORE NULLS) OVER w2, 0), 6) AS v FROM j
WINDOW w1 AS (PARTITION BY participant, window_index ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY participant, window_index ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def a05(spark, d):
    e = windows.tumbling(views.events(spark, d), MONTH)
    b = e.groupBy("participant", "window_index", F.floor((F.col("ts") - F.col("window_start")) / DAY).alias("bin")).agg(F.avg(F.when(F.col("type") == "click", F.col("value"))).alias("v"))
    grid = e.select("participant", "window_index").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    return rounded(windows.filled(grid.join(b, ["participant", "window_index", "bin"], "left"), ["participant", "window_index"], "bin", ["v"]), "v")


FEATURE_SQL = f"""{TUMBLED.format(w=MONTH)},
e AS (SELECT *, (ts - window_start) // {DAY} AS bin, type IN ('move', 'click', 'key', 'scroll') AS inp FROM tw),
g1 AS (SELECT *, (ts - lag(ts) OVER w) / CAST(1000 AS DOUBLE) AS gap, lag(x) OVER w AS px, lag(y) OVER w AS py, window_start + (bin + 1) * {DAY} AS hi,
       CASE WHEN inp THEN lead(ts) OVER (PARTITION BY participant, window_index, bin, inp ORDER BY ts, event_id) END AS nxt, CASE WHEN type = 'scroll' THEN sign(dy) END AS sg
       FROM e WINDOW w AS (PARTITION BY participant, window_index, bin, type ORDER BY ts, event_id)),
g2 AS (SELECT *, CASE WHEN type = 'move' THEN sqrt(pow(x - px, 2) + pow(y - py, 2)) / greatest(gap, 0.001) END AS vel,
       last_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (PARTITION BY participant, window_index, bin, type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS psg FROM g1),
g3 AS (SELECT *, coalesce(vel < 0.05, false) AS slow, coalesce(sg < 0, false) AS back FROM g2),
g4 AS (SELECT *, slow AND NOT coalesce(lag(slow) OVER w, false) AS s0, back AND NOT coalesce(lag(back) OVER w, false) AS b0 FROM g3 WINDOW w AS (PARTITION BY participant, window_index, bin, type ORDER BY ts, event_id)),
ag AS (SELECT participant, window_index, bin, avg(vel) AS mouse_velocity_mean, stddev_pop(vel) AS mouse_velocity_std, count(*) FILTER (type = 'click') AS click_count,
       count(*) FILTER (slow) / nullif(count(*) FILTER (s0), 0) / CAST(10 AS DOUBLE) AS hover_dwell_mean, count(*) FILTER (type = 'key') AS keystroke_count,
       stddev_pop(gap) FILTER (type = 'key') AS typing_rhythm_std, avg(CAST(key = 'Backspace' AS INTEGER)) FILTER (type = 'key') AS backspace_pct, count(*) FILTER (type = 'key' AND gap > 0.5) AS pause_count,
       avg(abs(dy)) FILTER (type = 'scroll') AS scroll_velocity_mean, count(*) FILTER (sg <> 0 AND sg <> psg) AS scroll_direction_changes, count(*) FILTER (b0) AS scroll_back_runs,
       greatest(0, 1 - count(*) FILTER (type = 'scroll') / CAST(10 AS DOUBLE)) AS scroll_inactivity_pct,
       least(1, greatest(0, 1 - coalesce(sum(least({ACTIVITY}, coalesce(nxt, hi) - ts, hi - ts)) FILTER (inp), 0) / CAST({DAY} AS DOUBLE))) AS idle_time_pct, count(*) FILTER (type = 'visibility') AS tab_switch_count
       FROM g4 GROUP BY ALL),
en AS (SELECT participant, window_index, bin, CASE WHEN sum(n) >= 2 THEN -sum(n / t * log2(n / t)) ELSE 0 END AS mouse_entropy FROM (
       SELECT participant, window_index, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY participant, window_index, bin) AS t FROM e WHERE type = 'move' GROUP BY participant, window_index, bin, least(floor(x * 6), 5), least(floor(y * 6), 5)) GROUP BY ALL),
vi AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY participant, window_index ORDER BY ts, event_id), window_start + {MONTH}) AS til FROM e WHERE type = 'visibility'),
gr AS (SELECT participant, window_index, window_start, unnest(range(30)) AS bin FROM (SELECT DISTINCT participant, window_index, window_start FROM e)),
bl AS (SELECT gr.participant, gr.window_index, gr.bin, sum(least(til, gr.window_start + (gr.bin + 1) * {DAY}) - greatest(ts, gr.window_start + gr.bin * {DAY})) / CAST({DAY} AS DOUBLE) AS blur_time_pct
       FROM gr JOIN vi ON gr.participant = vi.participant AND gr.window_index = vi.window_index AND dy > 0 AND ts < gr.window_start + (gr.bin + 1) * {DAY} AND til > gr.window_start + gr.bin * {DAY} GROUP BY ALL),
fe AS (SELECT gr.participant, gr.window_index, gr.bin, """ + ", ".join(f"round(coalesce({f}, {windows.QUIET.get(f, 0.0)}), 6) + CAST(0 AS DOUBLE) AS {f}" for f in windows.FEATURES) + """
       FROM gr LEFT JOIN ag USING (participant, window_index, bin) LEFT JOIN en USING (participant, window_index, bin) LEFT JOIN bl USING (participant, window_index, bin))"""


def features(spark, d):
    return windows.bin_features(views.events(spark, d), MONTH, DAY, ACTIVITY)


@query("w12_window_features", f"WITH {FEATURE_SQL} SELECT participant, window_index, bin, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in windows.FEATURES) + " FROM fe")
def w12(spark, d):
    return rounded(features(spark, d), *windows.FEATURES)


CHANNELS = ["click_count", "keystroke_count", "scroll_back_runs", "scroll_inactivity_pct", "idle_time_pct", "tab_switch_count"]


@query("a06_five_statistics", f"WITH {FEATURE_SQL} SELECT participant, window_index, " + ", ".join(f"round(avg({c}), 8) AS {c}_mean, round(stddev_pop({c}), 8) AS {c}_std, round(min({c}), 8) AS {c}_min, round(max({c}), 8) AS {c}_max, round(avg({c}) FILTER (bin >= 20) - avg({c}) FILTER (bin < 10), 8) + CAST(0 AS DOUBLE) AS {c}_trend" for c in CHANNELS) + " FROM fe GROUP BY ALL")
def a06(spark, d):
    out = windows.five_statistics(rounded(features(spark, d), *CHANNELS), CHANNELS, ["participant", "window_index"], "bin", 30)
    return rounded(out, *[c for c in out.columns if c not in ("participant", "window_index")], places=8)


@query("w10_down_sampled_moves", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY participant, ts // {DAY} ORDER BY ts DESC, event_id DESC) AS rn FROM ev WHERE type = 'move') SELECT participant, event_id, ts // {DAY} * {DAY} + {DAY - 1} AS ts FROM r WHERE rn = 1")
def w10(spark, d):
    return windows.down_sampled(views.events(spark, d), DAY).filter("type = 'move'").select("participant", "event_id", "ts")


@query("w13_scroll_differences", f"WITH {EV} SELECT participant, event_id, round(coalesce(value - lag(value) OVER (PARTITION BY participant ORDER BY ts, event_id), 0), 6) AS dy FROM ev WHERE type = 'scroll'")
def w13(spark, d):
    w = Window.partitionBy("participant").orderBy("ts", "event_id")
    return rounded(views.events(spark, d).filter("type = 'scroll'").select("participant", "event_id", F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)).alias("dy")), "dy")


@query("w14_rebuilt_timeline", f"WITH {EV} SELECT participant, event_id, round(coalesce(sum(least(greatest(value * 100, 0), 5000)) OVER (PARTITION BY participant ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS t FROM ev")
def w14(spark, d):
    w = Window.partitionBy("participant").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.least(F.greatest(F.col("value") * 100, F.lit(0.0)), F.lit(5000.0))
    return rounded(views.events(spark, d).select("participant", "event_id", F.coalesce(F.sum(gap).over(w), F.lit(0.0)).alias("t")), "t", places=3)


@query("w16_causal_z", f"""WITH {PRED_BIN}, s AS (SELECT avg(p) AS m, var_pop(p) AS v FROM pb),
c AS (SELECT grp, idx, p, row_number() OVER (PARTITION BY grp ORDER BY idx) AS rn, avg(p) OVER w AS pm, var_pop(p) OVER w AS pv FROM pb WINDOW w AS (PARTITION BY grp ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT grp, idx, p, CASE WHEN rn <= 4 THEN m ELSE pm END AS mu, CASE WHEN rn <= 4 THEN v ELSE pv END AS va FROM c, s)
SELECT grp, idx, round((p - mu) / CASE WHEN va < 1e-18 THEN 1 ELSE sqrt(va) END, 6) AS p_z FROM z""")
def w16(spark, d):
    return rounded(windows.causal_z(views.binary_predictions(spark, d).select("grp", "idx", "p"), ["p"]).select("grp", "idx", "p_z"), "p_z")


@query("n02_group_z", f"WITH {PRED_BIN}, s AS (SELECT grp, avg(p) AS m, stddev_pop(p) AS sd FROM pb GROUP BY grp) SELECT grp, idx, round((p - m) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END, 6) AS p_z FROM pb JOIN s USING (grp)")
def n02(spark, d):
    return rounded(windows.group_z(views.binary_predictions(spark, d), ["p"]).select("grp", "idx", "p_z"), "p_z")


@query("n01_train_z", f"WITH {PRED_BIN}, s AS (SELECT avg(p) AS m, stddev_pop(p) AS sd FROM pb WHERE grp % 10 < 7) SELECT id, round((p - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END, 6) AS p_z FROM pb, s")
def n01(spark, d):
    pb = views.binary_predictions(spark, d)
    s = pb.filter("grp % 10 < 7").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("sd"))
    return rounded(pb.crossJoin(F.broadcast(s)).select("id", ((F.col("p") - F.col("m")) / F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd"))).alias("p_z")), "p_z")


@query("w17_away_runs", f"""WITH {PRED_BIN}, t AS (SELECT unnest([0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold),
f AS (SELECT grp, threshold, idx, p > threshold AS away, coalesce(lag(p > threshold) OVER (PARTITION BY grp, threshold ORDER BY idx), p > threshold) AS was FROM pb, t),
r AS (SELECT *, idx - row_number() OVER (PARTITION BY grp, threshold, away ORDER BY idx) AS island FROM f),
l AS (SELECT grp, threshold, island, count(*) AS n FROM r WHERE away GROUP BY ALL)
SELECT f.grp, f.threshold, round(avg(CAST(away AS INTEGER)), 6) AS share, count(*) FILTER (away AND NOT was) AS entered, coalesce(max(longest), 0) AS longest
FROM f LEFT JOIN (SELECT grp, threshold, max(n) AS longest FROM l GROUP BY ALL) m ON f.grp = m.grp AND f.threshold = m.threshold GROUP BY f.grp, f.threshold""")
def w17(spark, d):
    pb = views.binary_predictions(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.4, 0.5, 0.6, 0.7)])))
    w = Window.partitionBy("grp", "threshold").orderBy("idx")
    f = pb.withColumn("away", F.col("p") > F.col("threshold"))
    f = f.withColumn("was", F.coalesce(F.lag("away").over(w), F.col("away"))).withColumn("island", F.sum((F.col("away") != F.coalesce(F.lag("away").over(w), ~F.col("away"))).cast("int")).over(w))
    runs = f.groupBy("grp", "threshold", "island").agg(F.first("away").alias("away"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("away") & ~F.col("was")).alias("entered"))
    out = runs.groupBy("grp", "threshold").agg((F.sum(F.when(F.col("away"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.sum("entered").alias("entered"), F.coalesce(F.max(F.when(F.col("away"), F.col("n"))), F.lit(0)).alias("longest"))
    return rounded(out, "share")


@query("w22_ring_buffer", f"WITH {PRED_BIN} SELECT grp, idx, round(avg(p) OVER (PARTITION BY grp ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 10) AS level FROM pb QUALIFY (idx + 1) % 4 = 0")
def w22(spark, d):
    w = Window.partitionBy("grp").orderBy("idx").rowsBetween(-15, 0)
    return rounded(views.binary_predictions(spark, d).withColumn("level", F.avg("p").over(w)).filter("(idx + 1) % 4 = 0").select("grp", "idx", "level"), "level", places=10)


@query("w21_even_subsample", f"WITH {PRED_BIN}, n AS (SELECT grp, count(*) AS n FROM pb GROUP BY grp), s AS (SELECT grp, k, CAST(floor(k * (n - 1) / CAST(15 AS DOUBLE)) AS BIGINT) AS idx FROM n, range(16) t(k)) SELECT grp, k, id FROM s JOIN pb USING (grp, idx)")
def w21(spark, d):
    pb = views.binary_predictions(spark, d)
    s = pb.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))).withColumn("idx", F.floor(F.col("k") * (F.col("n") - 1) / 15.0))
    return s.join(pb, ["grp", "idx"]).select("grp", "k", "id")


@query("w23_motion", f"WITH {EV} SELECT participant, event_id, round(CASE WHEN lag(type) OVER w IS NOT DISTINCT FROM 'visibility' OR lag(ts) OVER w IS NULL THEN 0 ELSE sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) END, 6) AS motion FROM ev WINDOW w AS (PARTITION BY participant ORDER BY ts, event_id)")
def w23(spark, d):
    w = Window.partitionBy("participant").orderBy("ts", "event_id")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    lost = F.lag("ts").over(w).isNull() | F.coalesce(F.lag("type").over(w) == "visibility", F.lit(False))
    return rounded(views.events(spark, d).select("participant", "event_id", F.when(lost, 0.0).otherwise(step).alias("motion")), "motion")


def label_sides(spark, d):
    e = views.events(spark, d)
    reports = e.filter("type = 'key'").select("participant", "ts", F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(4)).alias("label"))
    return reports, e.filter("type = 'move'").select("participant", "ts", F.col("event_id").alias("seq"))


SIDES = f"{EV}, rep AS (SELECT participant, ts, event_id AS seq, event_id % 4 AS label FROM ev WHERE type = 'key'), win AS (SELECT participant, ts AS window_ts, event_id AS window_seq FROM ev WHERE type = 'move'), com AS (SELECT participant, ts, event_id AS seq FROM ev WHERE type = 'scroll')"


@query("j01_as_of_labels", f"WITH {SIDES}, h AS (SELECT r.*, window_seq, window_ts FROM rep r JOIN win w ON r.participant = w.participant AND window_ts <= r.ts QUALIFY row_number() OVER (PARTITION BY r.seq ORDER BY window_ts DESC, window_seq DESC) = 1) SELECT participant, window_seq, window_ts, seq AS report_seq, label FROM h QUALIFY row_number() OVER (PARTITION BY participant, window_seq ORDER BY ts DESC, seq DESC) = 1")
def j01(spark, d):
    return labels.as_of_labels(*label_sides(spark, d))


@query("j02_band_labels", f"WITH {SIDES} SELECT r.participant, window_seq, window_ts, seq AS report_seq, label FROM rep r JOIN win w ON r.participant = w.participant AND window_ts BETWEEN r.ts - {2 * DAY} AND r.ts QUALIFY row_number() OVER (PARTITION BY r.participant, window_seq ORDER BY r.ts DESC, seq DESC) = 1")
def j02(spark, d):
    return labels.band_labels(*label_sides(spark, d), 2 * DAY)


@query("j03_section_windows", f"""WITH {SIDES}, c AS (SELECT *, lag(ts) OVER (PARTITION BY participant ORDER BY ts, seq) AS before FROM com), s AS (SELECT participant, ts, seq, CASE WHEN before IS NULL THEN ts - {DAY} ELSE greatest(before, ts - {2 * DAY}) END AS start FROM c),
h AS (SELECT w.participant, window_seq, window_ts, s.seq AS section_seq, start FROM win w JOIN s ON w.participant = s.participant AND s.ts >= window_ts QUALIFY row_number() OVER (PARTITION BY window_seq ORDER BY s.ts, s.seq) = 1) SELECT * FROM h WHERE window_ts > start""")
def j03(spark, d):
    e = views.events(spark, d)
    done = e.filter("type = 'scroll'").select("participant", "ts", F.col("event_id").alias("seq"))
    return labels.section_windows(label_sides(spark, d)[1], done, 2 * DAY, DAY)


@query("j04_report_sections", f"WITH {SIDES} SELECT r.participant, r.seq AS report_seq, c.seq AS section_seq FROM rep r JOIN com c ON r.participant = c.participant AND c.ts <= r.ts QUALIFY row_number() OVER (PARTITION BY r.seq ORDER BY c.ts DESC, c.seq DESC) = 1")
def j04(spark, d):
    reports, _ = label_sides(spark, d)
    done = views.events(spark, d).filter("type = 'scroll'").select("participant", "ts", F.col("event_id").alias("seq"))
    return labels.as_of(reports, done, "participant").filter("r_ts is not null").select("participant", F.col("seq").alias("report_seq"), F.col("r_seq").alias("section_seq"))


FLOORS = [round(0.5 + 0.05 * k, 2) for k in range(9)]
GATE_SQL = """{pred}, fl AS (SELECT unnest({floors})::DOUBLE AS floor), rows_ AS (SELECT pb.*, floor, {ok} AS ok FROM pb, fl),
RECURSIVE_PART"""


def offline_sql(ok: str, floors: list[float], tail: str) -> str:
    return f"""WITH RECURSIVE {PRED_BIN}, r0 AS MATERIALIZED (SELECT grp, idx, p, y, {ok} AS ok FROM pb), fl AS (SELECT unnest({floors})::DOUBLE AS floor),
g AS (SELECT grp, floor, CAST(-1 AS BIGINT) AS idx, 0 AS streak, 0 AS cool, false AS fire, 0 AS hit FROM (SELECT DISTINCT grp FROM r0), fl
  UNION ALL
  SELECT grp, floor, idx, CASE WHEN fire THEN 0 ELSE streak END, CASE WHEN fire THEN 3 WHEN cool > 0 THEN cool - 1 ELSE 0 END, fire, CASE WHEN fire AND y = 1 THEN 1 ELSE 0 END
  FROM (SELECT *, ok AND cool = 0 AND p >= floor AND streak >= 2 AS fire FROM (
    SELECT g.grp, g.floor, r0.idx, r0.p, r0.y, r0.ok, g.cool, CASE WHEN NOT r0.ok THEN g.streak WHEN r0.p >= g.floor THEN g.streak + 1 ELSE 0 END AS streak FROM g JOIN r0 ON g.grp = r0.grp AND r0.idx = g.idx + 1)))
{tail}"""


SWEEP_TAIL = "SELECT floor, true AS persistence, true AS cooling, count(*) FILTER (fire) AS offers, sum(hit)::BIGINT AS correct, count(*) AS readings, round(sum(hit) / nullif(count(*) FILTER (fire), 0), 6) AS precision FROM g WHERE idx >= 0 GROUP BY floor"


@query("g01_offline_gate_sweep", offline_sql("true", FLOORS, SWEEP_TAIL))
def g01(spark, d):
    return rounded(gate.swept(gate.replay(views.binary_predictions(spark, d), FLOORS)), "precision")


@query("g03_masked_gate_sweep", offline_sql("(idx * 7 + grp) % 5 <> 0", FLOORS, SWEEP_TAIL))
def g03(spark, d):
    rows = views.binary_predictions(spark, d).withColumn("ok", F.pmod(F.col("idx") * 7 + F.col("grp"), F.lit(5)) != 0)
    return rounded(gate.swept(gate.replay(rows, FLOORS)), "precision")


@query("g05_offer_positions", offline_sql("true", [0.6], "SELECT grp, idx FROM g WHERE fire"))
def g05(spark, d):
    return gate.offers(views.binary_predictions(spark, d), [0.6]).select("grp", "idx")


def deployed_sql(ok: str, floors: list[float], variants: list[tuple[bool, bool]], tail: str) -> str:
    v = ", ".join(f"({str(p).lower()}, {str(c).lower()})" for p, c in variants)
    return f"""WITH RECURSIVE {PRED_BIN}, r0 AS MATERIALIZED (SELECT grp, idx, p, y, {ok} AS ok FROM pb), fl AS (SELECT unnest({floors})::DOUBLE AS floor), va(persistence, cooling) AS (VALUES {v}),
g AS (SELECT grp, floor, persistence, cooling, CAST(-1 AS BIGINT) AS idx, -1 AS state, CAST(NULL AS BIGINT) AS last, false AS fire, 0 AS hit FROM (SELECT DISTINCT grp FROM r0), fl, va
  UNION ALL
  SELECT grp, floor, persistence, cooling, idx, CASE WHEN ok THEN now ELSE state END, CASE WHEN fire THEN idx ELSE last END, fire, CASE WHEN fire AND y = 1 THEN 1 ELSE 0 END
  FROM (SELECT *, ok AND now = 1 AND p >= floor AND (NOT persistence OR state = 1) AND (NOT cooling OR last IS NULL OR idx - last >= 3) AS fire FROM (
    SELECT g.grp, g.floor, g.persistence, g.cooling, r0.idx, r0.p, r0.y, r0.ok, g.state, g.last, CASE WHEN r0.p >= 0.5 THEN 1 ELSE 0 END AS now FROM g JOIN r0 ON g.grp = r0.grp AND r0.idx = g.idx + 1)))
{tail}"""


VARIANT_TAIL = "SELECT floor, persistence, cooling, count(*) FILTER (fire) AS offers, sum(hit)::BIGINT AS correct, count(*) AS readings, round(sum(hit) / nullif(count(*) FILTER (fire), 0), 6) AS precision FROM g WHERE idx >= 0 GROUP BY floor, persistence, cooling"


@query("g02_deployed_gate_sweep", deployed_sql("true", FLOORS, [(True, True)], VARIANT_TAIL))
def g02(spark, d):
    return rounded(gate.swept(gate.replay(views.binary_predictions(spark, d), FLOORS, "deployed")), "precision")


ALL_VARIANTS = [(True, True), (True, False), (False, True), (False, False)]


@query("g04_gate_ablation", deployed_sql("(idx * 7 + grp) % 5 <> 0", [0.6, 0.7], ALL_VARIANTS, VARIANT_TAIL))
def g04(spark, d):
    rows = views.binary_predictions(spark, d).withColumn("ok", F.pmod(F.col("idx") * 7 + F.col("grp"), F.lit(5)) != 0)
    return rounded(gate.swept(gate.replay(rows, [0.6, 0.7], "deployed", variants=ALL_VARIANTS)), "precision")


@query("w18_offer_spacing", deployed_sql("true", [0.6], [(True, False)], """, o AS (SELECT grp, idx, idx - lag(idx) OVER (PARTITION BY grp ORDER BY idx) AS gap, idx - row_number() OVER (PARTITION BY grp ORDER BY idx) AS island FROM g WHERE fire),
n AS (SELECT grp, island, count(*) AS n FROM o GROUP BY ALL) SELECT o.grp, count(*) AS offers, round(avg(CAST(coalesce(gap < 3, false) AS INTEGER)), 6) AS close_share, max(m.longest) AS longest FROM o JOIN (SELECT grp, max(n) AS longest FROM n GROUP BY grp) m ON o.grp = m.grp GROUP BY o.grp"""))
def w18(spark, d):
    o = gate.offers(views.binary_predictions(spark, d), [0.6], "deployed", variants=[(True, False)]).select("grp", "idx")
    w = Window.partitionBy("grp").orderBy("idx")
    o = o.withColumn("close", F.coalesce(F.col("idx") - F.lag("idx").over(w) < 3, F.lit(False))).withColumn("island", F.col("idx") - F.row_number().over(w))
    runs = o.groupBy("grp", "island").agg(F.count(F.lit(1)).alias("n"), F.count_if("close").alias("close"))
    return rounded(runs.groupBy("grp").agg(F.sum("n").alias("offers"), (F.sum("close") / F.sum("n")).alias("close_share"), F.max("n").alias("longest")), "close_share")


SELECT_TAIL = f", s AS ({SWEEP_TAIL.replace('true AS persistence, true AS cooling, ', '')})"


@query("o06_floor_selection", offline_sql("true", FLOORS, SELECT_TAIL + " SELECT coalesce(min(floor) FILTER (precision >= 0.25 AND offers >= 20), arg_max(floor, precision)) AS floor, count(*) AS candidates FROM s"))
def o06(spark, d):
    s = rounded(gate.swept(gate.replay(views.binary_predictions(spark, d), FLOORS)), "precision")
    return s.agg(F.coalesce(F.min(F.when((F.col("precision") >= 0.25) & (F.col("offers") >= 20), F.col("floor"))), F.max_by("floor", "precision")).alias("floor"), F.count(F.lit(1)).alias("candidates"))


@query("o05_matched_floor", offline_sql("true", FLOORS, SELECT_TAIL + " SELECT floor, offers FROM s ORDER BY abs(offers - 300), floor DESC LIMIT 1"))
def o05(spark, d):
    s = gate.swept(gate.replay(views.binary_predictions(spark, d), FLOORS))
    best = F.min_by(F.struct("floor", "offers"), F.struct(F.abs(F.col("offers") - 300), -F.col("floor")))
    return s.agg(best.alias("b")).select("b.*")


PAIRING = f"""WITH RECURSIVE {EV}, c AS (SELECT participant, ts, event_id, event_id % 2 = 0 AS down, row_number() OVER (PARTITION BY participant ORDER BY ts, event_id) AS k FROM ev WHERE type = 'click'),
z AS (SELECT DISTINCT participant, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, false AS keep, []::BIGINT[] AS open FROM c UNION ALL
  SELECT participant, k, event_id, down OR len(live) = 0, CASE WHEN down THEN list_append(open, ts) ELSE live[1:-2] END FROM (SELECT c.participant, c.k, c.event_id, c.ts, c.down, z.open, list_filter(z.open, lambda t: c.ts - t <= {DAY}) AS live FROM z JOIN c ON c.participant = z.participant AND c.k = z.k + 1))
SELECT participant, event_id FROM z WHERE keep"""


@query("g08_click_pairing", PAIRING)
def g08(spark, d):
    """Downs (even event ids) and clicks (odd) of a participant: a click takes the latest unmatched down within a day."""
    e = views.events(spark, d).filter("type = 'click'").select("participant", "ts", "event_id", (F.pmod("event_id", F.lit(2)) == 0).alias("down"))
    return labels.unpaired(e, DAY).select("participant", "event_id")


@query("j15_dense_domain", f"WITH {EV}, p AS (SELECT DISTINCT participant FROM ev), t AS (SELECT DISTINCT type FROM ev) SELECT p.participant, t.type, count(ev.event_id) AS n FROM p CROSS JOIN t LEFT JOIN ev ON ev.participant = p.participant AND ev.type = t.type GROUP BY ALL")
def j15(spark, d):
    e = views.events(spark, d)
    kinds = F.array(*[F.lit(k) for k in views.EVENT_KINDS.values()])
    grid = e.select("participant").distinct().withColumn("type", F.explode(kinds))
    return grid.join(e.groupBy("participant", "type").agg(F.count(F.lit(1)).alias("n")), ["participant", "type"], "left").na.fill(0, ["n"])


@query("a17_daily_deliveries", "SELECT CAST(ts AS DATE)::VARCHAR AS day, CASE WHEN ts < TIMESTAMP '2023-01-15' THEN 'before' ELSE 'since' END AS period, grouping_id(CAST(ts AS DATE), CASE WHEN ts < TIMESTAMP '2023-01-15' THEN 'before' ELSE 'since' END) AS level, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS generated FROM events GROUP BY GROUPING SETS ((CAST(ts AS DATE)), (CASE WHEN ts < TIMESTAMP '2023-01-15' THEN 'before' ELSE 'since' END))")
def a17(spark, d):
    e = views.table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string")).withColumn("period", F.when(F.col("ts") < F.lit("2023-01-15").cast("timestamp_ntz"), "before").otherwise("since"))
    g = e.groupingSets([["day"], ["period"]], "day", "period")
    return g.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("generated"))


@query("a16_event_summary", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () >= 0.8 AS dominant FROM events GROUP BY event_type")
def a16(spark, d):
    g = views.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("sessions"))
    share = F.col("n") / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rounded(g.withColumn("share", share).withColumn("dominant", share >= 0.8), "share")


@query("a18_first_occurrence", f"WITH {EV} SELECT participant, type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY ALL")
def a18(spark, d):
    return views.events(spark, d).groupBy("participant", "type").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("a26_distribution_shift", f"WITH {EV} SELECT type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS top FROM ev GROUP BY type")
def a26(spark, d):
    return rounded(views.events(spark, d).groupBy("type").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.99)).alias("p99"), F.max("value").alias("top")), "mean", "p99", "top")
