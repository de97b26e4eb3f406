"""Live forms give the batch's rows over several micro-batches, after a restart, and with rows out of order."""

import random

import pytest
from pyspark.sql import functions as F

from signalframe.operators import windows
from signalframe.streaming import live

SCHEMA = "grp long, idx long, ts timestamp, p double"
END = 10_000_000


def files(spark, tmp_path, parts):
    """One file a micro-batch; the last pushes the watermark past all rows, with a group of its own."""
    for part in [*parts, [(99, 0, END, 0.0)], [(99, 1, END + 1, 0.0)]]:
        rows = spark.createDataFrame([(g, i, s, p) for g, i, s, p in part], "grp long, idx long, s long, p double")
        rows.select("grp", "idx", F.timestamp_seconds("s").alias("ts"), "p").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")


def run(spark, tmp_path, name, make):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / name)).filter("grp <> 99")


def readings(seed, groups=3, n=30):
    rng = random.Random(seed)
    return [(g, k, 1000 + 20 * k + g, round(rng.random(), 3)) for k in range(n) for g in range(groups)]


@pytest.fixture
def few_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_of_causal_scores_equals_the_batch(spark, tmp_path, few_shuffles):
    rows = readings(1)
    shuffled = rows[:45]
    random.Random(3).shuffle(shuffled)  # out of order within the watermark's delay
    files(spark, tmp_path, [shuffled[:20], shuffled[20:], rows[45:]])
    batch = spark.createDataFrame([(g, k, p) for g, k, _, p in rows], "grp long, idx long, p double")
    mean, var = batch.agg(F.avg("p"), F.var_pop("p")).first()
    make = lambda s: live.causal_z(s, ["p"], {"p": (mean, var)}, late="10 minutes")
    want = sorted((r.grp, r.idx, round(r.p_z, 9)) for r in windows.causal_z(batch, ["p"]).collect())
    assert sorted((r.grp, r.idx, round(r.p_z, 9)) for r in run(spark, tmp_path, "z", make).collect()) == want
    # a restart from the checkpoint goes on with the state: more rows of a group, and one that is late and is dropped
    more = [(0, 30, END + 5000, 0.5), (0, 31, END + 5001, 0.25), (1, 99, 50, 0.9), (99, 2, END + 9000, 0.0)]
    spark.createDataFrame(more, "grp long, idx long, s long, p double").select("grp", "idx", F.timestamp_seconds("s").alias("ts"), "p").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    spark.createDataFrame([(99, 3, END + 9001, 0.0)], "grp long, idx long, s long, p double").select("grp", "idx", F.timestamp_seconds("s").alias("ts"), "p").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    again = run(spark, tmp_path, "z", make)
    longer = batch.unionByName(spark.createDataFrame([(0, 30, 0.5), (0, 31, 0.25)], "grp long, idx long, p double"))
    want += [(r.grp, r.idx, round(r.p_z, 9)) for r in windows.causal_z(longer, ["p"]).filter("grp = 0 and idx >= 30").collect()]
    assert sorted((r.grp, r.idx, round(r.p_z, 9)) for r in again.collect()) == sorted(want)


def test_stream_of_buffered_levels_equals_a_loop(spark, tmp_path, few_shuffles):
    rows = readings(2, groups=2, n=26)
    rows = [(g, k, s + (5000 if g == 1 and k >= 13 else 0), p) for g, k, s, p in rows]  # group 1 is idle in between
    files(spark, tmp_path, [rows[:17], rows[17:40], rows[40:]])
    got = run(spark, tmp_path, "levels", lambda s: live.levels(s, size=5, stride=2, late="1 minute", idle_ms=1_000_000)).collect()
    want = []
    for g in range(2):
        buffer, n, last = [], 0, None
        for _, k, s, p in sorted(r for r in rows if r[0] == g):
            if last is not None and s - last > 1000:
                buffer, n = [], 0
            buffer, n, last = [*buffer, p][-5:], n + 1, s
            if n % 2 == 0:
                want.append((g, k, round(sum(buffer) / len(buffer), 9)))
    assert sorted((r.grp, r.idx, round(r.level, 9)) for r in got) == sorted(want)
