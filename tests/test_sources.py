"""The paged source with pushed filters, and the sharded sink with commits."""

import pytest
from pyspark.sql import functions as F

from signalframe.operators import records
from signalframe.sources import paged, shards

SERVICE = '''
import json, os

ITEMS = [{"eventType": ["view", "click"][k % 2], "learnerId": f"l{k % 5}", "sessionId": f"s{k % 7}", "timestamp": 1000 + k, "payload": {"k": k}} for k in range(95)]


def pages(page, size, filters):
    with open(os.environ["CALLS"], "a") as out:
        out.write(json.dumps([page, filters]) + "\\n")
    found = [e for e in ITEMS if all(e[c] in filters[c] for c in ("eventType", "learnerId", "sessionId") if c in filters)]
    found = [e for e in found if filters.get("startTs", 0) <= e["timestamp"] <= filters.get("endTs", 1 << 60)]
    return found[(page - 1) * size : page * size], len(found) + int(os.environ.get("TOO_MANY", "0"))
'''


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    import os

    folder = tmp_path_factory.mktemp("service")
    (folder / "event_service.py").write_text(SERVICE.replace('os.environ["CALLS"]', repr(str(folder / "calls"))))
    spark.sparkContext.addPyFile(str(folder / "event_service.py"))
    paged.register(spark)

    def calls():
        import json

        lines = (folder / "calls").read_text().splitlines() if (folder / "calls").exists() else []
        if lines:
            os.remove(folder / "calls")
        return [json.loads(x) for x in lines]

    return calls


def events(spark, size=10):
    return spark.read.format("paged_events").option("provider", "event_service:pages").option("size", str(size)).option("pages", "2").load()


def test_filters_reach_the_service(spark, service):
    df = events(spark)
    assert df.count() == 95
    service()
    some = df.filter("learnerId = 'l1' and eventType in ('view', 'click') and timestamp >= 1010 and timestamp < 1080 and payload like '%1%'")
    want = [k for k in range(95) if k % 5 == 1 and 10 <= k < 80 and "1" in str(k)]
    assert sorted(r.timestamp - 1000 for r in some.collect()) == want
    calls = service()
    assert {(tuple(f["learnerId"]), tuple(f["eventType"]), f["startTs"], f["endTs"]) for _, f in calls} == {(("l1",), ("click", "view"), 1010, 1079)}
    assert max(p for p, _ in calls) == 2  # fourteen items in two pages, not ten pages
    # what the service doesn't know stays with Spark, and contradictions give nothing
    assert df.filter("sessionId <> 's1'").count() == 95 - 14
    assert df.filter("learnerId = 'l1' and learnerId = 'l2'").count() == 0
    assert df.filter("timestamp = 1004 or eventType is null").count() == 1


def test_plan_shows_no_filter_that_the_service_takes(spark, service):
    plan = events(spark).filter("sessionId = 's3' and payload is not null")._jdf.queryExecution().executedPlan().toString()
    assert "= s3" not in plan and "isnotnull(payload" in plan


def test_short_pages_end_a_run(spark, service):
    reader = paged.PagedReader({"provider": "short:pages", "size": "10", "pages": "5"})
    made = []
    reader._call = lambda page: made.append(page) or ([{"timestamp": page}] * (10 if page < 2 else 4), 48)
    assert len(list(reader.read(reader.partitions()[0]))) == 14 and made == [1, 1, 2]


SCHEMA = "id long, v double"


def test_shards_are_appended_and_a_failed_write_leaves_none(spark, tmp_path):
    shards.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(100).select("id", (F.col("id") * 0.5).alias("v")).repartition(4)
    assert shards.read(spark, path, SCHEMA).count() == 0
    rows.filter("id < 60").write.format("shards").mode("append").save(path)
    assert shards.committed(spark, path).agg(F.sum("rows")).first()[0] == 60
    broken = rows.filter("id >= 60").withColumn("v", F.when(F.col("id") == 99, F.raise_error("stop").cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("shards").mode("append").save(path)
    assert shards.read(spark, path, SCHEMA).count() == 60
    # a run that goes on writes what is missing, and one more run nothing
    for want in (40, 0):
        left = records.remaining(rows, shards.read(spark, path, SCHEMA), "id")
        assert left.count() == want
        left.write.format("shards").mode("append").save(path)
    assert sorted(r.id for r in shards.read(spark, path, SCHEMA).collect()) == list(range(100))
    (tmp_path / "out" / "shard-stray.parquet").write_bytes(b"half a file")
    assert shards.read(spark, path, SCHEMA).count() == 100
    with pytest.raises(Exception, match="appended"):
        rows.write.format("shards").mode("overwrite").save(path)


def test_stream_commits_each_batch_once(spark, tmp_path):
    shards.register(spark)
    path, schema = str(tmp_path / "out"), "id long, v double"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", F.lit(1.5).alias("v")).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("shards").option("checkpointLocation", str(tmp_path / "cp")).option("path", path).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    assert shards.committed(spark, path).select("commit").distinct().count() == 3
    # the last batch comes again, as after a crash between the sink's commit and the stream's
    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r.id for r in shards.read(spark, path, SCHEMA).collect()) == list(range(30))


def test_coverage(spark):
    rows = spark.createDataFrame([(1, [[0.5, 1.0], [0.5, 0.0], [0.5, None], [0.5, float("nan")]]), (2, []), (3, None)], "id long, frames array<array<double>>")
    assert [r.coverage for r in shards.with_coverage(rows, "frames", 1).orderBy("id").collect()] == [0.25, None, None]
