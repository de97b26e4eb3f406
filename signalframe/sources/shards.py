"""Sharded append with commits: a shard counts from the moment that its commit names it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch group in a shard's file.
ROW_GROUP = 1 << 16


@dataclass
class Shard(WriterCommitMessage):
    name: str
    rows: int


class ShardSink(DataSource):
    """``df.write.format("shards").mode("append").save(path)``, and the same as a stream's sink.

    Every task writes one Parquet file under a name of its own; files of failed and repeated tasks are named by no commit.
    A commit is one JSON file in ``_commits`` with the names and row counts of its shards, written last. A stream's
    commits are named by its batch: a batch that comes again after a restart is written but not committed twice.

    ``path`` is whatever pyarrow's file systems reach from the executors: a shared folder, HDFS or an object store.
    """

    @classmethod
    def name(cls) -> str:
        return "shards"

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        if overwrite:
            raise ValueError("shards are only appended")
        return ShardWriter(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> ShardStreamWriter:  # noqa: N802
        return ShardStreamWriter(self.options["path"], schema)


class _Shards:
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        store, root = self._store()
        store.create_dir(f"{root}/_commits", recursive=True)
        name, rows = f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", 0
        kind = to_arrow_schema(self.schema)
        try:
            with store.open_output_stream(f"{root}/{name}") as out, pq.ParquetWriter(out, kind) as file:
                for batch in iterator:
                    file.write_table(pa.Table.from_batches([batch]).cast(kind), ROW_GROUP)
                    rows += batch.num_rows
        except BaseException:
            store.delete_file(f"{root}/{name}")
            raise
        return Shard(name, rows)

    def _commit(self, shards: list[Shard], name: str) -> None:
        store, root = self._store()
        target = f"{root}/_commits/{name}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            return self._undo(shards)  # the batch was committed before
        for s in [s for s in shards if not s.rows]:
            store.delete_file(f"{root}/{s.name}")
        text = "".join(json.dumps({"commit": name, "shard": s.name, "rows": s.rows}) + "\n" for s in shards if s.rows)
        with store.open_output_stream(f"{root}/_commits/.{name}") as out:
            out.write(text.encode())
        store.move(f"{root}/_commits/.{name}", target)
        return None

    def _undo(self, shards: list[Shard]) -> None:
        store, root = self._store()
        for s in shards:
            if s is not None and store.get_file_info(f"{root}/{s.name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{s.name}")


class ShardWriter(_Shards, DataSourceArrowWriter):
    def commit(self, messages: list[Shard]) -> None:
        self._commit([m for m in messages if m is not None], uuid.uuid4().hex)

    def abort(self, messages: list[Shard]) -> None:
        self._undo(messages)


class ShardStreamWriter(_Shards, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Shard], batchId: int) -> None:  # noqa: N803
        self._commit([m for m in messages if m is not None], f"batch-{batchId:09d}")

    def abort(self, messages: list[Shard], batchId: int) -> None:  # noqa: N803
        self._undo(messages)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSink)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(commit, shard, rows) of all committed shards; no rows where nothing is committed yet."""
    schema = "commit string, shard string, rows long"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/_commits")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed shards; files that no commit names aren't read."""
    names = [r.shard for r in committed(spark, path).select("shard").collect()]  # a name a file, as a listing has
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def with_coverage(rows: DataFrame, frames: str, present: Column | int, name: str = "coverage") -> DataFrame:
    """The share of a row's frames in which entry ``present`` of the frame is 1; missing entries count as 0, no frames give null."""
    found = F.aggregate(frames, F.lit(0.0), lambda a, f: a + F.coalesce(F.nanvl(f[present].cast("double"), F.lit(0.0)), F.lit(0.0)))
    return rows.withColumn(name, F.when(F.size(frames) > 0, found / F.size(frames)))
