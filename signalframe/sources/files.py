"""Readers of interaction logs, keystroke logs, research exports, label files and prediction records."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Kinds of events in a log, and the types they become.
LOG_KINDS = {
    "MouseMovement": "move", "MouseClick": "click", "MouseDoubleClick": "click",
    "MouseButtonDown": "click", "KeyPressed": "key", "Scroll": "scroll",
}
LOG_COLUMNS = ["session", "timestamp", "type", "key", "x", "y", "yPosition"]


def interaction_log(spark: SparkSession, paths: list[str], extra: tuple[str, ...] = (), width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Tab-separated logs as (participant, event_id, ts, type, x, y, key, dy, *extra); sessions are named by their file.

    Columns are found by each path's header, whatever others it has; a column of ``extra`` that it lacks is null. Everything
    is text; numbers that don't parse are null: rows without a time or of another kind go, coordinates become 0.
    """

    def one(path: str) -> DataFrame:
        file = spark.read.option("sep", "\t").option("header", True).csv(path)
        if missing := set(LOG_COLUMNS) - set(file.columns):
            raise ValueError(f"{path} has no columns {sorted(missing)}")
        return file.select(*LOG_COLUMNS, *[F.col(c) if c in file.columns else F.lit(None).cast("string").alias(c) for c in extra], F.col("_metadata.file_path").alias("file_path"))

    raw = reduce(DataFrame.unionByName, [one(p) for p in paths])
    stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    num = lambda c: F.col(c).try_cast("double")
    clip = lambda c, top: F.least(F.greatest(F.coalesce(num(c), F.lit(0.0)) / top, F.lit(0.0)), F.lit(1.0))
    kind = F.try_element_at(F.create_map(*[F.lit(v) for kv in LOG_KINDS.items() for v in kv]), F.col("type"))
    back = F.lower(F.trim("key")).isin("back_space", "backspace", "\\b") | (F.col("key") == "\b")
    rows = raw.select(
        F.concat_ws("_", stem, "session").alias("participant"), F.monotonically_increasing_id().alias("event_id"), F.floor(num("timestamp")).alias("ts"), kind.alias("type"),
        clip("x", width).alias("x"), clip("y", height).alias("y"), F.when(kind == "key", F.when(back, "Backspace").otherwise("a")).otherwise("").alias("key"), num("yPosition").alias("pos"), *[num(c).alias(c) for c in extra],
    ).dropna(subset=["ts", "type"])
    from pyspark.sql import Window

    w = Window.partitionBy("participant", F.col("type") == "scroll").orderBy("ts", "event_id")
    return rows.withColumn("dy", F.when(F.col("type") == "scroll", F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(0.0))).otherwise(0.0)).drop("pos")


def normalised_header(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.replace("﻿", "").lower())


def keystroke_log(spark: SparkSession, path: str) -> DataFrame:
    """A keystroke table (';' or ','; decimal commas; any spelling of the header) as an interaction log.

    Times are sums of the gaps before, each cut to 0 to 5000 ms, in order of ``index``.
    """
    first = spark.read.text(path).first()[0]
    raw = spark.read.option("sep", ";" if first.count(";") >= first.count(",") else ",").option("header", True).csv(path)
    raw = raw.toDF(*[normalised_header(c) for c in raw.columns])
    from pyspark.sql import Window

    gap = F.least(F.greatest(F.coalesce(F.regexp_replace("d1d2", ",", ".").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(5000.0))
    order = F.coalesce(F.col("index").try_cast("long"), F.lit(0).cast("long"))
    w = Window.partitionBy("userid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    back = F.lower(F.trim("keycode")).isin("back_space", "backspace", "\\b") | (F.col("keycode") == "\b")
    return raw.select(
        F.col("userid").alias("participant"), order.alias("event_id"), F.floor(F.coalesce(F.sum(gap).over(w), F.lit(0.0))).alias("ts"), F.lit("key").alias("type"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        F.when(back, "Backspace").otherwise("a").alias("key"), F.lit(0.0).alias("dy"), F.col("emotionindex").alias("label"),
    )


def research_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of an export (a list, or {"items", "sections"}; camelCase or snake_case) as one table."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = text.select(F.explode(F.coalesce(F.try_variant_get("v", "$.items", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("e"))
    pick = lambda kind, *names: F.coalesce(*[F.try_variant_get("e", f"$.{n}", kind) for n in names])
    return items.select(
        pick("string", "eventType", "event_type").alias("event_type"), pick("string", "sessionId", "session_id").alias("session_id"), pick("string", "learnerId", "learner_id").alias("learner_id"), pick("bigint", "timestamp").alias("ts"),
        pick("array<array<double>>", "payload.features").alias("features"), F.lower(pick("string", "payload.affect")).alias("affect"), F.coalesce(pick("boolean", "payload.skipped"), F.lit(False)).alias("skipped"), F.coalesce(pick("boolean", "payload.omitted"), F.lit(False)).alias("omitted"),
        pick("string", "payload.section_id", "payload.sectionId").alias("section_id"),
    )


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """(title, affect) of a codebook's sections."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    m = v.select(F.explode(F.try_variant_get("v", "$.sections", "map<string,variant>")).alias("title", "s"))
    return m.select("title", F.try_variant_get("s", "$.affect", "string").alias("affect"), F.try_variant_get("s", "$.course", "string").alias("course"))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """A label table with stripped headers (byte order mark, blanks) and ids without their file suffix."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    return raw.withColumn(raw.columns[0], F.regexp_replace(F.trim(raw.columns[0]), r"\.(mp4|avi)$", ""))


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a text file, without lines that are no number (a header)."""
    return spark.read.text(path).select(F.split("value", ",")[0].try_cast("double").alias("x")).dropna()


def combined(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


class PagedSource(DataSource):
    """``spark.read.format("paged")``: pages of JSON items from a provider, a partition each.

    Options: ``provider`` as module:function, called with (page, size) and returning (items, total); ``size``; ``total``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.provider, self.size = options["provider"], int(options.get("size", "1000"))

    def _call(self, page: int):
        import importlib

        module, _, function = self.provider.partition(":")
        return getattr(importlib.import_module(module), function)(page, self.size)

    def partitions(self):
        _, total = self._call(1)
        return [InputPartition(p) for p in range(1, -(-total // self.size) + 1)]

    def read(self, partition):
        items, _ = self._call(partition.value)
        for item in items:
            yield partition.value, json.dumps(item, sort_keys=True)
