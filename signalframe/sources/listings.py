"""Files as rows: fingerprints of training data, and clips listed beside their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audits import not_empty


def digests(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """(path, name, bytes, digest) of every file: sha256 of its bytes, each file in one task, by the binaryFile source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def fingerprint(files: DataFrame, digits: int = 16) -> DataFrame:
    """(files, bytes, fingerprint): one digest of all files' names and contents, the same in whatever order they are listed.

    A tree: files are digested apart, the digests of 256 groups by name's hash in order of name and path, and the groups'
    digests in order. A file that changes, comes, goes or is renamed changes it. Files of one name count each.
    """
    leaf = F.struct("name", "path", F.sha2(F.concat_ws(":", "name", "digest"), 256).alias("d"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["d"]), "")
    groups = files.groupBy(F.pmod(F.crc32("name"), F.lit(256)).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sha2(joined(leaf), 256).alias("d"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.substring(F.sha2(joined(F.struct("group", "d")), 256), 1, digits).alias("fingerprint"))


def labelled_clips(spark: SparkSession, folder: str, labels: DataFrame, target: str, key: str = "ClipID", pattern: str = "*.npy", low: list[int] | None = None) -> DataFrame:
    """(path, clip, label) of the folder's clips that have a label, in no order; none at all is an error.

    A label's key is a clip's name with or without its own suffix, blanks aside. ``low`` are the levels that make a two-way
    label 1. The listing reads no contents.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    clips = found.withColumn("clip", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    level = F.col(target).cast("int")
    marks = labels.select(F.regexp_replace(F.trim(F.col(key)), r"\.[A-Za-z0-9]+$", "").alias("clip"), (level.isin(low).cast("int") if low is not None else level).alias("label"))
    return not_empty(clips.join(marks.dropDuplicates(["clip"]), "clip").select("path", "clip", "label"), f"{folder} with labels")
