"""Prediction records on disk: checked when written and when read, and work that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits
from .audits import not_empty, required


def valid(rows: DataFrame, classes: int, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """The rows as they are; the job fails at a row without ``classes`` finite probabilities or a class in range."""
    wrong = F.when(F.col(p).isNull() | (F.size(p) != classes), "probabilities of another number of classes")
    wrong = wrong.when(F.exists(p, lambda x: x.isNull() | F.isnan(x.cast("double"))), "a probability that is no number")
    wrong = wrong.when(F.exists(p, lambda x: F.abs(x.cast("double")) == F.lit(float("inf"))), "an infinite probability")
    wrong = wrong.when(F.col(y).isNull() | (F.col(y) < 0) | (F.col(y) >= classes), "a class out of range")
    return required(rows, wrong.isNull(), wrong)


def saved(rows: DataFrame, path: str, classes: int, **columns: str) -> None:
    """Write a checked record as JSON lines; an existing record is an error, not overwritten."""
    valid(rows, classes, **columns).write.mode("errorifexists").json(path)


def loaded(spark: SparkSession, path: str, schema: str, classes: int, **columns: str) -> DataFrame:
    """Read a record with its stated schema; lines that don't parse fail the job, an empty record is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return valid(not_empty(rows, path), classes, **columns)


def remaining(work: DataFrame, done: DataFrame | None, *keys: str) -> DataFrame:
    """The work whose keys the output doesn't hold yet; all of it where there is no output."""
    return work if done is None else work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def out_of_fold(rows: DataFrame, labelled: DataFrame, k: int, seed: str, fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Predictions of every row by a model that saw no row of its group's fold, with the fold.

    ``labelled`` has (grp, label); ``fit_predict`` takes the rows to learn from and those to predict. Folds are few, so
    each is a job of its own over the whole rows.
    """
    folds = splits.stratified_folds(labelled, k, seed).select("grp", "fold")
    dealt = rows.join(folds, "grp")
    parts = [fit_predict(dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f)) for f in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spread(rows: DataFrame, *scores: str) -> DataFrame:
    """(score, mean, sd, low, high) of repeated runs, one row for each score; the sample's standard deviation."""
    each = [F.struct(F.lit(s).alias("score"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.min(s).alias("low"), F.max(s).alias("high")) for s in scores]
    return rows.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")
