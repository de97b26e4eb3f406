"""Accounts of a data set: what was dropped and why, agreement, caps, histograms, and checks of its columns."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import not_empty, required
from .metrics import auc


def reason(tests: dict[str, Column], kept: str = "kept") -> Column:
    """The first reason whose test holds, or ``kept``; a null test doesn't hold."""
    return F.coalesce(*[F.when(test, name) for name, test in tests.items()], F.lit(kept))


def drop_reasons(rows: DataFrame, tests: dict[str, Column], kept: str = "kept") -> DataFrame:
    """(reason, n) of every reason, also of those that no row has; a row counts for its first reason."""
    named = rows.select(reason(tests, kept).alias("reason"))
    counts = named.agg(*[F.count_if(F.col("reason") == name).alias(name) for name in [*tests, kept]])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("reason"), F.col(f"`{name}`").alias("n")) for name in [*tests, kept]])).alias("r")).select("r.*")


def agreement(rows: DataFrame, designed: str, reported: str, weight: str) -> DataFrame:
    """(designed, agreed, checked, share) with rows weighed; rows that report nothing aren't checked."""
    w = F.col(weight)
    out = rows.filter(F.col(reported).isNotNull()).groupBy(F.col(designed).alias("designed")).agg(F.sum(F.when(F.col(designed) == F.col(reported), w).otherwise(0)).alias("agreed"), F.sum(w).alias("checked"))
    return out.withColumn("share", F.try_divide(F.col("agreed"), F.col("checked")))


def capped(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group: the cap is the feature. ``order`` must tell rows apart."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= most)


def counts_of_counts(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(labels, groups): how many groups hold so many different labels."""
    return rows.groupBy(group).agg(F.countDistinct(label).alias("labels")).groupBy("labels").agg(F.count(F.lit(1)).alias("groups"))


def varying(rows: DataFrame, columns: list[str], least: float = 1e-9) -> DataFrame:
    """(name, varies): whether a column's standard deviation is above ``least``; one pass, no shuffle of rows."""
    found = rows.agg(*[F.stddev_pop(c).alias(c) for c in columns])
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c) > least, F.lit(False)).alias("varies")) for c in columns])).alias("r")).select("r.*")


def matched_by_stem(left: DataFrame, left_key: str, right: DataFrame, right_key: str, pattern: str) -> DataFrame:
    """Inner join on keys without the part that ``pattern`` matches; no match at all is an error."""
    stem = lambda c: F.regexp_replace(c, pattern, "")
    out = left.withColumn("stem", stem(left_key)).join(right.withColumn("stem", stem(right_key)), "stem")
    return not_empty(out, f"the join of {left_key} and {right_key}")


def scorable(rows: DataFrame, keys: list[str], present: Column, least: int = 5) -> DataFrame:
    """(keys, n, seen, scorable): a group is scored if ``least`` of its rows are present; null is absent."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(present).alias("seen"))
    return out.withColumn("scorable", F.col("seen") >= least)


def members(rows: DataFrame, label: str, low: list[str], unusable: str) -> DataFrame:
    """``low`` as 0 or 1 by set membership; rows with the unusable label or none go."""
    return rows.filter(F.col(label).isNotNull() & (F.col(label) != unusable)).withColumn("low", F.col(label).isin(low).cast("int"))


def parity(rows: DataFrame, a: str, b: str, most: float = 1e-4) -> DataFrame:
    """(n, furthest, r) of two columns that should be the same scores; a larger difference, or a null on one side, fails the job."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(a) - F.col(b))).alias("furthest"), F.corr(a, b).alias("r"), F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("lone"))
    out = required(out, F.col("lone") == 0, F.concat(F.col("lone"), F.lit(f" rows have one of {a} and {b} alone")))
    return required(out, F.coalesce(F.col("furthest") <= most, F.lit(True)), F.concat(F.lit(f"{a} and {b} differ by "), F.col("furthest"))).drop("lone")


def drifted(rows: DataFrame, y: str, a: str, b: str, auc_most: float = 0.005, r_least: float = 0.99) -> DataFrame:
    """(auc_a, auc_b, gap, r) of two versions of the same scores; fails the job where they drift apart: AUC or correlation."""
    both = auc(rows, [], y, a).select(F.col("auc").alias("auc_a")).crossJoin(F.broadcast(auc(rows, [], y, b).select(F.col("auc").alias("auc_b"))))
    out = both.crossJoin(F.broadcast(rows.agg(F.corr(a, b).alias("r")))).select("auc_a", "auc_b", F.abs(F.col("auc_a") - F.col("auc_b")).alias("gap"), "r")  # one row each
    return required(out, (F.col("gap") <= auc_most) & (F.col("r") >= r_least), F.concat(F.lit(f"{a} and {b} drift: AUC by "), F.col("gap"), F.lit(", r "), F.col("r")))


def by_split(rows: DataFrame, split: str, subject: str, why: Column, kept: str = "kept") -> DataFrame:
    """(split, n, scored, dropped, subjects, scored_subjects) from each row's reason."""
    rows = rows.withColumn("why", why)
    own = F.when(F.col("why") == kept, F.col(subject))
    return rows.groupBy(F.col(split).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("why") == kept).alias("scored"), F.count_if(F.col("why") != kept).alias("dropped"),
        F.countDistinct(subject).alias("subjects"), F.countDistinct(own).alias("scored_subjects"),
    )


def platt(train: DataFrame, rows: DataFrame, y: str = "y", p: str = "p", edge: float = 1e-6) -> DataFrame:
    """``rows`` with p_cal: a logistic regression without penalty on the logit of ``p``, fitted on ``train``."""
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), F.col(p)))
    logit = array_to_vector(F.array(F.log(q / (1 - q))))
    model = LogisticRegression(regParam=0.0, featuresCol="logit", labelCol="label", probabilityCol="both", tol=1e-10, maxIter=200).fit(train.select(logit.alias("logit"), F.col(y).cast("double").alias("label")))
    out = model.transform(rows.withColumn("logit", logit)).withColumn("p_cal", vector_to_array("both")[1])
    return out.select(*rows.columns, "p_cal")
