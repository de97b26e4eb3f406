"""Normalisation that is fitted anew for each held-out fold, by moments that are put together and taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def others_moments(rows: DataFrame, columns: list[str], fold: str) -> DataFrame:
    """(held, n, m_<column>, v_<column>): mean and population variance over the rows of all other folds.

    One aggregation by fold. The sum of squares around the others' mean is that around the mean of all, less the fold's
    own, less what the two means' distance adds, so that no squares of large values are subtracted.
    """
    n = F.count(F.lit(1))
    own = rows.groupBy(F.col(fold).alias("held")).agg(n.alias("n"), *[f(c).alias(f"{a}_{c}") for c in columns for a, f in (("m", F.avg), ("v", F.var_pop))])
    every = rows.agg(n.alias("all_n"), *[f(c).alias(f"all_{a}_{c}") for c in columns for a, f in (("m", F.avg), ("v", F.var_pop))])
    both = own.crossJoin(F.broadcast(every))  # one row
    rest = F.col("all_n") - F.col("n")
    out: list[Column] = [F.col("held"), rest.alias("n")]
    for c in columns:
        mean = F.try_divide(F.col("all_n") * F.col(f"all_m_{c}") - F.col("n") * F.col(f"m_{c}"), rest)
        squares = F.col("all_n") * F.col(f"all_v_{c}") - F.col("n") * F.col(f"v_{c}") - F.col("n") * rest / F.col("all_n") * F.pow(mean - F.col(f"m_{c}"), 2)
        out += [mean.alias(f"m_{c}"), F.greatest(F.lit(0.0), F.try_divide(squares, rest)).alias(f"v_{c}")]
    return both.select(*out)


def causal_by_fold(rows: DataFrame, columns: list[str], group: str, order: str, fold: str, warm: int = 4) -> DataFrame:
    """The rows with <column>_z by strictly earlier rows of their group, and ``only``: null, or the one fold a row is for.

    A group's first ``warm`` rows take the mean and variance of the rows that a fold may learn from, all but the fold's own.
    These rows stand once for each held-out fold, with its number in ``only``; all others don't depend on the fold and stand
    once. Folds are few. A variance below 1e-18 counts as 1, and so does one of other folds without rows.
    """
    past = Window.partitionBy(group).orderBy(order)
    out = rows.withColumn("_rn", F.row_number().over(past))
    for c in columns:
        out = out.withColumns({f"_m_{c}": F.avg(c).over(past.rowsBetween(Window.unboundedPreceding, -1)), f"_v_{c}": F.var_pop(c).over(past.rowsBetween(Window.unboundedPreceding, -1))})
    z = lambda c, m, v: (F.col(c) - m) / F.when(F.coalesce(v, F.lit(0.0)) < 1e-18, 1.0).otherwise(F.sqrt(v))
    later = out.filter(F.col("_rn") > warm).select(*rows.columns, F.lit(None).cast("long").alias("only"), *[z(c, F.col(f"_m_{c}"), F.col(f"_v_{c}")).alias(f"{c}_z") for c in columns])
    others = others_moments(rows, columns, fold).select(F.struct("*").alias("_others"))
    first = out.filter(F.col("_rn") <= warm).select(*rows.columns).crossJoin(F.broadcast(others))  # few rows a group times few folds
    first = first.select(*rows.columns, F.col("_others.held").cast("long").alias("only"), *[z(c, F.col(f"_others.m_{c}"), F.col(f"_others.v_{c}")).alias(f"{c}_z") for c in columns])
    return later.unionByName(first)
