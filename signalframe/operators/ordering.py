"""Running sums and positions in an order over all rows, by ranges: no task orders the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``part`` and, for each named sum, its total over all rows before in the order, within equal ``keys``.

    ``order`` must tell rows apart. Rows are dealt into ranges of keys and order and written; one total a range and key is
    summed over the ranges before it, and running sums within a range are added. So what one task orders is one range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = totals.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("part").alias("_p"), *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    same = F.col("part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(base, same)
    return out.select(*rows.columns, "part", *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{name}")).alias(name) for name, c in sums.items()])


def numbered(rows: DataFrame, order: list[Column | str], name: str = "k", keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their position in the order, from 0, within equal ``keys``."""
    return running(rows, order, {name: F.lit(1).cast("long")}, keys).drop("part")
