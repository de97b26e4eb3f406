"""Group-aware splits and folds; shuffles are orders by md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def shuffle_key(seed: str, column: str):
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")))


def modal_labels(rows: DataFrame) -> DataFrame:
    """(grp, label): each group's commonest y; of equally common ones that seen first, by id."""
    n = rows.groupBy("grp", F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    w = Window.partitionBy("grp").orderBy(F.desc("n"), "first")
    return n.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("grp", "label")


def group_split(groups: DataFrame, seed: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(grp, split): uniform over groups, one at least in each of train and val; rounding is half to even."""
    w = Window.orderBy(shuffle_key(seed, "grp"), "grp")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = groups.select("grp").distinct().withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(every))
    a, b = F.greatest(F.lit(1), F.bround(F.col("n") * train)), F.greatest(F.lit(1), F.bround(F.col("n") * val))
    split = F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test")
    return out.select("grp", F.when((a + b >= F.col("n")) & (F.col("rn") == F.least(a, F.col("n"))), "test").otherwise(split).alias("split"))


def stratified_split(labelled: DataFrame, seed: str, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """(grp, label, split): every class with three groups or more is in all splits; two give test and train, one train."""
    w = Window.partitionBy("label")
    out = labelled.withColumn("rn", F.row_number().over(w.orderBy(shuffle_key(seed, "grp"), "grp"))).withColumn("n", F.count(F.lit(1)).over(w))
    t, v = F.greatest(F.lit(1), F.bround(F.col("n") * test)), F.greatest(F.lit(1), F.bround(F.col("n") * val))
    t = F.when(t + v > F.col("n") - 1, F.greatest(F.lit(1), F.least(t, F.col("n") - 2))).otherwise(t)
    v = F.when(t + v > F.col("n") - 1, F.lit(1)).otherwise(v)
    split = F.when(F.col("n") == 1, "train").when(F.col("n") == 2, F.when(F.col("rn") == 1, "test").otherwise("train")).when(F.col("rn") <= t, "test").when(F.col("rn") <= t + v, "val").otherwise("train")
    return out.select("grp", "label", split.alias("split"))


def stratified_folds(labelled: DataFrame, k: int, seed: str) -> DataFrame:
    """(grp, label, fold): each class is dealt over the folds in turn, so no group is split."""
    w = Window.partitionBy("label").orderBy(shuffle_key(seed, "grp"), "grp")
    return labelled.select("grp", "label", F.pmod(F.row_number().over(w) - 1, F.lit(k)).alias("fold"))


def greedy_phases(loads: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """How ``count`` groups of one size go to the folds, each to that with the fewest rows, of equals the first.

    Phases (begin, end, folds): the groups numbered begin to end - 1 go to these folds in turn. The lowest folds fill up in
    turn until they reach the next one, which then joins; so there are as many phases as folds at most. ``loads`` is
    brought up to date.
    """
    waiting = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    active, at, out = [waiting.pop(0)], 0, []
    while at < count:
        if waiting:  # what the active folds take before the next is the lowest
            top = (loads[waiting[0]], waiting[0])
            steps = sum(max(0, -((loads[f] - top[0]) // size) + (f < top[1] if (top[0] - loads[f]) % size == 0 else 0)) for f in active)
        else:
            steps = count - at
        steps = min(steps, count - at)
        active.sort(key=lambda f: (loads[f], f))
        if steps:
            out.append((at, at + steps, active.copy()))
            for i, f in enumerate(active):
                loads[f] += size * (steps // len(active) + (i < steps % len(active)))
            at += steps
        if waiting:
            active.append(waiting.pop(0))
    return out


def balanced_folds(sizes: DataFrame, k: int) -> DataFrame:
    """(grp, n, fold): groups, largest first, each to the fold with the fewest rows so far; equal folds by number.

    Groups of one size are dealt in few phases, so only the different sizes and their numbers reach the driver. A group
    finds its place among those of its size by ranges, and its phase by a join.
    """
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()  # a row a size
    loads, phases = [0] * k, []
    for r in counts:
        phases += [(r.n, *p) for p in greedy_phases(loads, r.n, r.c)]
    table = sizes.sparkSession.createDataFrame(phases, "n long, begin long, end long, folds array<int>")
    placed = numbered(sizes.select("grp", F.col("n").cast("long").alias("n")), ["grp"], "t", ("n",))
    out = placed.join(table, "n").filter("t >= begin and t < end")
    return out.select("grp", "n", F.get("folds", ((F.col("t") - F.col("begin")) % F.size("folds")).cast("int")).alias("fold"))
