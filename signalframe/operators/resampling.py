"""Cluster bootstraps and permutations with draws that any engine can repeat: md5 of seed, repetition and slot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .metrics import auc
from .ordering import numbered

#: Groups times repetitions whose multiplicities one task may hold, cells of a range of scores, and cells of a numpy step.
DRAWN, CELLS, STEP = 1 << 22, 1 << 13, 1 << 20


def draw(seed: str, *parts):
    """A whole number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def _dealt(rows: DataFrame, reps: int, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, however few they are, and over as many again for each 100 repetitions to come."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * -(-reps // 100), *keys)


def cluster_draws(groups: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, grp, times): for every repetition as many groups as there are, with replacement.

    ``groups`` has one row a group (grp). Each slot draws a position; equal draws are a multiplicity, so that rows are
    never repeated.
    """
    order = Window.orderBy("grp")
    numbered = groups.select("grp", (F.row_number().over(order) - 1).alias("slot"), F.count(F.lit(1)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    slots = _dealt(numbered, 1, "slot").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).select("rep", F.pmod(draw(seed, "rep", "slot"), F.col("n")).alias("slot"))
    return slots.groupBy("rep", "slot").agg(F.count(F.lit(1)).alias("times")).join(numbered.select("slot", "grp"), "slot").select("rep", "grp", "times")


def bootstrap_auc(rows: DataFrame, reps: int, seed: str, scores: list[str]) -> DataFrame:
    """(rep, auc per score column): the same draws for every score. Repetitions with one class only give null.

    Rows are counted by group and score once. Few groups' multiplicities stand beside these counts, which are weighed with
    them in tasks, so that no row is made for a count and repetition; many groups' are joined to the counts.
    """
    counts = kept(rows.groupBy("grp", "y", *scores).agg(F.count(F.lit(1)).alias("c")), "group-counts")
    groups = counts.select("grp").distinct()
    n, draws = groups.count(), cluster_draws(groups, reps, seed)
    few = n * reps <= DRAWN
    drawn = None if few else counts.join(draws, "grp")
    out = None
    for s in scores:
        one = _weighed_auc(counts, draws, n, reps, s) if few else auc(drawn, ["rep"], "y", s, F.col("c") * F.col("times").cast("double"))
        one = one.withColumnRenamed("auc", f"auc_{s}")
        out = one if out is None else out.join(one, "rep")
    return out


def _weighed_auc(counts: DataFrame, draws: DataFrame, groups: int, reps: int, p: str) -> DataFrame:
    """(rep, auc) of counts by grp, y and score, each weighing as often as its group is drawn.

    Counts are cut into ranges of scores; a range gives every repetition's positives, negatives and pairs within it, and a
    running sum over the ranges gives the pairs between them. All are whole or half numbers, so sums are exact.
    """
    true = F.coalesce(F.col("y") == 1, F.lit(False))
    cells = counts.groupBy("grp", F.col(p).alias("score")).agg(F.sum(F.when(true, F.col("c")).otherwise(0)).alias("pos"), F.sum(F.when(true, 0).otherwise(F.col("c"))).alias("neg"))
    cells = kept(cells, "group-cells")
    parts = max(1, -(-cells.count() // max(CELLS, 8 * groups)))
    ranged = kept(cells.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()), "group-ranges")
    own = ranged.groupBy("part", "grp").agg(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), "pos", "neg")).alias("cells"))
    times = draws.groupBy("grp").agg(F.collect_list(F.struct("rep", "times")).alias("draws"))

    def weigh(t: pa.Table) -> pa.Table:
        lists, drawn = (t.column(c).combine_chunks() for c in ("cells", "draws"))
        weight = np.zeros((reps, len(t)))
        d = drawn.flatten()
        weight[d.field("rep").to_numpy(), np.repeat(np.arange(len(t)), np.diff(drawn.offsets.to_numpy()))] = d.field("times").to_numpy()
        group, flat = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy())), lists.flatten()
        null = flat.field("score").is_null().to_numpy(zero_copy_only=False)
        level = np.unique(flat.field("score").fill_null(0.0).to_numpy(), return_inverse=True)[1] + 1
        level[null] = 0  # nulls come first, as in an order of Spark
        order = np.argsort(level, kind="stable")
        group, pos, neg = group[order], flat.field("pos").to_numpy()[order], flat.field("neg").to_numpy()[order]
        starts = np.flatnonzero(np.concatenate([[True], level[order][1:] != level[order][:-1]]))
        out, step = np.zeros((3, reps)), max(1, STEP // len(group))
        for a in range(0, reps, step):
            w = weight[a : a + step][:, group]
            up, down = np.add.reduceat(w * pos, starts, axis=1), np.add.reduceat(w * neg, starts, axis=1)
            out[:, a : a + step] = (up * (np.cumsum(down, axis=1) - down / 2)).sum(1), up.sum(1), down.sum(1)
        return pa.table({"part": pa.array(np.full(reps, t.column("part")[0].as_py())), "rep": pa.array(np.arange(reps, dtype=np.int32)), **{k: pa.array(v) for k, v in zip(("pairs", "pos", "neg"), out, strict=True)}})

    # a number of partitions of its own: sizes don't tell how long a range takes
    each = own.join(times, "grp").select("part", "cells", "draws").repartition(2 * parts, "part").groupBy("part").applyInArrow(weigh, "part long, rep int, pairs double, pos double, neg double")
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumn("all", F.col("pairs") + F.col("pos") * before)
    return each.groupBy("rep").agg(F.try_divide(F.sum("all"), F.sum("pos") * F.sum("neg")).alias("auc"))


def interval(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, low, high, kept): the central 95 %, and how many repetitions counted."""
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*keys).agg(q.alias("q"), F.count(column).alias("kept")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "kept")


def bootstrap_ratio(per_group: DataFrame, hit: str, n: str, reps: int, seed: str) -> DataFrame:
    """(rep, ratio): sums of two per-group counts over drawn groups; null where nothing is counted."""
    drawn = per_group.join(cluster_draws(per_group.select("grp"), reps, seed), "grp")
    return drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col(hit) * F.col("times")), F.sum(F.col(n) * F.col("times"))).alias("ratio"))


def bootstrap_ratio_by(per_group: DataFrame, key: str, hit: str, n: str, reps: int, seed: str) -> DataFrame:
    """(key, rep, ratio): as bootstrap_ratio for every value of ``key``, which each group has once, with the same draws."""
    drawn = per_group.join(cluster_draws(per_group.select("grp").distinct(), reps, seed), "grp")
    return drawn.groupBy(key, "rep").agg(F.try_divide(F.sum(F.col(hit) * F.col("times")), F.sum(F.col(n) * F.col("times"))).alias("ratio"))


def independent_means(rows: DataFrame, side: Column, value: str, reps: int, seed: str, key: str = "id") -> DataFrame:
    """(rep, diff): the mean of the rows of ``side`` less that of the others, each drawn by itself with replacement.

    Each side's rows are numbered by ranges, and draws are multiplicities of these numbers.
    """
    own = rows.select(F.col(key).alias("_key"), side.alias("_side"), F.col(value).cast("double").alias("_v")).filter("_side is not null and _v is not null")
    placed = numbered(own, ["_key"], "slot", ("_side",))
    counts = own.groupBy("_side").agg(F.count(F.lit(1)).alias("n"))
    slots = _dealt(placed.join(F.broadcast(counts), "_side"), 1, "_side", "slot").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    drawn = slots.select("rep", "_side", F.pmod(draw(seed, "rep", F.col("_side").cast("string"), "slot"), F.col("n")).alias("slot"))
    drawn = drawn.groupBy("rep", "_side", "slot").agg(F.count(F.lit(1)).alias("times")).join(placed, ["_side", "slot"])
    mean = lambda one: F.try_divide(F.sum(F.when(F.col("_side") == one, F.col("_v") * F.col("times"))), F.sum(F.when(F.col("_side") == one, F.col("times"))))
    return drawn.groupBy("rep").agg((mean(True) - mean(False)).alias("diff"))


def bootstrap_ratio_difference(per_group: DataFrame, a: tuple[str, str], b: tuple[str, str], reps: int, seed: str) -> DataFrame:
    """(rep, diff): the ratio of the counts ``b`` less that of ``a``, over the same drawn groups; null where either is."""
    drawn = per_group.join(cluster_draws(per_group.select("grp"), reps, seed), "grp")
    ratio = lambda hit, n: F.try_divide(F.sum(F.col(hit) * F.col("times")), F.sum(F.col(n) * F.col("times")))
    return drawn.groupBy("rep").agg((ratio(*b) - ratio(*a)).alias("diff"))


def permutation_p(rows: DataFrame, reps: int, seed: str) -> DataFrame:
    """(hits, p): labels change places within their group; p = (hits + 1) / (reps + 1).

    The ranks of the scores stay, so each repetition only sums the ranks that shuffled labels meet: the k-th row of a
    group by id takes the label of its k-th row by draw. Rows are dealt once for each block of repetitions, so that a
    large group is spread and its repeated rows aren't shuffled.
    """
    blocks = min(reps, 50)
    order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranks = rows.groupBy("p").agg(F.count(F.lit(1)).alias("c")).withColumn("below", F.coalesce(F.sum("c").over(order), F.lit(0))).select("p", (F.col("below") + (F.col("c") + 1) / 2.0).alias("rank"))
    ranked = rows.join(ranks, "p").withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("id")))
    shuffled = _dealt(rows.select("id", "grp", "y").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), reps, "grp", "block")
    shuffled = shuffled.withColumn("rep", F.explode(F.sequence(F.col("block"), F.lit(reps - 1), F.lit(blocks))))
    shuffled = shuffled.withColumn("k", F.row_number().over(Window.partitionBy("grp", "block", "rep").orderBy(draw(seed, "rep", "id"), "id"))).filter("y = 1")
    sums = shuffled.join(ranked.select("grp", "k", "rank"), ["grp", "k"]).groupBy("rep").agg(F.sum("rank").alias("s"))
    seen = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("rank"))).alias("observed"))
    out = sums.crossJoin(F.broadcast(seen))  # one row
    return out.agg(F.count_if(F.col("s") >= F.col("observed")).alias("hits"), ((F.count_if(F.col("s") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
