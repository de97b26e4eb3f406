"""Bootstraps and permutations at thousands of repetitions without repeating rows: draws are split over blocks.

How many of a repetition's draws fall into a block is drawn first, by halving the blocks again and again: each half's
share is binomial (draws with replacement) or hypergeometric (labels that change places). Every node of this tree has a
seed of its own, so that each block's task finds the same numbers on the way down to its block. Within a block numpy
draws for all repetitions; only one row a repetition and block leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .ordering import running

#: Cells of a block of scores, rows of a block of a group, and cells of a numpy step.
CELLS, ROWS, STEP = 1 << 16, 1 << 12, 1 << 21


def _generator(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=16).digest(), "little"))


def shares(seed: str, sizes: np.ndarray, block: int, draws: np.ndarray, replace: bool) -> np.ndarray:
    """How many of each repetition's ``draws`` from all rows fall into one block, of blocks of these sizes."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, n = 0, len(sizes), draws.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = _generator(seed, "node", low, high)
        left, right = int(upto[mid] - upto[low]), int(upto[high] - upto[mid])
        in_left = rng.binomial(n, left / max(1, left + right)) if replace else rng.hypergeometric(left, right, n)
        low, high, n = (low, mid, in_left) if block < mid else (mid, high, n - in_left)
    return n


def bootstrap_auc_rows(rows: DataFrame, reps: int, seed: str, y: str = "y", p: str = "p") -> DataFrame:
    """(rep, auc): AUC over as many rows as there are, drawn with replacement; null where one class isn't drawn.

    Rows of equal score are counted before anything is drawn: a count is drawn as often as its rows would be. Scores are
    cut into ranges; each gives, for every repetition, its drawn positives and negatives and the pairs within it, and a
    running sum over the ranges gives the pairs between them.
    """
    cells = rows.groupBy(F.col(p).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    cells = kept(cells, "score-cells")
    n = cells.count()
    ranged = kept(cells.repartitionByRange(max(1, -(-n // CELLS)), "score").withColumn("part", F.spark_partition_id()), "score-ranges")
    found = {r.part: r.n for r in ranged.groupBy("part").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()}  # a row a range
    parts = sorted(found)
    sizes = np.array([found[k] for k in parts], np.int64)
    total = int(sizes.sum())

    def draw(t: pa.Table) -> pa.Table:
        block = parts.index(t.column("part")[0].as_py())
        order = np.argsort(t.column("score").to_numpy(), kind="stable")
        pos, neg = t.column("pos").to_numpy()[order], t.column("neg").to_numpy()[order]
        cell = np.repeat(np.arange(2 * len(pos)), np.stack([pos, neg], 1).ravel())  # each row's cell: positives of a score, then negatives
        n = shares(seed, sizes, block, np.full(reps, total), True)
        rng, out = _generator(seed, "block", block), np.zeros((3, reps))
        for rep in range(reps):
            c = np.bincount(cell[rng.integers(0, len(cell), n[rep])], minlength=2 * len(pos)).reshape(-1, 2)
            below = np.cumsum(c[:, 1]) - c[:, 1]
            out[:, rep] = (c[:, 0] * (below + c[:, 1] / 2)).sum(), c[:, 0].sum(), c[:, 1].sum()
        return pa.table({"part": pa.array(np.full(reps, block)), "rep": pa.array(np.arange(reps)), **{k: pa.array(v) for k, v in zip(("pairs", "pos", "neg"), out, strict=True)}})

    each = ranged.groupBy("part").applyInArrow(draw, "part long, rep long, pairs double, pos double, neg double")
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumn("all", F.col("pairs") + F.col("pos") * before)
    return each.groupBy("rep").agg(F.try_divide(F.sum("all"), F.sum("pos") * F.sum("neg")).alias("auc"))


def permutation_p(rows: DataFrame, reps: int, seed: str) -> DataFrame:
    """(hits, p_value): labels change places within their group; p = (hits + 1) / (reps + 1).

    ``rows`` has id, grp, y and p. A group's rows are dealt into blocks by a hash of id; how many of its positives a block
    gets in each repetition is drawn down the tree, and which rows within the block. A task adds up its blocks, so that it
    sends one row a repetition. A group may have fewer than 10**9 rows, as numpy's draw of shares holds no more.
    """
    by = rows.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    ranks = running(by, ["p"], {"below": F.col("c")}).select("p", (F.col("below") + (F.col("c") + 1) / 2.0).alias("rank"))
    ranked = kept(rows.select("id", "grp", "y", "p").join(ranks, "p").select("id", F.to_json(F.struct("grp")).alias("grp"), "y", "rank"), "ranked-rows")
    sizes = ranked.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("positives"))
    dealt = ranked.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ROWS)))
    blocks = dealt.groupBy("grp", "positives", "block").agg(F.collect_list("rank").alias("ranks"))
    tree = blocks.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("block", F.size("ranks").cast("long").alias("n")))).alias("tree"))
    whole = blocks.join(tree, "grp").select("grp", "positives", "block", "ranks", "tree")

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(reps)
        for batch in batches:
            for row in batch.to_pylist():
                ranks, at = np.sort(np.array(row["ranks"])), [b["block"] for b in row["tree"]].index(row["block"])
                own = f"{seed}:{row['grp']}"
                n = shares(own, np.array([b["n"] for b in row["tree"]]), at, np.full(reps, row["positives"]), False)
                rng, step = _generator(own, "block", row["block"]), max(1, STEP // len(ranks))
                for a in range(0, reps, step):
                    m = n[a : a + step]
                    upto = np.cumsum(rng.permuted(np.broadcast_to(ranks, (len(m), len(ranks))), axis=1), axis=1)
                    total[a : a + step] += np.where(m > 0, upto[np.arange(len(m)), np.maximum(m, 1) - 1], 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(total)], ["rep", "s"])

    sums = whole.mapInArrow(permute, "rep long, s double").groupBy("rep").agg(F.sum("s").alias("s"))
    seen = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("rank"))).alias("observed"))
    hits = F.count_if(F.col("s") >= F.col("observed") - 1e-9)
    return sums.crossJoin(F.broadcast(seen)).agg(hits.alias("hits"), ((hits + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))  # one row
