"""Exact top-k search by inner product with a dual-tree search over cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a data block and of a query block: what one task holds.
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
#: Children of a node at most; members of a leaf.
FAN, LEAF = 12, 96


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


class Node:
    """A ball: a centre, the covering radius of its members, and either children or, in a leaf, the members."""

    __slots__ = ("centre", "children", "members", "norm", "radius", "worst")

    def __init__(self, points: np.ndarray, members: np.ndarray, centre: int):
        self.centre, self.members = points[centre], members
        away = np.sqrt(((points[members] - self.centre) ** 2).sum(1))
        self.radius, self.norm, self.worst = float(away.max()), float(np.sqrt((self.centre**2).sum())), -math.inf
        self.children: list[Node] = []
        if len(members) <= LEAF or self.radius == 0:
            return
        # centres are taken farthest first until all members lie within half the radius of one, or FAN are taken
        near, owner, centres = away, np.zeros(len(members), np.int64), [centre]
        while near.max() > self.radius / 2 and len(centres) < FAN:
            far = int(near.argmax())
            centres.append(int(members[far]))
            d = np.sqrt(((points[members] - points[members[far]]) ** 2).sum(1))
            closer = d < near
            owner[closer], near = len(centres) - 1, np.minimum(near, d)
        for k, c in enumerate(centres):
            own = members[owner == k]
            if len(own) == len(members):
                return
            if len(own):
                self.children.append(Node(points, own, c))

    def parts(self) -> list[Node]:
        return self.children or [self]


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the ``k`` best of ``data`` for each query, rows of its own id aside."""
    found = bests(queries, query_ids, data, data_ids, data_ids, k)
    return [(int(query_ids[i]), v, s) for i, few in enumerate(found) for v, s in few]


def bests(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_ids: np.ndarray, data_rows: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the (vec_id, score) of the ``k`` best of ``data``, but for the query's own row.

    Both sides are cover trees. A pair of nodes is pruned where no member of the one can score with a member of the
    other what the worst of the query node's queries already has as its k-th: the bound is
    c.d + r|d| + s|c| + rs for balls of centres c, d and radii r, s. A bound that equals it stays, for ties.
    """
    order = np.argsort(data_ids, kind="stable")
    data, data_ids, data_rows = data[order], data_ids[order], data_rows[order]
    q, d = queries.astype(np.float64), data.astype(np.float64)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(q.shape[1], 1) < 2**52
    best: list[list[tuple[int, int]]] = [[] for _ in query_rows]  # (-score, vec_id), best first
    kth = np.full(len(query_rows), -math.inf)
    qt, dt = Node(q, np.arange(len(q)), 0), Node(d, np.arange(len(d)), 0)

    def bound(a: Node, b: Node) -> float:
        x = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return x + 1e-9 * (abs(x) + (a.norm + a.radius) * (b.norm + b.radius)) + 1e-6

    def leaves(a: Node, b: Node) -> None:
        rows = np.sort(b.members)
        scores = q[a.members] @ d[rows].T if exact else queries[a.members].astype(object) @ data[rows].T.astype(object)
        for i, line in zip(a.members, scores, strict=True):
            hits = np.flatnonzero(line >= kth[i])
            hits = hits[data_rows[rows[hits]] != query_rows[i]]
            if not len(hits):
                continue
            if len(hits) > 4 * k:  # the k-th of these bounds what can stay; ties with it stay
                hits = hits[line[hits] >= np.partition(line[hits], len(hits) - k)[len(hits) - k]]
            best[i] = sorted(best[i] + [(-int(line[h]), int(data_ids[rows[h]])) for h in hits])[:k]
            if len(best[i]) == k:
                kth[i] = -best[i][-1][0]

    def visit(a: Node, b: Node) -> None:
        pairs = sorted(((bound(x, y), n, x, y) for n, (x, y) in enumerate((x, y) for x in a.parts() for y in b.parts())), key=lambda p: (-p[0], p[1]))
        for high, _, x, y in pairs:
            if high < x.worst:
                continue
            if x.children or y.children:
                visit(x, y)
            else:
                leaves(x, y)
            x.worst = float(kth[x.members].min())
        a.worst = float(kth[a.members].min())

    visit(qt, dt)
    if any(not -(1 << 63) <= s <= 1 << 63 for few in best for s, _ in few):
        raise ValueError("a score needs more than 64 bits")
    return [[(v, -s) for s, v in few] for few in best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query the ``k`` best of all other rows, ties to the smaller vec_id.

    Queries and data are dealt into blocks of bounded size by a hash of their row; each pair of a query block and a data
    block is searched by its trees, and each query's bests of all blocks are ranked. Every row is a candidate for every
    query but its own: rows of a repeated vec_id are queries and candidates each, and each query row has its ranks. Rows
    get a number for this when they are written to the shared folder. Vectors that are null or hold null or non-finite
    components take no part; a query is compared with vectors of its own length; a null vec_id takes no part. With fewer
    than ``k`` others, all are returned; no rows give no rows. Components beyond 2**62 after scaling, or a score beyond 64
    bits, fail the job. Other columns are not looked at, whatever their names.
    """
    base = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = written(base.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).withColumn("rid", F.monotonically_increasing_id()), "top-k-rows")
    base = base.withColumn("dim", F.size("v"))
    n, queries = base.select(F.count(F.lit(1)), F.count_if("q")).first()
    g, h = max(1, math.ceil(n / DATA_BLOCK)), max(1, math.ceil(queries / QUERY_BLOCK))
    block = F.xxhash64("rid")
    left = base.filter("q").select("dim", F.pmod(block, F.lit(h)).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("g"), "vec_id", "rid", "v")
    right = base.select("dim", F.pmod(block, F.lit(g)).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))).alias("h"), "vec_id", "rid", "v")

    def pair(q: pa.Table, d: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        (qv, qi, qr), (dv, di, dr) = _matrix(q), _matrix(d)
        if len(qi) and len(di):
            found = [(i, v, s) for i, few in enumerate(bests(qv, qr, dv, di, dr, k)) for v, s in few]
        at, vec, score = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ([], [], [])))
        return pa.table({"rid": qr[at] if len(at) else at, "query_id": qi[at] if len(at) else at, "vec_id": vec, "score": score})

    found = left.groupBy("dim", "h", "g").cogroup(right.groupBy("dim", "h", "g")).applyInArrow(pair, "rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.int64), t.column("vec_id").to_numpy(), t.column("rid").to_numpy()


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 10
"""
