"""Boosted trees by histograms: every level of every fold's tree is one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import dropped, kept

#: Gradients and hessians are whole numbers of this part, so that their sums don't depend on any order.
UNIT = 1 << 30
NONE = -(1 << 63)
#: The code of a missing value, which goes right at every split.
MISSING = 255
#: Bytes of a task's sums; more models than these hold are fitted in further passes. Trees after which scores are written.
SUM_BYTES, SCORES_EVERY = 64 << 20, 16

BINNED = "id long, grp long, only long, y int, codes binary, raw binary"
COLUMNS = ["id", "grp", "only", "y", "codes", "raw"]
SUMS = "model int, node int, feature int, bin int, g long, h long, n long"


@dataclass(frozen=True)
class Settings:
    """Rounds, depth, shrinkage, fewest rows of a leaf, L2 penalty of leaf values, least hessian of a leaf."""

    rounds: int = 120
    depth: int = 3
    rate: float = 0.06
    least: int = 8
    l2: float = 1.0
    least_hessian: float = 1e-3
    balanced: bool = True


@dataclass
class Tree:
    """Nodes as a heap: node i has the children 2 i + 1 and 2 i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64))

    def reached(self, codes: np.ndarray, depth: int) -> np.ndarray:
        node, each = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(depth):
            f = self.feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (codes[each, f] > self.bin[node]))
        return node


@dataclass
class Model:
    """One model: the group whose rows it didn't see (None: all are seen), the class weights, and its trees by round and class."""

    held: int | None
    weights: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def raw(self, codes: np.ndarray, begin: int = 0) -> np.ndarray:
        out = np.zeros((len(codes), len(self.trees[0]) if self.trees else 1))
        for own in self.trees[begin:]:
            for c, tree in enumerate(own):
                out[:, c] += tree.value[tree.reached(codes, _depth(tree))]
        return out

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """A column a class."""
        raw = self.raw(codes)
        if raw.shape[1] == 1:
            p = 1 / (1 + np.exp(-raw))
            return np.concatenate([1 - p, p], 1)
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _depth(tree: Tree) -> int:
    return len(tree.feature).bit_length() - 1


@dataclass
class Boosted:
    """Models by held-out group, with the features' edges and the number of classes."""

    models: list[Model]
    features: list[str]
    edges: list[list[float]]
    classes: int
    settings: Settings


def quantile_edges(rows: DataFrame, features: list[str], bins: int = 255) -> list[list[float]]:
    """At most ``bins`` - 1 edges a feature from one mergeable quantile sketch: a value belongs right of the edges below it."""
    at = [F.lit(k / bins) for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.array(*at), 100_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def even_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """``bins`` - 1 edges of equal distance between the least and the greatest value of each feature."""
    x = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    found = rows.agg(*[g(x[f]).alias(f"{n}_{f}") for f in features for n, g in (("low", F.min), ("high", F.max))]).first()
    out = []
    for f in features:
        low, high = found[f"low_{f}"], found[f"high_{f}"]
        out.append([] if low is None or low == high else [low + (high - low) * k / bins for k in range(1, bins)])
    return out


def _codes(columns: list[pa.Array], n: int, edges: list[list[float]]) -> np.ndarray:
    codes = np.empty((n, len(edges)), np.uint8)
    for k, (column, e) in enumerate(zip(columns, edges, strict=True)):
        x = column.to_numpy(zero_copy_only=False).astype(np.float64)
        codes[:, k] = np.where(np.isnan(x), MISSING, np.searchsorted(np.array(e), x, "left"))
    return codes


def binned(rows: DataFrame, features: list[str], edges: list[list[float]], group: str, y: str | None = "y", id_: str = "id", only: str | None = None) -> DataFrame:
    """(id, grp, only, y, codes, raw): each feature's bin as one byte; nulls and NaN have a code of their own."""
    if any(len(e) >= MISSING for e in edges):
        raise ValueError(f"a feature has more than {MISSING - 1} edges")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([r.tobytes() for r in _codes(batch.columns[4:], batch.num_rows, edges)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed, pa.array([b""] * batch.num_rows, pa.binary())], COLUMNS)

    mark, seen = F.col(y).cast("int") if y else F.lit(None).cast("int"), F.col(only).cast("long") if only else F.lit(None).cast("long")
    return rows.select(F.col(id_).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), seen.alias("only"), mark.alias("y"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]).mapInArrow(encode, BINNED)


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, the only model that sees a row, and codes; nulls are the least whole number, which no model holds out."""
    whole = lambda c: c.fill_null(NONE).to_numpy(zero_copy_only=False)
    codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, width)
    return whole(batch.column(1)), whole(batch.column(2)), codes


def _raw(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(5).to_pylist())).reshape(batch.num_rows, -1)


def gradients(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log loss by each raw score, in whole units: two classes have one score, more have one each."""
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw))
        d = p - (y == 1)[:, None]
    else:
        e = np.exp(raw - raw.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        d = p - (y[:, None] == np.arange(raw.shape[1]))
    return np.rint(d * weight[:, None] * UNIT).astype(np.int64), np.rint(p * (1 - p) * weight[:, None] * UNIT).astype(np.int64)


def level_sums(rows: DataFrame, models: list[Model], growing: list[list[Tree]], done: int, level: int, width: int, depth: int) -> DataFrame:
    """(model, node, feature, bin, g, h, n): what each task's rows add to the open nodes of a level of every growing tree.

    ``rows`` hold the raw scores after ``done`` rounds. A row adds to all models but that which holds its group out.
    """
    outputs, first, nodes = len(growing[0]), 2**level - 1, 2**level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), outputs, nodes, width, 256, 3), np.int64)
        for batch in batches:
            grp, only, codes = _unpacked(batch, width)
            y, stored = batch.column(3).to_numpy(zero_copy_only=False), _raw(batch) if done else None
            for m, model in enumerate(models):
                own = np.flatnonzero(only == NONE) if model.held is None else np.flatnonzero((grp != model.held) & ((only == NONE) | (only == model.held)))
                c, label = codes[own], y[own].astype(np.int64)
                raw = model.raw(c, done)
                if raw.shape[1] != outputs:
                    raw = np.zeros((len(own), outputs))
                if stored is not None:
                    raw = raw + stored[own, m * outputs : (m + 1) * outputs]
                g, h = gradients(raw, label, np.array(model.weights)[label])
                for k in range(outputs):
                    node = growing[m][k].reached(c, level) - first
                    open_ = np.flatnonzero(node >= 0)
                    at = node[open_] * 256
                    for f in range(width):
                        where = at + c[open_, f]
                        for s, v in enumerate((g[open_, k], h[open_, k], None)):
                            total[m, k, :, f, :, s] += np.bincount(where, v, nodes * 256).astype(np.int64).reshape(nodes, 256)
        m, k, node, f, b = np.nonzero(total[..., 2])
        v = total[m, k, node, f, b]
        columns = [(m * outputs + k).astype(np.int32), (node + first).astype(np.int32), f.astype(np.int32), b.astype(np.int32), v[:, 0], v[:, 1], v[:, 2]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["model", "node", "feature", "bin", "g", "h", "n"])

    return rows.mapInArrow(sums, SUMS)


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """(model, node, g, h, n, split): each node's sums and its best split, null where none gains; ties to the first feature, then bin.

    One shuffle by node and feature serves the sums, the running sums over bins and the feature's best; the nodes' best
    of all features meets in a second, of one row a feature.
    """
    by = ["model", "node", "feature"]
    bins = sums.repartition(*by).groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    up, every = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    for c in ("g", "h", "n"):
        bins = bins.withColumn(f"{c}l", F.sum(c).over(up)).withColumn(f"{c}a", F.sum(c).over(every))
    part = lambda g, h: (F.col(g) / UNIT) * (F.col(g) / UNIT) / (F.col(h) / UNIT + s.l2)
    bins = bins.withColumns({f"{c}r": F.col(f"{c}a") - F.col(f"{c}l") for c in ("g", "h", "n")})
    gain = part("gl", "hl") + part("gr", "hr") - part("ga", "ha")
    fits = (F.col("nl") >= s.least) & (F.col("nr") >= s.least) & (F.col("hl") / UNIT >= s.least_hessian) & (F.col("hr") / UNIT >= s.least_hessian) & (F.col("bin") != MISSING)
    bins = bins.withColumn("gain", F.when(fits, gain)).withColumn("order", F.when(F.col("gain") > 0, F.struct("gain", -F.col("feature"), -F.col("bin"))))
    split = F.when(F.col("gain") > 0, F.struct("feature", "bin", "gain", "gl", "hl", "nl"))
    top = lambda column: F.max_by(column, "order")
    each = bins.groupBy(*by).agg(F.first("ga").alias("g"), F.first("ha").alias("h"), F.first("na").alias("n"), F.max("order").alias("order"), top(split).alias("split"))
    return each.groupBy("model", "node").agg(F.max("g").alias("g"), F.max("h").alias("h"), F.max("n").alias("n"), F.max_by("split", "order").alias("split"))


def grown(rows: DataFrame, models: list[Model], done: int, width: int, outputs: int, s: Settings) -> list[list[Tree]]:
    """The next tree of every model: one pass over the rows for each level. Only nodes' best splits reach the driver."""
    trees = [[Tree.empty(s.depth) for _ in range(outputs)] for _ in models]
    value = lambda g, h: -s.rate * (g / UNIT) / (h / UNIT + s.l2)
    for level in range(s.depth):
        found = best_splits(level_sums(rows, models, trees, done, level, width, s.depth), s).collect()  # models times nodes
        split = False
        for r in found:
            tree = trees[r.model // outputs][r.model % outputs]
            tree.value[r.node], tree.rows[r.node] = value(r.g, r.h), r.n
            if r.split is not None:
                split = True
                left, right = 2 * r.node + 1, 2 * r.node + 2
                tree.feature[r.node], tree.bin[r.node], tree.gain[r.node] = r.split.feature, r.split.bin, r.split.gain
                tree.value[left], tree.rows[left] = value(r.split.gl, r.split.hl), r.split.nl
                tree.value[right], tree.rows[right] = value(r.g - r.split.gl, r.h - r.split.hl), r.n - r.split.nl
        if not split:
            break
    return trees


def with_raw(rows: DataFrame, models: list[Model], done: int, width: int, outputs: int) -> DataFrame:
    """The rows with the raw scores of all models after all their rounds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _unpacked(batch, width)[2]
            raw = np.concatenate([m.raw(codes, done) for m in models], 1) if batch.num_rows else np.zeros((0, len(models) * outputs))
            if done and batch.num_rows:
                raw = raw + _raw(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([r.tobytes() for r in raw], pa.binary())], COLUMNS)

    return rows.mapInArrow(add, BINNED)


def fitted(rows: DataFrame, features: list[str], *, group: str = "grp", hold_out: bool = False, classes: int = 2, bins: int = 255, edges: list[list[float]] | None = None, settings: Settings = Settings(), id_: str = "id", y: str = "y", only: str | None = None) -> Boosted:  # noqa: B008
    """Boosted trees on all rows, or with ``hold_out`` one model for each group that sees all rows but that group's.

    All models grow side by side: a level of all their trees is one pass over the rows, so the passes don't grow with the
    number of groups; sums of more than 64 MB a task are taken in several. Class weights, as n / (classes * n of the
    class), come from one count by group and class, less the group's own. A model whose rows have one class alone isn't
    fitted. The edges come from all rows, without their labels. Groups must be few, as each has a model on the driver.

    A row whose column ``only`` isn't null is there for the model that holds that group out alone: so rows may differ from
    fold to fold. Sums are of whole numbers, so the same rows give the same trees in any partitioning. Rows without y are left out;
    missing features go right at every split. A tree without any gain stays a leaf, and such rounds end the model.
    """
    s, edges = settings, edges if edges is not None else quantile_edges(rows, features, bins)
    work = kept(binned(rows.filter(F.col(y).isNotNull()), features, edges, group, y, id_, only), "boosted-rows")
    counts = work.groupBy("only", "grp", "y").agg(F.count(F.lit(1)).alias("n")).collect()  # groups times classes, by fold where rows differ
    groups = sorted({r.grp for r in counts if r.grp is not None}) if hold_out else [None]
    sizes = {(o, k): 0 for o in (None, *groups) for k in range(classes)}
    own = {(g, k): 0 for g in groups for k in range(classes)}
    for r in counts:
        sizes[r.only, r.y] += r.n if r.only is None or r.grp != r.only else 0
        if r.only is None and hold_out and r.grp is not None:
            own[r.grp, r.y] += r.n
    models = []
    for g in groups:
        n = [sizes[None, k] + (sizes[g, k] - own[g, k] if hold_out else 0) for k in range(classes)]
        if sum(x > 0 for x in n) > 1:
            models.append(Model(g, [sum(n) / (sum(x > 0 for x in n) * x) if s.balanced and x else 1.0 for x in n]))
    outputs = 1 if classes == 2 else classes
    most = max(1, SUM_BYTES // (outputs * 2 ** (s.depth - 1) * max(1, len(features)) * 256 * 24))
    for begin in range(0, len(models), most):
        some, rows_, done = models[begin : begin + most], work, 0
        for t in range(s.rounds):
            trees = grown(rows_, some, done, len(features), outputs, s)
            for m, own in zip(some, trees, strict=True):
                m.trees.append(own)
            if all(tree.feature[0] < 0 for own in trees for tree in own):
                break
            if (t + 1) % SCORES_EVERY == 0 and t + 1 < s.rounds:
                before, rows_ = rows_, kept(with_raw(rows_, some, done, len(features), outputs), "boosted-scores")
                done = t + 1
                if before is not work:
                    dropped(before)
        if rows_ is not work:
            dropped(rows_)
    dropped(work)
    return Boosted(models, features, edges, classes, s)


def appended(boosted: Boosted, rows: DataFrame, group: str | None = "grp", name: str = "p") -> DataFrame:
    """The rows with class probabilities by the model that held the row's group out, or by the only model.

    Rows may be another matrix than the one fitted, with the same features. A group whose model isn't there gets null.
    """
    by, columns = {m.held: m for m in boosted.models}, len(rows.columns)
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column(columns).fill_null(NONE).to_numpy(zero_copy_only=False)
            codes, out = _codes(batch.columns[columns + 1 :], batch.num_rows, boosted.edges), [None] * batch.num_rows
            for held, model in by.items():
                own = np.arange(len(grp)) if held is None else np.flatnonzero(grp == held)
                p = model.probabilities(codes[own])
                for i, v in zip(own.tolist(), p.tolist(), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:columns], name])

    of = F.col(group).cast("long") if group else F.lit(None).cast("long")
    return rows.select("*", of.alias("_grp"), *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(boosted.features)]).mapInArrow(score, schema)


def scored(boosted: Boosted, rows: DataFrame, *, group: str = "grp", id_: str = "id", only: str | None = None) -> DataFrame:
    """(id, grp, p) as ``appended``. Of rows that are there for one model alone, those of its own group are scored, and the others left out."""
    if only:
        rows = rows.filter(F.col(only).isNull() | (F.col(only) == F.col(group)))
    return appended(boosted, rows, group, "_p").select(F.col(id_).alias("id"), F.col(group).alias("grp"), F.col("_p").alias("p"))


def nodes(boosted: Boosted) -> list[tuple]:
    """(held, round, class, node, feature, bin, gain, n, value) of every node that rows reach, for a look at the trees."""
    return [
        (m.held, t, c, i, None if tree.feature[i] < 0 else boosted.features[tree.feature[i]], None if tree.feature[i] < 0 else int(tree.bin[i]), float(tree.gain[i]), int(tree.rows[i]), float(tree.value[i]))
        for m in boosted.models for t, own in enumerate(m.trees) for c, tree in enumerate(own) for i in np.flatnonzero(tree.rows > 0).tolist()
    ]
