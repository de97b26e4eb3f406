"""Whitening of embeddings: exact characteristic polynomial of the integer scatter, real roots isolated, null vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Decimal digits that roots and null vectors are computed with, and binary digits to which roots are narrowed.
DIGITS, ROOT_BITS = 110, 320
#: Rows whose outer products one matrix multiplication adds; moduli of one task.
SCATTER_ROWS, TASK_PRIMES = 4096, 8

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * x) + shift of every component, within 2**60; null where the vector or a component is null or not finite."""
    high = F.lit(1 << 60)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"), high), -high) + F.lit(shift)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def scatter(fit: DataFrame, width: int, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the sums of products of the x - shift, exactly.

    Each run of rows adds its products by float64 matrix multiplication, which is exact as long as no sum of them reaches
    2**53, and in whole numbers of any size where one might. Spark sums the entries; their number is the vectors' width
    squared, whatever the rows.
    """
    at = [(i, j) for i in range(width) for j in range(i, width)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, pairs = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for begin in range(0, batch.num_rows, SCATTER_ROWS):
                y = _matrix(batch.column(0).slice(begin, SCATTER_ROWS), width) - shift
                high = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
                if high * high * len(y) < 2**53:
                    z = y.astype(np.float64)
                    pairs = pairs + (z.T @ z).astype(np.int64).astype(object)
                    sums = sums + y.sum(0).astype(object)
                else:
                    z = y.astype(object)
                    pairs, sums = pairs + z.T @ z, sums + z.sum(0)
                n += len(y)
        rows = [(-1, n)] + [(k, s) for k, s in enumerate(sums)] + [(width + k, pairs[i, j]) for k, (i, j) in enumerate(at)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([Decimal(int(v)) for _, v in rows], pa.decimal128(38, 0))], ["k", "v"])

    found = {r.k: int(r.v) for r in fit.select("x").mapInArrow(products, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    full = [[0] * width for _ in range(width)]
    for k, (i, j) in enumerate(at):
        full[i][j] = full[j][i] = found[width + k]
    return found[-1], [found[k] for k in range(width)], full


def prime_below(top: int) -> int:
    """The largest prime under ``top``, by the bases that settle Miller and Rabin's test below 3.4e14."""
    for p in range(top - 1, 2, -1):
        if p % 2 and all(_passes(p, a) for a in (2, 3, 5, 7, 11, 13, 17) if a < p):
            return p
    return 2


def _passes(p: int, a: int) -> bool:
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    x = pow(a, d, p)
    if x in (1, p - 1):
        return True
    for _ in range(s - 1):
        x = x * x % p
        if x == p - 1:
            return True
    return False


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """det(t I - matrix) modulo a prime below 2**31, highest power first: by similarity to a Hessenberg matrix."""
    h, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1 :, k]) + k + 1
        if not len(rows):
            continue
        pivot = int(rows[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        if factor.any():
            h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
            # each product is reduced before the sum, which so stays far below 2**63
            h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    poly = [np.ones(1, np.int64)]  # of the leading blocks, lowest power first
    for m in range(d):
        now = np.zeros(m + 2, np.int64)
        now[1:] = poly[m]
        now[:-1] = (now[:-1] - int(h[m, m]) * poly[m]) % p
        below = 1
        for i in range(m - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            now[: i + 1] = (now[: i + 1] - int(h[i, m]) * below % p * poly[i]) % p
        poly.append(now)
    return [int(c) for c in poly[d][::-1]]


def characteristic_polynomial(fit: DataFrame, matrix: list[list[int]]) -> list[int]:
    """The whole coefficients of det(t I - matrix), highest power first, of a symmetric matrix without negative roots.

    The k-th is at most binomial(d, k) * (trace / d)**k, so that many primes below 2**31 settle it; each prime is
    reduced in a task of Spark, and the residues are brought together by Chinese remaindering.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(2 * math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes, product = [], 1
    while product <= 2 * bound:
        primes.append(prime_below(primes[-1] if primes else 2**31))
        product *= primes[-1]
    spark = fit.sparkSession

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own = np.array([[v % p for v in row] for row in matrix], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([polynomial_mod(own, p)], pa.list_(pa.int64()))], ["p", "c"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // TASK_PRIMES))
    residues = {r.p: r.c for r in dealt.mapInArrow(reduce, "p long, c array<long>").collect()}  # width + 1 numbers a prime
    out, modulus = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(modulus, -1, p)
        out = [c + modulus * ((r - c) * inverse % p) for c, r in zip(out, residues[p], strict=True)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


def roots_above(poly: list[int], at: int, shift: int) -> int:
    """How many roots of a polynomial with real roots alone lie above at / 2**shift: the sign changes of p(t + at)."""
    c = [v << (shift * k) for k, v in enumerate(poly)]
    n, signs = len(c), []
    for i in range(n):  # repeated synthetic division; the last of each round is a coefficient of the shifted polynomial
        for j in range(1, n - i):
            c[j] += at * c[j - 1]
        if c[n - 1 - i]:
            signs.append(c[n - 1 - i] > 0)
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], most: int) -> list[tuple[Decimal, int]]:
    """The largest positive roots with how often they occur, until ``most`` are counted; the polynomial has real roots alone.

    Intervals are halved and their roots counted exactly, until each holds one root, or several that agree to
    ROOT_BITS binary digits and so are one. A single root is then narrowed by the polynomial's sign.
    """
    high = max(1, -poly[1]) if len(poly) > 1 else 1  # the trace: no root of a matrix without negative roots is above
    bits = high.bit_length()
    out: list[tuple[Decimal, int]] = []
    # (low, high, shift, roots above low, roots above high): the roots in (low, high] / 2**shift
    above_zero = roots_above(poly, 0, 0)
    work = [(0, 1 << bits, 0, above_zero, 0)]
    with localcontext() as context:
        context.prec = DIGITS
        while work and sum(m for _, m in out) < most:
            a, b, s, na, nb = work.pop()
            if na == nb:
                continue
            if na - nb == 1 or (b - a == 1 and a.bit_length() >= ROOT_BITS):
                a, b, s = _narrowed(poly, a, b, s) if na - nb == 1 else (a, b, s)
                out.append((Decimal(a + b) / Decimal(1 << (s + 1)), na - nb))
                continue
            if b - a == 1:
                a, b, s = 2 * a, 2 * b, s + 1
            mid = (a + b) // 2
            nm = roots_above(poly, mid, s)
            work += [(a, mid, s, na, nm), (mid, b, s, nm, nb)]  # the upper half is taken first
    return out


def _narrowed(poly: list[int], a: int, b: int, s: int) -> tuple[int, int, int]:
    """The interval (a, b] / 2**s of one root, halved until it has ROOT_BITS binary digits."""

    def sign(x: int, shift: int) -> int:
        v, unit = 0, 0
        for c in poly:
            v = v * x + (c << unit)
            unit += shift
        return (v > 0) - (v < 0)

    right = sign(b, s)
    if not right:
        return b, b, s
    while b.bit_length() < ROOT_BITS:
        a, b, s = 2 * a, 2 * b, s + 1
        mid = (a + b) // 2
        if b - a > 1:
            at = sign(mid, s)
            if not at:
                return mid, mid, s
            a, b = (a, mid) if at == right else (mid, b)
    while b - a > 1:
        mid = (a + b) // 2
        at = sign(mid, s)
        if not at:
            return mid, mid, s
        a, b = (a, mid) if at == right else (mid, b)
    return a, b, s


def null_vectors(matrix: list[list[int]], root: Decimal, times: int) -> list[np.ndarray]:
    """``times`` orthogonal unit vectors that the matrix takes to ``root`` times themselves, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= root
        tiny = abs(root) * Decimal(10) ** (5 - DIGITS) + Decimal(10) ** -DIGITS
        order = np.arange(d)
        for k in range(d):  # elimination with row pivots; the factors stay below the diagonal
            best = max(range(k, d), key=lambda r: abs(a[r, k]))
            if best != k:
                a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k, None] * a[k, k + 1 :]

        def solved(v: np.ndarray) -> np.ndarray:
            x = v[order].copy()
            for k in range(1, d):
                x[k] -= a[k, :k] @ x[:k]
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / a[k, k]
            return x

        rng, out = np.random.default_rng(20250611), []
        for _ in range(times):
            v = np.array([Decimal(int(x)) for x in rng.integers(1, 1 << 30, d)], object)
            for _ in range(3):
                for _ in range(2):  # twice, so that what rounding leaves goes too
                    for u in out:
                        v = v - (u @ v) * u
                v = v / (v @ v).sqrt()
                v = solved(v)
            for _ in range(2):
                for u in out:
                    v = v - (u @ v) * u
            v = v / (v @ v).sqrt()
            out.append(v if v[max(range(d), key=lambda i: abs(v[i]))] > 0 else -v)
        return out


def components(fit: DataFrame, width: int, shift: int, most: int) -> dict:
    """n, sums, and up to ``most`` unit eigenvectors of the covariance with their eigenvalues' share of the trace.

    n**2 times the covariance is a matrix of whole numbers; its roots and null vectors are the covariance's, times n**2.
    """
    n, sums, pairs = scatter(fit, width, shift)
    matrix = [[n * pairs[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    trace = sum(matrix[i][i] for i in range(width))
    out = {"n": n, "sums": [s + n * shift for s in sums], "vectors": np.zeros((0, width)), "scales": np.zeros(0), "explained": []}
    if trace == 0:
        return out
    vectors, scales, explained = [], [], []
    with localcontext() as context:
        context.prec = DIGITS
        for root, times in largest_roots(characteristic_polynomial(fit, matrix), min(most, width)):
            for v in null_vectors(matrix, root, times)[: most - len(vectors)]:
                vectors.append([float(x) for x in v])
                scales.append(float(Decimal(n) / root.sqrt()))
                explained.append(float(root / trace))
    return out | {"vectors": np.array(vectors), "scales": np.array(scales), "explained": explained}


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where these hold it, else as Python's."""
    high = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * high < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(u: np.ndarray) -> list[int]:
    high = max(abs(int(u.max(initial=0))), abs(int(u.min(initial=0))))
    if high * high * max(u.shape[1], 1) < 2**63 and u.dtype != object:
        return (u * u).sum(1).tolist()
    return (u.astype(object) ** 2).sum(1).tolist()


def projected(u: np.ndarray, fitted: dict) -> np.ndarray:
    return (u.astype(np.float64) / fitted["n"]) @ fitted["vectors"].T * fitted["scales"]


def identity_error(fit: DataFrame, width: int, fitted: dict) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened vectors, minus the identity.

    Rows are centred by S / n before they are projected and multiplied; sums of products meet in Spark.
    """
    k = len(fitted["vectors"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = projected(centred(_matrix(batch.column(0), width), fitted["n"], fitted["sums"]), fitted)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["k", "v"])

    sums = {r.k: r.v for r in fit.select("x").mapInArrow(products, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return max(abs(sums[i * k + j] / fitted["n"] - (i == j)) for i in range(k) for j in range(k))


def whitened(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component.

    Each entry c becomes floor(scale * c) + shift. The fit list, each distinct vector once, is written to the shared
    folder; its scatter is summed exactly, and the characteristic polynomial of that whole matrix is exact: modulo primes
    by Hessenberg reduction in tasks, then by Chinese remaindering. Its largest roots are isolated by exact counts of sign
    changes and narrowed to 320 binary digits; the vectors are null vectors by inverse iteration with 110 decimal digits.
    Only numbers in the size of the width squared reach the driver. Equal roots get orthogonal vectors of their space.

    Vectors that are null or hold null or non-finite entries take no part; repeated rows and vec_ids, and null vec_ids,
    are whitened each. Vectors of each length are a space of their own with its own fit list; at most 64 lengths may
    occur. Components with eigenvalue 0 have no whitened value and are left out, so one distinct vector alone, vectors
    without entries, or no rows, give no rows. Other columns aren't looked at. A deviation beyond 64 bits fails the job, and
    so do entries beyond 2**53, which a double doesn't hold exactly.
    """
    bounded_batches(vectors.sparkSession)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale, shift).alias("x")).filter("x is not null").withColumn("width", F.size("x"))
    fit = written(base.select("width", "x").distinct(), "whitening-fit", compression="zstd")
    shape: list[Row] = fit.groupBy("width").agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("high")).orderBy("width").limit(65).collect()
    if len(shape) > 64 or any(r.high is not None and r.high >= 2**53 for r in shape):
        raise ValueError("vectors of more than 64 lengths, or with entries beyond 2**53")
    out = None
    for width in (r.width for r in shape if r.width):
        own = fit.filter(F.col("width") == width)
        fitted = components(own, width, shift, most)
        if not fitted["explained"]:
            continue
        rows = base.filter(F.col("width") == width).select("vec_id", "x").mapInArrow(_rows(width, fitted, identity_error(own, width, fitted)), WHITENED)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else vectors.sparkSession.createDataFrame([], WHITENED)


def _rows(width: int, fitted: dict, error: float):
    k = len(fitted["explained"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SCATTER_ROWS):
                part = batch.slice(begin, SCATTER_ROWS)
                u, m = centred(_matrix(part.column(1), width), fitted["n"], fitted["sums"]), part.num_rows
                each = np.repeat(np.arange(m), k)
                deviation = pa.array(deviations(u), pa.int64()).take(pa.array(each))
                columns = [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted["n"], np.int64)), deviation]
                columns += [pa.array(projected(u, fitted).ravel()), pa.array(np.tile(np.array(fitted["explained"]), m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows
