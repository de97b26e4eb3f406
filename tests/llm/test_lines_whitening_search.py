import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.llm import lexical, line_dedup, queries, whitening

SF = "/root/testdata/sf0.001"


# line dedup


def plain_line_dedup(texts, least_docs, least_chars):
    white = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(white))
    n = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least_docs or len(key(x)) < least_chars]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("least_docs", "least_chars"), [(10, 1), (2, 1), (2, 5), (3, 0)])
def test_line_dedup_equals_a_plain_count(spark, odd_documents, monkeypatch, least_docs, least_chars):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", 6000)
    lines = ["", " ", "Common LINE", "common line\r", "\tcommon line ", "É", "é", "ÀB", "Àb ", "ab", "x" * 300, "\x1ccommon line"]
    rng = np.random.default_rng(3)
    rows = [(int(i % 40) if i % 7 else None, "\n".join(rng.choice(lines, rng.integers(1, 6))), "clash", i) for i in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string, block string, shard long").repartition(5)
    for docs in (more, more.limit(0), odd_documents.unionByName(odd_documents)):
        held = docs.select("doc_id", "text").collect()
        want = sorted(((r.doc_id, *w) for r, w in zip(held, plain_line_dedup([r.text for r in held], least_docs, least_chars), strict=True)), key=str)
        got = sorted(map(tuple, line_dedup.without_common_lines(docs, least_docs, least_chars).collect()), key=str)
        assert got == want


def test_perfect_hash_is_minimal_and_counts_saturate():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        high, low = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 32, n).astype(np.uint64)
        if n > 10:
            high[5] = high[6]  # the low bits still tell them apart
        sizes, bits = line_dedup.perfect_hash(high, low)
        assert sorted(line_dedup.slots(sizes, bits, high, low).tolist()) == list(range(n))
        assert 8 * len(bits) <= 4 * n + 64 * 20
        times = np.arange(n) * 7
        row = line_dedup.built(3, np.tile(high, 2), np.tile(low, 2), np.tile(times, 2))
        assert line_dedup.probed(row, high, low).tolist() == np.minimum(2 * times, 65535).tolist()
        if n == 50_000:  # other lines: a fingerprint lets one in 65,536 through
            other = rng.integers(0, 1 << 63, n).astype(np.uint64)
            assert np.count_nonzero(line_dedup.probed(row, other, low)) < 20


def test_line_dedup_query_gives_digests_of_kept_texts(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(held, plain_line_dedup([r.text for r in held], 10, 1), strict=True)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, SF).collect()} == want


# whitening


def exact_polynomial(m):
    """Faddeev and LeVerrier, in fractions."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][x] * b[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(m[i][x] * b[x][i] for x in range(d)) for i in range(d)) / k)
    return [int(x) for x in c]


def test_polynomial_modulo_primes_and_roots():
    rng = np.random.default_rng(1)
    for d, zeros in ((1, False), (2, True), (5, False), (8, True)):
        a = rng.integers(-50, 50, (d + 2, d))
        if zeros:
            a[:, d // 2] = 0
        m = (a.T @ a).tolist()
        poly, p = exact_polynomial(m), whitening.prime_below(2**31)
        assert whitening.polynomial_mod(np.array(m, np.int64) % p, p) == [c % p for c in poly]
        roots = [float(r) for r, times in whitening.largest_roots(poly, d) for _ in range(times)]
        want = [e for e in np.linalg.eigvalsh(np.array(m, float))[::-1] if e > 1e-6]
        assert np.allclose(roots, want, rtol=1e-9)
    # roots 5, 5 and 3, 0: one interval for the equal ones
    assert [(round(r), n) for r, n in whitening.largest_roots([1, -13, 55, -75, 0], 4)] == [(5, 2), (3, 1)]
    assert whitening.prime_below(100) == 97
    # roots 2**-40 apart are told apart
    near = [1 << 40, -((2 << 40) + 1), (1 << 40) + 1]
    assert [n for _, n in whitening.largest_roots([1, -near[0] * 2 - 1, near[0] * (near[0] + 1)], 2)] == [1, 1]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, width int")


def test_whitening_equals_numpy_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([np.floor(64 * np.array(r.embedding, np.float64)) + 1_000_000 for r in rows]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    got = queries.op12_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) <= 1e-9
    deviation = {r.vec_id: sum(int(u) ** 2 for u in n * v - s) for r, v in zip(rows, x, strict=True)}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    for c in range(16):
        e, v = values[-1 - c], vectors[:, -1 - c]
        own = {r.vec_id: r for r in got if r.component == c + 1}
        want = (x - s / n) @ v / math.sqrt(e)
        here = np.array([own[r.vec_id].whitened for r in rows])
        assert np.allclose(here * np.sign(here @ want), want, atol=1e-8)
        assert math.isclose(own[rows[0].vec_id].explained, e / values.sum(), rel_tol=1e-9)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(v) for v in rng.normal(size=3)] + [0.5], "clash", 1) for i in range(40)]
    odd = [(100, None, "a", 1), (101, [1.0, None, 2.0, 3.0], "a", 1), (102, [1.0, nan, 2.0, 3.0], "a", 1), (103, [inf, 0.0, 0.0, 0.0], "a", 1), (104, [], "a", 1), (None, good[0][1], "a", 1), (5, good[3][1], "a", 1)]
    got = whitening.whitened(embeddings(spark, good + odd + good[:2]), 16).collect()
    # the constant entry has no component; repeated rows and the null id are whitened each, but fitted once
    assert {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {40} and len(got) == 3 * 44
    # a second length is a space of its own, an only vector gives nothing, huge entries are exact or refused
    pair = [(200, [1.0, 2.0], "b", 1), (201, [3.0, 2.0], "b", 1), (202, [7.0], "b", 1)]
    got = [r for r in whitening.whitened(embeddings(spark, good + pair), 2).collect() if r.vec_id >= 200]
    assert [(r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9), r.explained) for r in sorted(got)] == [(200, 1, 2, 128**2, -1.0, 1.0), (201, 1, 2, 128**2, 1.0, 1.0)]
    large = [(i, [float(v) * 2.0**20, float(v), 1.0], "c", 1) for i, v in enumerate(range(3))]
    assert sorted((r.vec_id, r.deviation, round(r.whitened * r.whitened, 6)) for r in whitening.whitened(embeddings(spark, large), 3).collect() if r.component == 1)[1] == (1, 0, 0.0)
    assert whitening.whitened(embeddings(spark, []), 2).collect() == []
    assert whitening.whitened(embeddings(spark, [(1, [1.0, 2.0], "d", 1)]), 2).collect() == []
    with pytest.raises(ValueError, match="beyond"):
        whitening.whitened(embeddings(spark, [(1, [1e30], "d", 1), (2, [1.0], "d", 1)]), 2)


def test_equal_eigenvalues_get_orthogonal_vectors(spark):
    corners = [(i, [float(a), float(b), float(c)], "x", 1) for i, (a, b, c) in enumerate((a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1))]
    got = whitening.whitened(embeddings(spark, corners), 16).collect()
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i] for i in range(8)])
    assert w.shape == (8, 3) and np.allclose(w.T @ w / 8, np.eye(3), atol=1e-12)
    assert {round(r.explained, 12) for r in got} == {round(1 / 3, 12)} and got[0].identity_error < 1e-12


# ranked search


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def plain_search(docs, items, k):
    held = [(i, [t for t in plain_terms(x) if t]) for i, x in docs]
    held = [(i, t) for i, t in held if t]
    n, total, out = len(held), sum(len(t) for _, t in held), []
    wanted = {}
    for i, x in items:
        wanted.setdefault(i, set()).update(t for t in plain_terms(x) if t)
    for item, terms in wanted.items():
        scores = []
        for i, own in held:
            m, s = 100 - 90 + (90 * len(own) * n) // total, 0
            for t in terms & set(own):
                df = sum(t in o for _, o in held)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * own.count(t)) // (1000 * own.count(t) + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_ranked_search_equals_a_plain_one(spark, odd_documents, monkeypatch):
    words = ["the", "The", "cat", "sat", "é", "É", "naïve", "x9", "9", "中文", "straße", "-", "...", "a_b", "q\u0085r"]
    rng = np.random.default_rng(4)
    rows = [(int(i % 45) if i % 11 else None, " ".join(rng.choice(words, rng.integers(0, 9))) if i % 9 else None, "clash", i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, term long")
    items = spark.createDataFrame([(1, "The cat, the é", 0), (2, "naïve 9", 0), (2, "a b c", 0), (3, None, 0), (4, "... -", 0), (5, "unheard", 0), (None, "sat", 0), (7, " ".join(words), 0)], "item_id long, text string, score int")
    for own, k in ((docs.repartition(6), 10), (docs, 3), (docs.limit(0), 10), (odd_documents, 10)):
        want = plain_search([(r.doc_id, r.text) for r in own.collect()], [(r.item_id, r.text) for r in items.collect()], k)
        for block, tile, dense in ((4096, 64, 512), (2, 2, 7)):
            monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
            monkeypatch.setattr(lexical, "TILE_ITEMS", tile)
            monkeypatch.setattr(lexical, "TILE_DOCS", dense)
            assert sorted(map(tuple, lexical.ranked(own, items, k).collect()), key=str) == want
    assert lexical.ranked(docs, items.limit(0)).collect() == []


def test_sums_that_could_reach_two_to_the_53_are_cut():
    w = np.array([[2.0**31, 2.0**31, 1.0, 2.0**33], [0.0, 1.0, 1.0, 1.0]])
    cuts = lexical.tile_columns(w)
    assert [(c.start, c.stop) for c in cuts] == [(0, 2), (2, 3), (3, 4)] or all((w[:, c] * lexical.MOST_IMPACT).sum(1).max() < 2**53 or c.stop - c.start == 1 for c in cuts)
    assert [j for c in cuts for j in range(c.start, c.stop)] == [0, 1, 2, 3]
    long = lexical.impacts(np.array([2**60, 3]), np.array([1, 2]), np.array([0, 1]), 100, 2**61)
    assert long.tolist() == [10**9 // (1000 + 8 * (10 + 90 * 2**60 * 100 // 2**61)), 2 * 10**9 // (2000 + 80)]


def test_ranked_search_query_equals_a_plain_one(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    few = items.filter(F.col("item_id") < 3)
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in few.collect()], 10)
    assert sorted((tuple(r) for r in queries.op13_ranked_search(spark, SF).filter("item_id < 3").collect()), key=str) == want
