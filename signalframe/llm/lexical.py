"""Ranked lexical search: tiles of item weights times tiles of document impacts in float64, exact below 2**53."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discarded, text_chunks, written

#: Items of a block, whose terms every task holds; items and documents of a tile; documents a packed row holds at most.
BLOCK_ITEMS, TILE_ITEMS, TILE_DOCS, PACK_DOCS = 4096, 64, 512, 4096
#: The largest impact a document can give a term: 1000000000 * tf div (1000 * tf + 8 * m) with m of 10 at least.
MOST_IMPACT = 10**6

PACKED = "ids binary, known binary, sizes binary, starts binary, terms binary, counts binary, docs long, total long, df array<struct<term:int,docs:long>>"
FOUND = "item_id long, doc_id long, score long, dealt int"

# bytes of a term stay, A-Z lower-cased; the ASCII bytes that no term holds become spaces
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters and digits and of all code points from 128."""
    return text.translate(_TERM).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def tile_columns(weights: np.ndarray) -> list[slice]:
    """Cut an (items, terms) weight tile so that no sum of weight times impact within a cut reaches 2**53."""
    cuts, begin, load = [], 0, np.zeros(len(weights))
    for j in range(weights.shape[1]):
        if j > begin and (load + weights[:, j] * MOST_IMPACT).max() >= 2**53:
            cuts.append(slice(begin, j))
            begin, load = j, np.zeros(len(weights))
        load = load + weights[:, j] * MOST_IMPACT
    return [*cuts, slice(begin, weights.shape[1])]


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best positive scores, ties by known and then smaller id: all that tie with the k-th are weighed."""
    hits = np.flatnonzero(scores > 0)
    if len(hits) > k:
        hits = hits[scores[hits] >= np.partition(scores[hits], len(hits) - k)[len(hits) - k]]
    return hits[np.lexsort((ids[hits], ~known[hits], -scores[hits]))[:k]]


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Packed rows of the documents' counts of the vocabulary's terms, with the pack's share of N, L and df.

    A pack holds about 1 MB of text, or one longer document; a document without any term is in none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()) if not pa.types.is_binary(batch.column(1).type) else batch.column(1)
            for i, j, data, at in text_chunks(raw):
                blob, rows = data.tobytes(), []
                for r in range(j - i):
                    words = terms(blob[at[r] : at[r + 1]])
                    if not words:
                        continue
                    tf: dict[int, int] = {}
                    for t in filter(None, map(vocabulary.get, words)):
                        tf[t] = tf.get(t, 0) + 1
                    rows.append((batch.column(0)[i + r].as_py(), len(words), tf))
                for k in range(0, len(rows), PACK_DOCS):
                    yield _packed(rows[k : k + PACK_DOCS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, PACKED)


def _packed(rows: list[tuple[int | None, int, dict[int, int]]]) -> pa.RecordBatch:
    n = np.array([len(tf) for _, _, tf in rows], np.int64)
    term = np.fromiter(chain.from_iterable(tf for _, _, tf in rows), np.int32, int(n.sum()))
    tf = np.fromiter(chain.from_iterable(tf.values() for _, _, tf in rows), np.int64, int(n.sum()))
    df_terms, df = np.unique(term, return_counts=True)
    arrays = [np.array([i or 0 for i, _, _ in rows], np.int64), np.array([i is not None for i, _, _ in rows]), np.array([s for _, s, _ in rows], np.int64), np.concatenate([[0], np.cumsum(n)]), term, tf]
    kind = pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())]))
    columns = [pa.array([a.tobytes()], pa.binary()) for a in arrays] + [pa.array([len(rows)]), pa.array([int(arrays[2].sum())]), pa.array([[{"term": int(t), "docs": int(c)} for t, c in zip(df_terms, df, strict=True)]], kind)]
    return pa.RecordBatch.from_arrays(columns, ["ids", "known", "sizes", "starts", "terms", "counts", "docs", "total", "df"])


def impacts(sizes: np.ndarray, tf: np.ndarray, owner: np.ndarray, n: int, total: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) of each count, in whole numbers."""
    if len(sizes) and 90 * int(sizes.max()) * n < 2**63:
        m = 10 + (90 * sizes * n) // total
    else:
        m = np.array([10 + 90 * s * n // total for s in sizes.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])


def scored(packs: DataFrame, items: list[tuple[int | None, list[int]]], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score, dealt): each task's ``k`` best documents of every item.

    ``items`` have the vocabulary's term numbers. Items go in tiles with the terms that these hold; documents in tiles of
    at most TILE_DOCS, as a dense matrix of impacts of the terms that both tiles hold. Their product is a float64 matrix
    multiplication of whole numbers whose partial sums stay below 2**53, so it is exact in any order of summation.
    """
    tiles = []
    for begin in range(0, len(items), TILE_ITEMS):
        rows = items[begin : begin + TILE_ITEMS]
        vocabulary = np.array(sorted({t for _, own in rows for t in own}), np.int64)
        w = np.zeros((len(rows), len(vocabulary)))
        for r, (_, own) in enumerate(rows):
            at = np.searchsorted(vocabulary, own)
            w[r, at] = weights[own]
        tiles.append((begin, vocabulary, w))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, sizes, starts, term, tf = (np.frombuffer(row[c], kind) for c, kind in (("ids", np.int64), ("known", bool), ("sizes", np.int64), ("starts", np.int64), ("terms", np.int32), ("counts", np.int64)))
                owner = np.repeat(np.arange(len(ids)), np.diff(starts))
                impact = impacts(sizes, tf, owner, n, total).astype(np.float64)
                for a in range(0, len(ids), TILE_DOCS):
                    b = min(a + TILE_DOCS, len(ids))
                    own = slice(int(starts[a]), int(starts[b]))
                    _multiply(tiles, kept, ids[a:b], known[a:b], term[own], owner[own] - a, impact[own], k)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows = [(items[i][0], int(d) if known else None, int(s), part) for i, best_ in enumerate(kept) for s, d, known in zip(*best_, strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["item_id", "doc_id", "score", "dealt"])

    return packs.select("ids", "known", "sizes", "starts", "terms", "counts").mapInArrow(score, FOUND)


def _multiply(tiles: list, kept: list, ids: np.ndarray, known: np.ndarray, term: np.ndarray, owner: np.ndarray, impact: np.ndarray, k: int) -> None:
    for begin, vocabulary, w in tiles:
        at = np.searchsorted(vocabulary, term)
        at[at == len(vocabulary)] = 0
        hit = vocabulary[at] == term
        if not hit.any():
            continue
        used, column = np.unique(at[hit], return_inverse=True)
        dense = np.zeros((len(used), len(ids)))
        dense[column, owner[hit]] = impact[hit]
        own, total = w[:, used], np.zeros((len(w), len(ids)), np.int64)
        for cut in tile_columns(own):
            total += (own[:, cut] @ dense[cut]).astype(np.int64)
        high = total.max(1)
        for r in np.flatnonzero(high > 0).tolist():
            s, d, o = kept[begin + r]
            if len(s) == k and high[r] < s[-1]:
                continue
            new = best(total[r], ids, known, k)
            s, d, o = np.concatenate([s, total[r, new]]), np.concatenate([d, ids[new]]), np.concatenate([o, known[new]])
            new = best(s, d, o, k)
            kept[begin + r] = s[new], d[new], o[new]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ties by smaller doc_id.

    Items are taken in blocks of about BLOCK_ITEMS; a block's terms and weights, bounded by its texts, go to every task.
    For each block one pass over the documents writes their counts of the block's terms, in packs of about 1 MB of text,
    with each pack's share of N, L and df; sums of these come to the driver, one for each term of the block. A second pass
    over the packs scores them. Of every task and item only ``k`` rows are shuffled, and these meet in two steps.

    Terms, weights and scores are as the README states; all but the logarithm is in whole numbers. A document with null
    or empty text, or without a term, counts nowhere. Every row is a document: repeated rows and doc_ids are ranked each;
    null doc_ids stand behind others of equal score. Rows of one item_id are one item with the terms of all; items
    without text or terms give no rows, and so do no documents. Other columns aren't looked at.
    """
    bounded_batches(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    parts = [_ranked_block(docs, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ranked_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    own: dict[int | None, set[bytes]] = {}
    for row in block.collect():  # a block of the stated query set
        own.setdefault(row.item_id, set()).update(terms(bytes(row.text)))
    vocabulary = {t: i + 1 for i, t in enumerate(sorted(set().union(*own.values())))}  # 0 stands for other words
    packs = written(counted(docs, vocabulary), "lexical-packs", compression="zstd")
    sums = packs.agg(F.sum("docs"), F.sum("total")).first()
    n, total = int(sums[0] or 0), int(sums[1] or 0)
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for row in packs.select(F.explode("df").alias("t")).groupBy("t.term").agg(F.sum("t.docs").alias("n")).collect():  # the block's terms
        df[row.term] = row.n
    weights = np.array([weight(n, int(x)) for x in df])
    numbered = sorted(((i, sorted(vocabulary[t] for t in words)) for i, words in own.items()), key=lambda x: (x[0] is None, x[0]))
    found = written(scored(packs, numbered, weights, n, total, k), "lexical-found")
    discarded(packs)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = Window.partitionBy("item_id", F.pmod("dealt", F.lit(64))).orderBy(*order)
    few = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
s AS (SELECT rid, count(*) AS n FROM w GROUP BY rid), g AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM s),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT rid, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM i) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, g GROUP BY term, big_n),
sc AS (SELECT item_id, rid, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l)))) AS BIGINT) AS score
       FROM i JOIN tf USING (term) JOIN df USING (term) JOIN s USING (rid), g GROUP BY item_id, rid),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
