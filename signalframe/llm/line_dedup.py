"""Line dedup: a sharded minimal perfect hash over distinct lines, with compact arrays that documents probe."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64

#: White space that a line's key loses at both ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Text of a block of documents, and text whose distinct lines share a shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 32 << 20
#: Bits of a level for each key that it takes; the rest of the keys go on to the next level.
BITS_A_KEY = 1.5

HASHES = "block long, shard long, high long, low long, n long"
INDEX = "shard long, keys long, sizes array<long>, bits binary, fingerprints binary, counts binary"
KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


def line_keys(text: bytes) -> list[bytes]:
    """The keys of a text's lines: white space off both ends, A-Z lower-cased."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode(errors="replace"))


def hashed(keys: list[bytes]) -> np.ndarray:
    """96 bits of each key: ``high`` of 64 and ``low`` of 32, as an (n, 2) array."""
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    both = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
    both[:, 1] >>= np.uint64(32)
    return both


def _spread(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(high + (low + np.uint64(level << 32)) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (_spread(high, low, 1 << 20) >> np.uint64(48)).astype("<u2")


def perfect_hash(high: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bits of each level, and all levels' bits as bytes: a key's bit is the first that is set among its levels' places.

    At each level the keys that have a place of their own take it; the others go on. The number of bits set before a
    key's bit is its slot, so n distinct keys have the slots 0 to n - 1 in about 3 bits each, without the keys.
    """
    left, sizes, bits = np.arange(len(high)), [], []
    while len(left):
        m = 64 * math.ceil(BITS_A_KEY * len(left) / 64)
        at = (_spread(high[left], low[left], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[at]]
    return sizes, np.concatenate([*bits, np.zeros(0, np.uint8)])


def slots(sizes: list[int], bits: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that isn't in the set gets any slot, or -1."""
    words = bits.view("<u8")
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=before[1:])
    out, left, base = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
    for level, m in enumerate(sizes):
        at = base + (_spread(high[left], low[left], level) % np.uint64(m)).astype(np.int64)
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        on = (word >> bit) & np.uint64(1) == 1
        rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[on]] = rank[on]
        left, base = left[~on], base + m
    return out


def built(shard: int, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> dict:
    """The index row of one shard: equal hashes are summed, counts stop at 65535."""
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, first) if len(first) else n
    high, low = high[first], low[first]
    sizes, bits = perfect_hash(high, low)
    at = slots(sizes, bits, high, low)
    prints, counts = np.zeros(len(at), "<u2"), np.zeros(len(at), "<u2")
    prints[at], counts[at] = fingerprints(high, low), np.minimum(total, 65535)
    return {"shard": shard, "keys": len(at), "sizes": sizes, "bits": bits.tobytes(), "fingerprints": prints.tobytes(), "counts": counts.tobytes()}


def probed(row: dict, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Counts of the keys in one shard's arrays; 0 where the fingerprint differs. Keys of the set get their own count."""
    at = slots(row["sizes"], np.frombuffer(row["bits"], np.uint8), high, low)
    prints, counts = (np.frombuffer(row[c], "<u2") for c in ("fingerprints", "counts"))
    if not len(counts):
        return np.zeros(len(high), np.int64)
    return np.where((at >= 0) & (prints[at] == fingerprints(high, low)), counts[at], 0).astype(np.int64)


def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block, doc_id, text as bytes), documents dealt into blocks of about 8 MB by a hash of id and text; and the shards."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(size / BLOCK_BYTES))))
    return texts.select(block.alias("block"), "doc_id", "text"), max(1, math.ceil(size / SHARD_BYTES))


def line_hashes(dealt: DataFrame, shards: int, least_chars: int = 1) -> DataFrame:
    """(block, shard, high, low, n): each different line of a block once, with the number of its documents there.

    So a line that stands in a third of all documents is one row a block. Lines of fewer than ``least_chars`` code points
    are left out.
    """

    def hash_lines(t: pa.Table) -> pa.Table:
        n: dict[bytes, int] = {}
        for text in t.column("text").to_pylist():
            for key in set(line_keys(text)):
                n[key] = n.get(key, 0) + 1
        keys = [k for k in n if _code_points(k) >= least_chars]
        both = hashed(keys)
        shard = (both[:, 0] >> np.uint64(16)) % np.uint64(shards)
        columns = [np.full(len(keys), t.column("block")[0].as_py(), np.int64), shard.astype(np.int64), both[:, 0].view(np.int64), both[:, 1].astype(np.int64), np.array([n[k] for k in keys], np.int64)]
        return pa.table(dict(zip(("block", "shard", "high", "low", "n"), map(pa.array, columns), strict=True)))

    return dealt.groupBy("block").applyInArrow(hash_lines, HASHES)


def line_index(hashes: DataFrame) -> DataFrame:
    """One row a shard: the minimal perfect hash of its distinct lines, with their fingerprints and document counts."""

    def build(t: pa.Table) -> pa.Table:
        row = built(t.column("shard")[0].as_py(), t.column("high").to_numpy().view(np.uint64), t.column("low").to_numpy().view(np.uint64), t.column("n").to_numpy())
        kinds = {"shard": pa.int64(), "keys": pa.int64(), "sizes": pa.list_(pa.int64()), "bits": pa.binary(), "fingerprints": pa.binary(), "counts": pa.binary()}
        return pa.table({name: pa.array([row[name]], kind) for name, kind in kinds.items()})

    return hashes.groupBy("shard").applyInArrow(build, INDEX)


def without_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept): each text without the lines whose key ``least_docs`` documents hold.

    A text is cut at newlines; a line's key is the line without white space (space, tab to carriage return) at its ends,
    A-Z lower-cased. Keys of fewer than ``least_chars`` code points stay. The other lines keep their order and their
    bytes and are joined by newlines.

    Three shuffles: documents go into blocks of about 8 MB of text; each block sends each of its different lines once, as
    96 bits of hash, to the line's shard; there the distinct hashes get a minimal perfect hash with arrays of 16-bit
    fingerprints and counts, which the blocks' hashes probe; what is common goes back to the blocks. As every line is in
    the index, a probe finds its own count; two lines are taken as equal if 96 bits of xxh3 agree. The number of blocks
    and shards follows the size of the text, so neither grows; lines that many documents hold are one row a block.

    Every row is a document: repeated rows, equal and null doc_ids count and are kept each. Null and empty texts are one
    empty line, which stays; long texts are taken whole. No rows give no rows. Other columns aren't looked at.
    ``least_docs`` may be 65535 at most.
    """
    if not 1 <= least_docs <= 65535:
        raise ValueError("least_docs must lie from 1 to 65535")
    dealt, shards = blocks(docs)
    hashes = line_hashes(dealt, shards, least_chars)

    def probe(t: pa.Table, index: pa.Table) -> pa.Table:
        if t.num_rows and index.num_rows:
            n = probed(index.to_pylist()[0], t.column("high").to_numpy().view(np.uint64), t.column("low").to_numpy().view(np.uint64))
            t = t.filter(pa.array(n >= least_docs))
        return t.select(["block", "high", "low"])

    def drop(t: pa.Table, common: pa.Table) -> pa.Table:
        gone = {(h & (1 << 64) - 1, low) for h, low in zip(common.column("high").to_pylist(), common.column("low").to_pylist(), strict=True)}
        known: dict[bytes, bool] = {}
        rows: list[tuple[int, int, bytes]] = []
        for text in t.column("text").to_pylist():
            lines = text.split(b"\n")
            if not gone:
                rows.append((len(lines), 0, text))
                continue
            keys = line_keys(text)
            new = list({k for k in keys if k not in known})
            known |= {k: (a, b) in gone and _code_points(k) >= least_chars for k, (a, b) in zip(new, hashed(new).tolist(), strict=True)}
            kept = [line for line, k in zip(lines, keys, strict=True) if not known[k]]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        n, dropped, kept = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"doc_id": t.column("doc_id"), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).view(pa.string())})

    index = line_index(hashes)
    common = hashes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "block long, high long, low long")
    return dealt.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(drop, KEPT)


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT rid, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
j AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j JOIN d ON j.rid = d.rid GROUP BY j.rid
"""
