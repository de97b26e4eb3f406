"""Removal of passages that earlier documents hold, byte for byte: column-wise construction over anchored segments.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id. Two equal
strings have the same anchor: the leftmost of their ``SEED``-byte substrings with the least hash. So the strings are
dealt by anchor, and only segments (the bytes around one anchor) that meet others are compared. Within a bucket the
segments, aligned at their anchors, are inserted column by column from the right, one symbol of each segment a round, as
the suffixes of a document collection are in Bauer, Cox and Rosone's construction of its Burrows-Wheeler transform: a
round is a stable sort of the order so far by the new symbols, and carries along the common prefixes of neighbours.
Neighbours with a common prefix of ``length`` are equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, BYTE_VALUE, discarded, mix64, powers, released, text_chunks, word_hashes, written

#: Bytes of an anchor; bytes of text in a batch; the doc_id that stands for null, which comes after all others.
SEED, BATCH, NO_ID = 16, 1 << 19, (1 << 63) - 1


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
    at, out = 8 * (n + 1), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def batches_of(docs: DataFrame, keep: tuple[F.Column, ...] = ()) -> DataFrame:
    """Rows (batch, docs, text, rest): runs of documents of about half a MB, each document whole; the text is compressed.

    ``rest`` holds the columns ``keep`` in Arrow's format, named by their positions.
    """
    names = [f"keep_{i}" for i in range(len(keep))]

    def apply(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(1)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        data: list[bytes] = []
        others: list[pa.RecordBatch] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal ids, sizes, data, others, held, number
            packed = _pack(np.concatenate(ids), np.concatenate(sizes))
            sink = pa.BufferOutputStream()
            if names:
                with pa.ipc.new_stream(sink, others[0].schema) as stream:
                    for x in others:
                        stream.write_batch(x)
            columns = [pa.array([number], pa.int64()), pa.array([packed], pa.binary()), pa.array([squeeze.compress(b"".join(data))], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, ["batch", "docs", "text", "rest"])
            ids, sizes, data, others, held, number = [], [], [], [], 0, number + 1
            return out

        for batch in arrow:
            for i, j, raw, offsets in text_chunks(batch.column(1), BATCH):
                if held and held + len(raw) > BATCH:
                    yield row()
                ids.append(batch.column(0).slice(i, j - i).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(offsets))
                data.append(raw.tobytes())
                if names:
                    others.append(pa.RecordBatch.from_arrays(batch.columns[2:], names).slice(i, j - i))
                held += len(raw)
        if ids:
            yield row()

    rows = docs.select("doc_id", "text", *[c.alias(name) for c, name in zip(keep, names, strict=True)])
    return rows.mapInArrow(apply, "batch long, docs binary, text binary, rest binary")


def _read(docs: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    released()
    ids, sizes = _unpack(docs, "<i8", "<i8")
    return ids, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(zstandard.ZstdDecompressor().decompress(text, max_output_size=int(sizes.sum()) or 1) if len(text) else b"", np.uint8)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash, segment hash) of every run of strings of ``length`` bytes with one anchor."""
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    size, wide = len(data), length - SEED + 1
    if size < length:
        return empty
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, size), out=sums[1:])
        shift = powers(BASE_INVERSE, size + 1)
        value = mix64((sums[SEED:] - sums[:-SEED]) * shift[: size - SEED + 1])
    least, at = value, np.arange(len(value), dtype=np.int32)
    span = 1

    def both(step: int) -> None:
        nonlocal least, at
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])

    while span * 2 <= wide:
        both(span)
        span *= 2
    if wide > span:
        both(wide - span)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + length <= offsets[1:][doc]
    key = np.where(inside, at.astype(np.int64), -1)
    turn = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.concatenate([turn[1:], [len(key)]])
    own = key[turn] >= 0
    first, last = turn[own], end[own] - 1
    place = key[first]
    with np.errstate(over="ignore"):
        segment = word_hashes(data, first, last + length)
        segment = mix64(segment + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return first, last, place, value[place], segment


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _order(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch by bucket, in a batch's own order within each: order, the buckets that occur, their starts."""
    own = _bucket(value, buckets)
    order = np.argsort(own, kind="stable")
    names, start = np.unique(own[order], return_index=True)
    return order, names, np.append(start, len(order))


def _first_holders(value: np.ndarray, segment: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each anchor of a batch the one that stands for its segment there: that of the smallest doc_id.

    Only these are dealt, so a passage that many documents hold sends one anchor a batch and not one a document.
    """
    with np.errstate(over="ignore"):
        key = mix64(value * np.uint64(0xD6E8FEB86659FD93) + segment)
    order = np.lexsort((ids, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(len(key), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return first


def _dealt(batches: DataFrame, length: int, buckets: int) -> DataFrame:
    def apply(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for number, docs, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, offsets, data = _read(docs, text)
                first, _, _, value, segment = anchors(data, offsets, length)
                if not len(value):
                    continue
                doc = np.searchsorted(offsets, first, "right") - 1
                stands = _first_holders(value, segment, ids[doc]) == np.arange(len(value))
                doc, value, segment = doc[stands], value[stands], segment[stands]
                order, names, start = _order(value, buckets)
                low, six = (value & np.uint64(0xFFFFFFFF)).astype("<u4"), segment.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows = []
                for a, b in zip(start, start[1:], strict=False):
                    own = order[a:b]
                    docs_, counts = np.unique(doc[own], return_counts=True)
                    rows.append(_pack(low[own], np.ascontiguousarray(six[own]), ids[docs_].astype("<i8"), counts.astype("<u4")))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), number)), pa.array(rows, pa.binary())], ["bucket", "batch", "blob"])

    return batches.mapInArrow(apply, "bucket long, batch long, blob binary")


def _settle(group: pa.Table) -> pa.Table:
    """Which anchors of a bucket meet: for every batch one bitmap of segments that a smaller doc_id holds whole, and one of
    those to be compared, which are the first holder's of each segment whose anchor has several segments."""
    blobs = [_unpack(b.as_py(), "<u4", "u1", "<i8", "<u4") for b in group.column("blob")]
    low = np.concatenate([b[0] for b in blobs])
    raw = np.zeros((len(low), 8), np.uint8)
    raw[:, :6] = np.concatenate([b[1] for b in blobs]).reshape(-1, 6)
    segment = raw.view("<u8").ravel()
    doc = np.concatenate([np.repeat(b[2], b[3]) for b in blobs])
    order = np.lexsort((doc, segment, low))
    s_low, s_segment, s_doc = low[order], segment[order], doc[order]
    new_anchor = np.concatenate([[True], s_low[1:] != s_low[:-1]])
    new_segment = new_anchor | np.concatenate([[True], s_segment[1:] != s_segment[:-1]])
    of_anchor, of_segment = np.cumsum(new_anchor) - 1, np.cumsum(new_segment) - 1
    first_doc = s_doc[new_segment][of_segment]
    whole = s_doc > first_doc
    several = np.bincount(of_anchor, new_segment)[of_anchor] > 1
    starts = np.flatnonzero(new_anchor)
    many = (np.minimum.reduceat(s_doc, starts) != np.maximum.reduceat(s_doc, starts))[of_anchor]
    covered, compare = np.zeros(len(low), bool), np.zeros(len(low), bool)
    covered[order], compare[order] = whole, several & many & ~whole
    at, bits = 0, []
    for b in blobs:
        n = len(b[0])
        bits.append(_pack(np.packbits(covered[at : at + n]), np.packbits(compare[at : at + n])) if covered[at : at + n].any() or compare[at : at + n].any() else None)
        at += n
    return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _compared(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """From batches and their bitmaps: rows (batch, cover) of what is covered whole, rows (bucket, segments) to compare."""

    def apply(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for batch in arrow:
            for number, docs, text, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, data = _read(docs, text)
                first, last, place, value, segment = anchors(data, offsets, length)
                if not len(value):
                    continue
                doc = np.searchsorted(offsets, first, "right") - 1
                holder = _first_holders(value, segment, ids[doc])
                stand = np.flatnonzero(holder == np.arange(len(value)))
                order, names, start = _order(value[stand], buckets)
                of = {int(n): stand[order[a:b]] for n, a, b in zip(names, start, start[1:], strict=False)}
                whole, compare, out = np.zeros(len(value), bool), np.zeros(len(value), bool), []
                for answer in answers or ():
                    own = of[answer["bucket"]]
                    for marks, x in zip((whole, compare), _unpack(answer["bits"], "u1", "u1"), strict=True):
                        marks[own] = np.unpackbits(x)[: len(own)].astype(bool)
                later = ids[doc] > ids[doc[holder]]
                covered, compare = np.flatnonzero(later | whole[holder]), np.flatnonzero(~later & compare[holder])
                bucket = _bucket(value[compare], buckets)
                order = np.argsort(bucket, kind="stable")
                names, start = np.unique(bucket[order], return_index=True)
                for name, a, b in zip(names.tolist(), start, np.append(start[1:], len(order)), strict=False):
                    own = compare[order[a:b]]
                    if len(own):
                        size = last[own] + length - first[own]
                        take = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        blob = _pack(value[own].astype("<u8"), ids[doc[own]].astype("<i8"), first[own].astype("<i8"), (place[own] - first[own]).astype("<i8"), size.astype("<i8"), data[take])
                        out.append((None, None, name, number, squeeze.compress(blob)))
                if len(covered):
                    out.append((number, _pack(first[covered].astype("<i8"), (last[covered] + length).astype("<i8")), None, None, None))
                if out:
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["batch", "cover", "bucket", "origin", "segments"])

    return rows.mapInArrow(apply, "batch long, cover binary, bucket long, origin long, segments binary")


def column_wise(text: np.ndarray, group: np.ndarray, doc: np.ndarray, left: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each aligned segment the first and last of its strings (from its start) that a smaller doc_id holds, else -1.

    ``text`` holds a segment a row, its anchor in the same columns in all rows; a segment fills ``size`` columns from
    ``length - SEED - left`` on. The columns are inserted from the right.
    """
    m, columns = text.shape
    start = length - SEED - left
    order = np.lexsort((np.arange(m), group))
    same = np.concatenate([[False], group[order][1:] == group[order][:-1]])
    common = np.where(same, 0, -1)  # of each and the one before it in the order; -1 parts the anchors
    low, high = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    for column in range(columns - 1, -1, -1):
        symbol = text[order, column].astype(np.int64)
        inserted = np.lexsort((symbol, group[order]))  # stable: equal symbols keep the order of what follows them
        was = inserted
        now = order[inserted]
        symbol, g = symbol[inserted], group[now]
        alike = np.concatenate([[False], (g[1:] == g[:-1]) & (symbol[1:] == symbol[:-1])])
        between = _range_min(common, was[:-1] + 1, was[1:] + 1, alike[1:])
        common = np.where(alike, 1, np.where(np.concatenate([[False], g[1:] == g[:-1]]), 0, -1))
        common[1:][alike[1:]] += np.maximum(between, 0)
        order = now
        if column + length <= columns:
            head = common < length
            run = np.cumsum(head) - 1
            first = np.minimum.reduceat(doc[order], np.flatnonzero(head))[run]
            at = column - start[order]
            hit = order[(doc[order] > first) & (at >= 0) & (at + length <= size[order])]
            low[hit] = column - start[hit]
            high[hit] = np.maximum(high[hit], column - start[hit])
    return low, high


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray, where: np.ndarray) -> np.ndarray:
    """min(x[a:b]) for the ranges marked by ``where``; neighbours mostly follow each other, long ranges take a table."""
    a, b = a[where], b[where]
    out = x[np.minimum(a, len(x) - 1)] if len(a) else np.zeros(0, x.dtype)
    size = b - a
    long = np.flatnonzero(size > 1)
    if len(long):
        table, step = x, 1
        level = np.floor(np.log2(size[long])).astype(int)
        out = out.copy()
        for k in range(int(level.max()) + 1):
            if k:
                table = np.minimum(table[:-step], table[step:])
                step *= 2
            own = long[level == k]
            if len(own):
                out[own] = np.minimum(table[a[own]], table[b[own] - (1 << k)])
    return out


def _covering(length: int):
    wide = 2 * length - SEED

    def compare(group: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        blobs = [_unpack(open_.decompress(b.as_py()), "<u8", "<i8", "<i8", "<i8", "<i8", "u1") for b in group.column("segments")]
        value, doc, first, left, size = (np.concatenate([b[k] for b in blobs]) for k in range(5))
        counts = [len(b[0]) for b in blobs]
        data = np.concatenate([b[5] for b in blobs])
        text = np.zeros((len(value), wide), np.uint8)
        rows = np.repeat(np.arange(len(value)), size)
        text[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(length - SEED - left, size)] = data
        _, anchor = np.unique(value, return_inverse=True)
        low, high = column_wise(text, anchor, doc, left, size, length)
        at, numbers, covers = 0, [], []
        for number, n in zip(group.column("origin").to_pylist(), counts, strict=True):
            own = np.flatnonzero(low[at : at + n] >= 0) + at
            if len(own):
                numbers.append(number)
                covers.append(_pack(first[own] + low[own], first[own] + high[own] + length))
            at += n
        return pa.table({"batch": pa.array(numbers, pa.int64()), "cover": pa.array(covers, pa.binary())})

    return compare


#: Batches of about half a MB of text for each bucket of anchors, which one task holds at a time.
BUCKET_BATCHES = 6


def covered_batches(docs: DataFrame, length: int = 50, buckets: int | None = None, keep: tuple[F.Column, ...] = ()) -> DataFrame:
    """Rows (batch, docs, text, rest, covers): batches of documents and the byte ranges in them that earlier documents hold.

    There are as many buckets as the text needs, so that a bucket's size doesn't grow with it.
    """
    batches = written(batches_of(docs, keep), "repeat-batches")
    buckets = buckets or max(1, -(-batches.count() // BUCKET_BATCHES))
    bits = _dealt(batches, length, buckets).groupBy("bucket").applyInArrow(_settle, "batch long, bucket long, bits binary").filter("bits is not null")
    bits = written(bits, "repeat-bits")
    answers = bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    found = written(_compared(batches.join(answers, "batch", "left").select("batch", "docs", "text", "answers"), length, buckets), "repeat-segments")
    discarded(bits)
    parts = found.filter("segments is not null").groupBy("bucket").applyInArrow(_covering(length), "batch long, cover binary")
    covers = written(found.filter("cover is not null").select("batch", "cover").unionByName(parts), "repeat-covers")
    discarded(found)
    covers = covers.groupBy("batch").agg(F.collect_list("cover").alias("covers"))
    return batches.join(covers, "batch", "left").select("batch", "docs", "text", "rest", "covers")


def _kept(docs: bytes, text: bytes, covers: list[bytes] | None) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(doc_id, bytes, bytes removed, runs removed, bytes kept) of every document of a batch."""
    ids, offsets, data = _read(docs, text)
    change = np.zeros(len(data) + 1, np.int64)
    for cover in covers or ():
        a, b = _unpack(cover, "<i8", "<i8")
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
    gone = np.cumsum(change[:-1]) > 0
    for d, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = gone[a:b]
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
        yield d, b - a, int(own.sum()), spans, data[a:b][~own] if spans else data[a:b]


def removed(docs: DataFrame, length: int = 50) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of every document, as bytes.

    Strings are judged on the input and don't cross documents; overlaps count. Null text is empty. Long texts are batches
    of their own, whole. Rows with equal doc_ids don't cover each other; a null doc_id comes after all others. No rows
    give no rows. Other columns are not looked at.
    """

    def apply(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for docs_, text, covers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(None if d == NO_ID else d, n, r, s, hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes()) for d, n, r, s, kept in _kept(docs_, text, covers)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return covered_batches(docs, length).select("docs", "text", "covers").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents with their columns, each text without what earlier documents hold; n_chars, where there, follows.

    What a cut leaves of a character whose bytes are partly gone goes too. Texts of which nothing is left stay, empty;
    a null text stays null, with n_chars 0. Rows with equal doc_ids don't cover each other; a null doc_id comes after all
    others. Columns of any other name stay as they are. No rows give no rows.
    """
    names = docs.columns

    def apply(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for docs_, text, rest, covers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = pa.ipc.open_stream(rest).read_all()
                columns = dict(zip(names, table.columns, strict=True))
                texts = [kept.tobytes().decode("utf-8", "ignore") for *_, kept in _kept(docs_, text, covers)]
                texts = [None if null else t for t, null in zip(texts, columns["text"].is_null().to_pylist(), strict=True)]
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t or "") for t in texts], pa.int64())
                yield from pa.table(columns).combine_chunks().to_batches()

    # the texts themselves stand in the batches; the column keeps its place, and its nulls
    keep = tuple(F.when(F.col("text").isNotNull(), F.lit("")) if c == "text" else F.col(f"`{c}`") for c in names)
    rows = covered_batches(docs, length, keep=keep).select("docs", "text", "rest", "covers")
    schema = docs.withColumn("n_chars", F.col("n_chars").cast("long")).schema if "n_chars" in names else docs.schema
    return rows.mapInArrow(apply, schema)
