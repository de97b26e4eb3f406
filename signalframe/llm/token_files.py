"""Token files: concatenated ids with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks, written
from .tokens import Ids, encoder

MAGIC = b"SFTK"
#: Ids of a shard at most, unless one document has more: what a task holds.
SHARD_IDS = 2_000_000


class EliasFano:
    """A non-decreasing sequence of n integers from 0 to ``top`` in about 2 + log2(top / n) bits each.

    The low bits of each value stand side by side; the high parts are the places of ones in a bit vector, where every
    64th one's place is kept, so that select(i) looks at a short stretch of bits.
    """

    EVERY = 64

    def __init__(self, n: int, top: int, low_bits: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.top, self.low_bits = n, top, low_bits
        self.low, self.high, self.marks = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(marks, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        k = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(k)) & 1
        places = (values >> k) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, top, k, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[:: cls.EVERY].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Value i, from one mark and the bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.marks[i // self.EVERY]), i % self.EVERY
        byte = place // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: place % 8] = 0
        while (ones := int(bits.sum())) <= left:
            left -= ones
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        place = byte * 8 + int(np.flatnonzero(bits)[left])
        k, value = self.low_bits, 0
        for b in range(k):
            at = i * k + b
            value |= (int(self.low[at // 8]) >> (at % 8) & 1) << b
        return ((place - i) << k) | value

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((places - np.arange(self.n)) << self.low_bits) | (low << np.arange(self.low_bits)).sum(1)

    def dump(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.marks)]
        return struct.pack("<QQBQQQ", self.n, self.top, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, top, k, *sizes = struct.unpack_from("<QQBQQQ", raw, at)
        at += struct.calcsize("<QQBQQQ")
        parts = []
        for size in sizes:
            parts.append(bytes(raw[at : at + size]))
            at += size
        return cls(n, top, k, *parts), at


def shard_bytes(doc_ids: np.ndarray, n_null: int, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: the header, doc_ids (Elias-Fano over their distance from the first), ends of documents (Elias-Fano), ids.

    ``doc_ids`` ascend; the first ``n_null`` documents have none.
    """
    first = int(doc_ids[0]) if len(doc_ids) else 0
    head = MAGIC + struct.pack("<BQqQ", ids.dtype.itemsize, n_null, first, len(ids))
    return head + EliasFano.of(doc_ids - first).dump() + EliasFano.of(ends).dump() + ids.tobytes()


class Shard:
    """A file read back. offsets(i) uses select; ids(i) gives one document's ids without reading the others."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token file")
        width, self.n_null, self.first, self.total = struct.unpack_from("<BQqQ", view, 4)
        at = 4 + struct.calcsize("<BQqQ")
        self.docs, at = EliasFano.load(view, at)
        self.ends, at = EliasFano.load(view, at)
        self.array = np.frombuffer(view, f"<u{width}", self.total, at)
        self.n = self.ends.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.docs.select(i - self.n_null)

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.offsets(i)
        return self.array[a:b].astype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Rows (part, shard, n_ids, file): the files of all documents in ascending doc_id, null first, in the shared folder.

    Range partitions of doc_id are sorted and encoded, and cut into files of bounded size; (part, shard) is the order of
    the files. Each stands as one binary value of a table that Spark writes, so that any store Spark reaches will do.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as ids:
            yield from encoded(ids, batches)

    def encoded(ids: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        wide = "<u2" if max(ids.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        keys: list = []
        held: list[np.ndarray] = []
        n = 0

        def file() -> pa.RecordBatch:
            nonlocal keys, held, n, shard
            own = np.array([k for k in keys if k is not None], np.int64)
            raw = shard_bytes(own, len(keys) - len(own), np.cumsum([len(x) for x in held]), np.concatenate(held))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([raw], pa.binary())], ["part", "shard", "n_ids", "file"])
            keys, held, n, shard = [], [], 0, shard + 1
            return out

        for batch in batches:
            for i, j, _, _ in text_chunks(batch.column(1), 1 << 21):
                each = ids.ids([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                for key, x in zip(batch.column(0).slice(i, j - i).to_pylist(), each, strict=True):
                    if n and n + len(x) + 1 > SHARD_IDS:
                        yield file()
                    keys.append(key)
                    held.append(np.append(x, end_id).astype(wide))
                    n += len(x) + 1
        if keys:
            yield file()

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(rows.mapInArrow(encode, "part long, shard long, n_ids long, file binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    Null text is empty, as are empty texts: the end id alone. Long texts stand whole; a file takes more than its usual
    ids for one. Rows with equal doc_ids stand side by side in the order of their texts. No rows give no rows.
    """
    base = F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = files.select("part", "shard", "n_ids").select("part", "shard", F.coalesce(base, F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base_, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(raw.as_buffer().to_pybytes())
                ends = shard.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                keys = [None] * shard.n_null + (shard.docs.all() + shard.first).tolist()
                ids = shard.array.astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + base_), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(F.broadcast(bases), ["part", "shard"]).select("base", "file")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
