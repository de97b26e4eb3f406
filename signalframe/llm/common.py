"""Helpers that the corpus operators share: tables, the shared folder, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Texts may be long: have Spark hand Python about 4 MB at a time, not 64. A setting of the caller's own stays."""
    if spark.conf.get(_BATCH_BYTES) in ("67108864b", "64MB", None):
        spark.conf.set(_BATCH_BYTES, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local master (tests) takes a new folder; on a cluster that is an error, as no executor would see
    what another has written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="signalframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing lazy reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_trimmed_for: int | None = None


def trimmed() -> None:
    """Give free memory of this worker back to the system, once a task: what earlier tasks needed would stay with it."""
    global _trimmed_for
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if task is None or task != _trimmed_for:
        _trimmed_for = task
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library's own, where it has it
        ctypes.CDLL(None).malloc_trim(0)


def released() -> None:
    """Give back what an encoder keeps in this worker, too: workers serve one operator after another. Others call it."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None and tokens.ids_of.cache_info().currsize:
        tokens.ids_of.cache_clear()
        gc.collect()
        _give_back()
    if TaskContext.get():
        trimmed()


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of rows of about ``most`` bytes, without copying.

    Yields (first row, end row, bytes, offsets); offsets has one entry more than the run has rows. A null is empty.
    A single row larger than ``most`` is a run of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes
        gone = column.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(at)[gone] != 0).any():
            yield from text_chunks(column.fill_null(""), most)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document in ``data``, and the number of words of each document."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    word = ~gap
    start = word.copy()
    start[1:] &= gap[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= gap[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_ROOM = np.random.default_rng(20240607)
BYTE_VALUE = _ROOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in an odd base over random byte values, mixed."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers(BASE, len(data)), out=sums[1:])
        shift = powers(BASE_INVERSE, len(data) + 1)
        return mix64((sums[ends] - sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))


_LANE_KEYS = np.random.default_rng(20250117).integers(0, 1 << 63, 17, np.uint64)
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each span of bytes: eight bytes at a time, mixed after each; long spans by xxh3."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        value = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _LANE_KEYS[16])
        own = np.flatnonzero(size <= 128)
        for lane in range(16):
            own = own[size[own] > 8 * lane]
            if not len(own):
                break
            taken = lanes[starts[own] + 8 * lane] & _LANE_MASK[np.minimum(size[own] - 8 * lane, 8)]
            value[own] = mix64((value[own] ^ taken) + _LANE_KEYS[lane])
    for i in np.flatnonzero(size > 128).tolist():
        value[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=20250117)
    return value


def bernoulli_key(seed: str, *cols) -> F.Column:
    """A seeded hexadecimal order key that other SQL engines compute alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), *cols))
