"""Live forms with state: causal scores from running moments, and levels from a bounded buffer.

Both wait for rows that come out of order: a row is held in its group's state until the watermark has passed it, then the
group's rows go on in the order of their times. Rows behind the watermark are dropped by Spark. State needs the RocksDB
provider, as ``stateful`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _InOrder(StatefulProcessor):
    """Holds a group's rows until the watermark has passed them, then hands them to ``advance`` in order."""

    waiting_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = {int(t) for t in self.handle.listTimers()}
        for frame in rows:
            for row in frame.itertuples(index=False):
                ms = row.ts.value // 1_000_000
                self.waiting.appendValue((ms, int(row.idx), *self.values(row)))
                times.add(ms)
        if times:  # one timer a group: at its earliest row that waits
            first = min(times)
            for t in [int(t) for t in self.handle.listTimers()]:
                if t != first:
                    self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        out = self.advance(key, ready, now)
        if later:
            self.handle.registerTimer(later[0][0])
        elif (at := self.idle_at()) is not None:
            self.handle.registerTimer(max(at, now + 1))
        if len(out):
            yield out

    def idle_at(self) -> int | None:
        """When an idle group's state is looked at again, in milliseconds; None: never."""
        return None

    def close(self) -> None:
        pass


class CausalScores(_InOrder):
    """z-scores by the running mean and variance of a group's earlier rows; the first ``warm`` take the population's."""

    waiting_schema = "ms long, idx long, v array<double>"

    def __init__(self, columns: list[str], population: dict[str, tuple[float, float]], warm: int):
        self.columns, self.population, self.warm = columns, population, warm

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.moments = handle.getValueState("moments", "n long, mean array<double>, squares array<double>")

    def values(self, row) -> tuple:
        return ([float(getattr(row, c)) for c in self.columns],)

    def advance(self, key: tuple, rows: list[tuple], now: int) -> pd.DataFrame:
        n, mean, squares = self.moments.get() if self.moments.exists() else (0, None, None)
        mean, squares = (np.zeros(len(self.columns)) if x is None else np.array(x) for x in (mean, squares))
        first = np.array([self.population[c] for c in self.columns])
        out = []
        for _, idx, v in rows:
            x = np.array(v)
            m, var = (first[:, 0], first[:, 1]) if n < self.warm else (mean, squares / n)
            out.append((key[0], idx, *((x - m) / np.where(var < 1e-18, 1.0, np.sqrt(np.maximum(var, 0.0)))).tolist()))
            n += 1
            step = x - mean
            mean = mean + step / n
            squares = squares + step * (x - mean)
        if rows:
            self.moments.update((n, mean.tolist(), squares.tolist()))
        return pd.DataFrame(out, columns=["grp", "idx", *[f"{c}_z" for c in self.columns]]).astype({"grp": "int64", "idx": "int64"})


class BufferedLevels(_InOrder):
    """The mean of the last ``size`` readings at every ``stride``-th; a group that is idle for ``idle_ms`` begins anew."""

    waiting_schema = "ms long, idx long, p double"

    def __init__(self, size: int, stride: int, idle_ms: int):
        self.size, self.stride, self.idle_ms = size, stride, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buffer = handle.getListState("buffer", "p double")
        self.seen = handle.getValueState("seen", "n long, last long")

    def values(self, row) -> tuple:
        return (float(row.p),)

    def advance(self, key: tuple, rows: list[tuple], now: int) -> pd.DataFrame:
        buffer = [r[0] for r in self.buffer.get()] if self.buffer.exists() else []
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        out = []
        for ms, idx, p in rows:
            if last is not None and ms - last > self.idle_ms:
                buffer, n = [], 0
            buffer, n, last = [*buffer, p][-self.size :], n + 1, ms
            if n % self.stride == 0:
                out.append((key[0], idx, float(np.mean(buffer))))
        if last is not None and now - last > self.idle_ms:  # nothing that could still come belongs to it
            self.buffer.clear()
            self.seen.clear()
        elif rows:
            self.buffer.put([(p,) for p in buffer])
            self.seen.update((n, last))
        return pd.DataFrame(out, columns=["grp", "idx", "level"]).astype({"grp": "int64", "idx": "int64", "level": "float64"})

    def idle_at(self) -> int | None:
        return self.seen.get()[1] + self.idle_ms + 1 if self.seen.exists() else None


def causal_z(stream: DataFrame, columns: list[str], population: dict[str, tuple[float, float]], late: str = "1 minute", warm: int = 4) -> DataFrame:
    """(grp, idx, <column>_z) of a stream (grp, idx, ts, columns): the batch form's scores, as rows come.

    ``population`` has the mean and variance of each column for a group's first ``warm`` rows: those of the training data.
    State of a group is three numbers a column, and the rows that the watermark hasn't passed.
    """
    stateful(stream.sparkSession)
    schema = "grp long, idx long, " + ", ".join(f"{c}_z double" for c in columns)
    return stream.withWatermark("ts", late).groupBy("grp").transformWithStateInPandas(CausalScores(columns, population, warm), schema, "Append", "EventTime")


def levels(stream: DataFrame, size: int = 16, stride: int = 4, late: str = "1 minute", idle_ms: int = 30 * 60_000) -> DataFrame:
    """(grp, idx, level) of a stream (grp, idx, ts, p): the mean of the last ``size`` readings, at every ``stride``-th.

    State of a group is its buffer of ``size`` readings and the rows that wait; after ``idle_ms`` without a reading it is
    deleted, and the next reading begins a new buffer and a new count, also where both come in one micro-batch.
    """
    stateful(stream.sparkSession)
    return stream.withWatermark("ts", late).groupBy("grp").transformWithStateInPandas(BufferedLevels(size, stride, idle_ms), "grp long, idx long, level double", "Append", "EventTime")
