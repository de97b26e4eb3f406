"""The offline gate over a stream: the same offers as the batch fold, one state a group.

Readings of a group must reach the stream in the order of idx; a micro-batch is ordered before it is folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def offers(stream: DataFrame, floor: float, least: int = 2, cooldown: int = 3) -> DataFrame:
    """(grp, idx) of every offer, appended as readings (grp, idx, p) come."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, cool = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("idx")
        out = []
        for idx, p in zip(rows["idx"], rows["p"], strict=True):
            streak = streak + 1 if p >= floor else 0
            if cool > 0:
                cool -= 1
            elif p >= floor and streak >= least:
                out.append((key[0], int(idx)))
                streak, cool = 0, cooldown
        state.update((int(streak), int(cool)))
        yield pd.DataFrame(out, columns=["grp", "idx"]).astype("int64")

    return stream.groupBy("grp").applyInPandasWithState(fold, "grp long, idx long", "streak int, cool int", "append", GroupStateTimeout.NoTimeout)


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, type, n) of tumbling windows over event time; rows later than ``late`` behind the newest are dropped.

    ``stream`` has ts as a time stamp with time zone, as watermarks need one.
    """
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")
