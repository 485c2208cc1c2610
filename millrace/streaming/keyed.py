"""Streams: ordered state for each key, and windowed counts with a bound for late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_fold(stream: DataFrame, key: str, order: str, step: Callable[[float, float], float], value: str, start: float = 0.0) -> DataFrame:
    """(key, n, state): after each micro-batch the state of each key that had rows. Rows of a batch run in `order`."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (start, 0)
        rows = pd.concat(frames).sort_values(order)
        for x in rows[value]:
            now, n = step(now, x), n + 1
        state.update((now, n))
        yield pd.DataFrame({"key": [str(k[0])], "n": [n], "state": [now]})

    return stream.groupBy(key).applyInPandasWithState(run, "key string, n long, state double", "now double, n long", "update", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n): counts by tumbling window; rows later than `late` are dropped."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")
