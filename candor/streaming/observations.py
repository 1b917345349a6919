"""Streams: price suppression with state, daily counts, incremental results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may be; later ones are dropped by the state store's watermark.
WATERMARK = "1 day"


def suppressed(stream: DataFrame, key: str, minutes: int = 30) -> DataFrame:
    """A stream of (key, observed_at, ordinal, price) without rows that repeat the last kept price within ``minutes`` (ST1).
    As in the batch rule, times count in whole seconds, and rows of one time go by their ordinal."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values(["observed_at", "ordinal"], kind="stable").itertuples():
            now = r.observed_at.value // 1_000_000_000
            if at is None or r.price != last or now - at >= minutes * 60:
                at, last = now, float(r.price)
                rows.append((k[0], r.observed_at, last))
        state.update((at, last))
        yield pd.DataFrame(rows, columns=[key, "observed_at", "price"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, observed_at timestamp, price double", "at bigint, price double", "append", GroupStateTimeout.NoTimeout)


def daily_counts(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of each key and day (ST4); the z-scores of closed days are a batch step on these."""
    return stream.withWatermark(ts, WATERMARK).groupBy(F.window(ts, "1 day"), key).agg(F.count("*").alias("count")).select(key, F.to_date("window.start").alias("day"), "count")


def without_repeats(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Live points once within the watermark (ST3)."""
    return stream.withWatermark(ts, "15 minutes").dropDuplicatesWithinWatermark(keys)


def publish(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``write`` on every micro-batch, as store answers come in (ST2)."""
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()
