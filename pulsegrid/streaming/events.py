"""Event operators on streams. Time columns are timestamps; a watermark bounds state and lateness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bin_counts(stream: DataFrame, by: list[str], width: str, step: str | None = None, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, end, by..., n): tumbling or sliding counts; a window is final once the watermark has passed it."""
    w = F.window(ts, width, step) if step else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def bursts(stream: DataFrame, by: list[str], gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(start, end, by..., n): runs of events with no pause of gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def isi(stream: DataFrame, unit: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(unit, ts, isi): seconds since the unit's event before.

    State is one time for each unit. Within a trigger events are sorted; one older than the last of its unit is late
    and left out."""
    kind = stream.schema[unit].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        times = pd.concat([f[ts] for f in frames]).sort_values()
        out = []
        for t in times:
            us = int(t.value // 1000)
            if before is not None and us < before:
                continue
            if before is not None:
                out.append((key[0], t, (us - before) / 1e6))
            before = us
        state.update((before,))
        yield pd.DataFrame(out, columns=[unit, ts, "isi"])

    s = stream.select(unit, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return s.groupBy(unit).applyInPandasWithState(step, f"`{unit}` {kind}, `{ts}` timestamp, isi double", "last long", "append", GroupStateTimeout.NoTimeout)
