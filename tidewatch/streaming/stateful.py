"""Streams: watermarks, windows, sessions, throttles and silences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def on_time(rows: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """rows with ts as an instant and a watermark."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def channel_counts(rows: DataFrame, size: str = "120 seconds", slide: str | None = None) -> DataFrame:
    """Events by platform, channel and window, tumbling or sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return on_time(rows).groupBy(w, "platform_id", "channel").agg(F.count(F.lit(1)).alias("n")).select("platform_id", "channel", F.col("window.start").alias("start"), "n")


def sessions(rows: DataFrame, gap: str = "180 seconds") -> DataFrame:
    """Tracks of a vessel: positions no further apart than gap."""
    return on_time(rows).groupBy(F.session_window("ts", gap), "mmsi").agg(F.count(F.lit(1)).alias("positions")).select("mmsi", F.col("session_window.start").alias("first_seen"), "positions")


def deduplicated(rows: DataFrame, key: str = "event_id") -> DataFrame:
    return on_time(rows).dropDuplicatesWithinWatermark([key])


def throttled(rows: DataFrame, gap_s: int = 60) -> DataFrame:
    """Keeps a position (mmsi, event_id, t_s), then drops until gap_s after the last kept one."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for r in pd.concat(list(batches)).sort_values(["t_s", "event_id"]).itertuples():
            if last is None or r.t_s - last >= gap_s:
                last = int(r.t_s)
                out.append({"mmsi": key[0], "event_id": r.event_id, "t_s": r.t_s})
        state.update((last,))
        yield pd.DataFrame(out, columns=["mmsi", "event_id", "t_s"])

    return rows.groupBy("mmsi").applyInPandasWithState(fold, "mmsi string, event_id long, t_s long", "last long", "append", GroupStateTimeout.NoTimeout)


def silences(rows: DataFrame, after_ms: int = 1_800_000) -> DataFrame:
    """The last time (last_ms) of each vessel before it was silent for longer than after_ms, of rows (mmsi, ts, t_ms).

    A timer in event time speaks up while the vessel stays away; a row that comes after a longer gap does so where the watermark has not got there yet.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lost: list[int] = []
        if state.hasTimedOut:
            lost.append(state.get[0])
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for t in sorted(int(t) for b in batches for t in b["t_ms"]):
                if last is not None and t - last > after_ms:
                    lost.append(last)
                last = t
            state.update((last,))
            if last + after_ms <= state.getCurrentWatermarkMs():
                lost.append(last)
                state.remove()
            else:
                state.setTimeoutTimestamp(last + after_ms)
        yield pd.DataFrame({"mmsi": [key[0]] * len(lost), "last_ms": lost}).astype({"mmsi": "object", "last_ms": "int64"})

    return on_time(rows).groupBy("mmsi").applyInPandasWithState(fold, "mmsi string, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def last_values(rows: DataFrame, key: str = "mmsi") -> DataFrame:
    """The newest position of each key, for complete or update mode."""
    at = F.struct("ts", "event_id")
    return rows.groupBy(key).agg(F.max_by("lat", at).alias("lat"), F.max_by("lon", at).alias("lon"), F.max("ts").alias("last_seen"))
