"""State by key in a store on disk: values, maps and bounded lists, with timers in event time.

The state of a key is small whatever its stream: threats keep the newest time of each sensor type, the gate one report,
a ring its last rows. State is kept by RocksDB, so keys need not fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.sensing import STORM_S
from tidewatch.sources.dims import ALERT, SENSOR, URGENT, WEIGHT
from tidewatch.sources.storage import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
THREAT = "platform_id long, event_id long, t_s long, weight int, sources string, urgent boolean"
SHARES = 16  # of a feed that one flag holds for


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    """rows by key through a processor. The state store must be RocksDB while the stream runs, which a new session setting sees to."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    spark.conf.set(PROVIDER, ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time)


def in_order(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """What a batch brings for a key, in order. How much that is, the source's limits on a batch decide."""
    return pd.concat(list(batches)).sort_values(list(by), kind="stable")


class Threats(StatefulProcessor):
    """The window of a platform as the newest time of each sensor type in it; empty again once an event went out."""

    def __init__(self, window_s: int = 120) -> None:
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", "sensor string", "t_s long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: v[0] for k, v in self.newest.iterator()}
        out = []
        for event_id, t, channel in in_order(rows, "t_s", "event_id")[["event_id", "t_s", "channel"]].itertuples(index=False):
            held[SENSOR[channel]] = int(t)
            held = {s: at for s, at in held.items() if t - at < self.window_s}
            weight = sum(WEIGHT.get(s, 0) for s in held)
            if weight >= ALERT:
                out.append((key[0], event_id, t, weight, ",".join(sorted(held)), weight >= URGENT))
                held = {}
        self.newest.clear()
        for s, at in held.items():
            self.newest.updateValue((s,), (at,))
        yield pd.DataFrame(out, columns=["platform_id", "event_id", "t_s", "weight", "sources", "urgent"])

    def close(self) -> None:
        pass


def threats(rows: DataFrame, window_s: int = 120) -> DataFrame:
    """Fused events of a stream of (platform_id, event_id, t_s, channel), which arrives in order of time but for a batch's own rows."""
    return stateful(rows.filter(F.col("channel").isin(*SENSOR)), "platform_id", Threats(window_s), THREAT)


class Gate(StatefulProcessor):
    """The last storm report, dropped by a timer once it holds no longer."""

    def __init__(self, columns: dict[str, str], hold_s: int) -> None:
        self.columns, self.hold_s = columns, hold_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t_s long, kp double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = in_order(rows, "t_s", "asks", "kp")
        at, kp = self.last.get() if self.last.exists() else (None, None)
        keep = []
        for t, asks, new in batch[["t_s", "asks", "kp"]].itertuples(index=False):
            if not asks:
                at, kp = int(t), float(new)
            keep.append(bool(asks) and not (at is not None and kp > 4 and t - at < self.hold_s))
        if at is not None:
            self.last.update((at, kp))
            self.handle.registerTimer((at + self.hold_s) * 1000)
        yield batch.loc[keep, list(self.columns)].astype(self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and (self.last.get()[0] + self.hold_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def gated(events: DataFrame, reports: DataFrame, hold_s: int = STORM_S, late: str = "10 minutes") -> DataFrame:
    """Streams of ionospheric events (event_id, channel, ts, t_s) and reports (ts, t_s, kp): the events that do not come while the last report, less than hold_s old, says storm.

    The flag holds for all events, so these are dealt to SHARES and every report goes to each of them.
    """
    columns = {"event_id": "long", "channel": "string", "t_s": "long"}
    asked = events.select("ts", *[F.col(c).cast(t).alias(c) for c, t in columns.items()], F.lit(True).alias("asks"), F.lit(None).cast("double").alias("kp"), F.pmod(F.xxhash64("event_id"), F.lit(SHARES)).alias("share"))
    told = reports.filter("kp IS NOT NULL").select("ts", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("channel"), "t_s", F.lit(False).alias("asks"), F.col("kp").cast("double").alias("kp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
    both = asked.withWatermark("ts", late).unionByName(told.withWatermark("ts", late))
    return stateful(both, "share", Gate({"event_id": "int64", "channel": "object", "t_s": "int64"}, hold_s), ", ".join(f"{c} {t}" for c, t in columns.items()), time="EventTime")


class Ring(StatefulProcessor):
    """The last rows of a key as a list that never grows beyond its size."""

    def __init__(self, key: str, size: int) -> None:
        self.key, self.size = key, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        for batch in rows:
            held = sorted([*held, *batch["seq"].nlargest(self.size).tolist()])[-self.size :]
        self.held.put([(int(s),) for s in held])
        yield pd.DataFrame({self.key: [key[0]] * len(held), "seq": held, "version": [held[-1]] * len(held)})

    def close(self) -> None:
        pass


def ring(rows: DataFrame, key: str, size: int = 50) -> DataFrame:
    """The last size rows of each key of a stream (key, seq), a new version with every batch that changes it; the ring is the rows of a key's highest version."""
    return stateful(rows, key, Ring(key, size), f"{key} {dict(rows.dtypes)[key]}, seq long, version long")
