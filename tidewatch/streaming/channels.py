"""Streams of different schemas as one: every channel gives its rows a key, a time, an id and a body, and they are united by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def channel(rows: DataFrame, name: str, key: Column, ts: Column, event_id: Column, late: str = "10 minutes") -> DataFrame:
    """A channel's rows as (channel, key, ts, event_id, body), with its own watermark; body is the row as JSON."""
    return rows.select(F.lit(name).alias("channel"), key.cast("string").alias("key"), ts.cast("timestamp").alias("ts"), event_id.cast("long").alias("event_id"), F.to_json(F.struct(*rows.columns)).alias("body")).withWatermark("ts", late)


def united(channels: list[DataFrame], slowest: bool = True) -> DataFrame:
    """One stream of all channels. Its watermark is that of the slowest channel, so that none loses rows to another, or of the fastest, so that none holds up the rest."""
    channels[0].sparkSession.conf.set(POLICY, "min" if slowest else "max")
    return reduce(DataFrame.unionByName, channels)


def counted(rows: DataFrame, size: str = "1 day") -> DataFrame:
    """Events by channel and window, out once the window has closed."""
    return rows.groupBy(F.window("ts", size), "channel").agg(F.count(F.lit(1)).alias("n")).select("channel", F.col("window.start").alias("start"), "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over the batches that the query still tells of."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
