"""Stream queries over finished input: written as files, read as a stream, run until all is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.sensing import GATED, THREATS
from tidewatch.operators.tracks import LATEST
from tidewatch.sources import feed
from tidewatch.sources.fixtures import ctes, fixture
from tidewatch.sources.storage import scratch
from tidewatch.streaming import channels, keyed, merge, stateful


BATCH = 1_000_000  # rows of a batch that every share of a flag gets


def arriving(rows: DataFrame, path: str, batches: int, order: str) -> None:
    """Writes rows as files that arrive one after another by order, a whole number: one file a batch."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        rows.write.parquet(path)
        return
    step = max(1, -(-(high - low + 1) // batches))
    for start in range(low, high + 1, step):
        rows.filter(F.col(order).between(start, start + step - 1)).coalesce(1).write.mode("append").parquet(path)


def arriving_together(rows: dict[str, DataFrame], root: str, order: str, most: int) -> None:
    """Writes several streams as files that arrive one after another: a file of each a batch, cut at the same places of order into batches of most rows, about, so that what a batch brings does not grow with the streams."""
    ats = reduce(DataFrame.unionByName, [r.select(order) for r in rows.values()])
    batches = -(-ats.count() // most)
    cuts = ats.agg(F.percentile_approx(order, [k / batches for k in range(1, batches)], 10 * batches)).first()[0] if batches > 1 else []
    for name, r in rows.items():  # one pass over the rows, whatever the number of batches
        number = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(order))) if cuts else F.lit(0)
        r.withColumn("_batch", number).write.partitionBy("_batch").parquet(f"{root}/cut/{name}")
    for k in range(len(set(cuts)) + 1):
        for name, r in rows.items():
            part = r.sparkSession.read.schema(r.withColumn("_batch", F.lit(0)).schema).parquet(f"{root}/cut/{name}")
            part.filter(F.col("_batch") == k).select(*r.columns).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def replayed(rows: DataFrame, stream, batches: int = 4, mode: str = "append", order: str = "event_id") -> DataFrame:  # noqa: ANN001
    """What stream makes of rows that arrive in several batches, with state and a checkpoint carried from one to the next."""
    spark, root = rows.sparkSession, scratch(rows.sparkSession)
    arriving(rows, f"{root}/in", batches, order)
    return drained(stream(source(spark, rows, f"{root}/in")), root, mode)


def source(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(out: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Runs a stream until its input is read and gives what it has written so far; called again on the same root it goes on from its checkpoint."""
    query = out.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{root}/out")


def stream_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(fixture(spark, sf_dir, "sensor_events").select("platform_id", "event_id", "t_s", "channel"), keyed.threats, order="t_s")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position twice in, once out."""
    rows = fixture(spark, sf_dir, "ais_positions").select("event_id", "mmsi", F.col("ts").cast("timestamp").alias("ts"))
    return replayed(rows.unionByName(rows), stateful.deduplicated).select("event_id", "mmsi")


def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels that fall silent, by timers in event time."""
    rows = fixture(spark, sf_dir, "ais_positions").select("mmsi", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))
    return replayed(rows, stateful.silences, order="t_ms")


def stream_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure ionospheric events that do not come while a storm report holds."""
    root = scratch(spark)
    events = fixture(spark, sf_dir, "sensor_events").filter("channel IN ('sensors:ionospheric', 'ionosphere:anomalies') AND confidence >= 0.5").select("event_id", "channel", F.timestamp_seconds("t_s").alias("ts"), "t_s")
    reports = fixture(spark, sf_dir, "tec_series").filter("kp IS NOT NULL").select(F.timestamp_seconds(F.col("seq") * 6).alias("ts"), (F.col("seq") * 6).alias("t_s"), "kp")
    end = events.agg(F.max("t_s")).first()[0]
    both = {"events": events, "reports": reports.filter(F.col("t_s") <= (end or 0))}
    arriving_together(both, root, "t_s", BATCH)
    out = keyed.gated(*(source(spark, rows, f"{root}/{name}") for name, rows in both.items()))
    return drained(out, root).select("event_id", "channel")


def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of each platform, from a bounded list as state."""
    out = replayed(fixture(spark, sf_dir, "sensor_events").select("platform_id", F.col("event_id").alias("seq")), lambda r: keyed.ring(r, "platform_id", 20), order="seq")
    top = out.groupBy("platform_id").agg(F.max("version").alias("version"))
    return out.join(top, ["platform_id", "version"]).select("platform_id", F.col("seq").alias("event_id"))


VESSEL = "mmsi string, lat double, lon double, ts timestamp, event_id long"


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of vessels that a stream of positions leaves."""
    root, rows = scratch(spark), fixture(spark, sf_dir, "ais_positions").select("mmsi", "lat", "lon", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    arriving(rows, f"{root}/in", 3, "event_id")
    into = merge.merge_into(f"{root}/table", VESSEL, "mmsi", ("ts", "event_id"), 16)
    source(spark, rows, f"{root}/in").writeStream.foreachBatch(into).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return merge.merged(spark, f"{root}/table", VESSEL).select("mmsi", "lat", "lon")


def stream_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, ship's logs and sensor events as one stream, counted by hour."""
    root = scratch(spark)
    rows = {
        "ais": fixture(spark, sf_dir, "ais_positions").withColumn("n", F.col("event_id")),
        "log": fixture(spark, sf_dir, "vessel_events").withColumn("n", F.col("seq")),
        "sensors": fixture(spark, sf_dir, "sensor_events").withColumn("n", F.col("event_id")),
    }
    for name, r in rows.items():
        arriving(r, f"{root}/{name}", 2, "n")
    at = {name: source(spark, r, f"{root}/{name}") for name, r in rows.items()}
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    one = channels.united([
        channels.channel(at["ais"], "ais", F.col("mmsi"), F.col("ts"), F.col("event_id")),
        channels.channel(at["log"], "log", F.col("vessel_id"), F.col("ts"), F.col("seq")),
        channels.channel(at["sensors"], "sensors", F.col("platform_id"), start + F.make_dt_interval(secs=F.col("t_s").cast("decimal(18,6)")), F.col("event_id")),
    ])
    return drained(channels.counted(one, "1 hour"), root).select("channel", F.unix_seconds("start").alias("start_s"), "n")


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in a box, read from a recorded feed by a source with offsets of its own."""
    root, p = scratch(spark), fixture(spark, sf_dir, "ais_positions")
    body = F.struct(F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.col("course").alias("Cog"), F.col("speed").alias("Sog"), F.coalesce("heading", F.lit(511.0)).alias("TrueHeading")).alias("PositionReport"))
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000 +0000 UTC")).alias("time_utc"))
    p.select(F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), body.alias("Message")))).write.text(f"{root}/feed")
    spark.dataSource.register(feed.Feed)
    rows = spark.readStream.format("vessel_feed").option("path", f"{root}/feed").option("box", "34,12,36,16").load()
    return drained(rows, root).select("mmsi", "class", "lat", "lon", "course", "speed", "heading")


HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600"
QUERIES = {
    "stream_gated": (stream_gated, f"SELECT * FROM ({GATED}) WHERE channel IN ('sensors:ionospheric', 'ionosphere:anomalies')"),
    "stream_ring": (stream_ring, f"{ctes('sensor_events')} SELECT platform_id, event_id FROM sensor_events QUALIFY row_number() OVER (PARTITION BY platform_id ORDER BY event_id DESC) <= 20"),
    "stream_upsert": (stream_upsert, f"{ctes('ais_positions')}, {LATEST} SELECT mmsi, lat, lon FROM v"),
    "stream_channels": (
        stream_channels,
        f"""{ctes("ais_positions", "vessel_events", "sensor_events")}, c AS (SELECT 'ais' AS channel, ts FROM ais_positions UNION ALL SELECT 'log', ts FROM vessel_events UNION ALL SELECT 'sensors', TIMESTAMP '2024-01-01 00:00:00' + to_seconds(t_s) FROM sensor_events),
        w AS (SELECT min(m) - 600 AS seen FROM (SELECT channel, epoch(max(ts)) AS m FROM c GROUP BY channel)) SELECT channel, start_s, count(*) AS n FROM (SELECT channel, {HOUR} AS start_s FROM c) WHERE start_s + 3600 <= (SELECT seen FROM w) GROUP BY channel, start_s""",
    ),
    "stream_feed": (stream_feed, f"{ctes('ais_positions')} SELECT mmsi, 'A' AS class, lat, lon, course, speed, heading FROM ais_positions WHERE lat BETWEEN 34 AND 36 AND lon BETWEEN 12 AND 16"),
    "stream_silences": (
        stream_silences,
        f"{ctes('ais_positions')}, g AS (SELECT mmsi, epoch_us(ts) // 1000 AS t, lead(epoch_us(ts) // 1000) OVER (PARTITION BY mmsi ORDER BY ts) AS n FROM ais_positions), m AS (SELECT max(t) - 600000 AS seen FROM g)"
        " SELECT mmsi, t AS last_ms FROM g, m WHERE n - t > 1800000 OR n IS NULL AND t + 1800000 <= seen",
    ),
    "stream_threats": (stream_threats, f"SELECT platform_id, event_id, t_s, weight, sources, urgent FROM ({THREATS})"),
    "stream_dedup": (stream_dedup, f"{ctes('ais_positions')} SELECT event_id, mmsi FROM ais_positions"),
}
