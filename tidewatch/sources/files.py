"""Logs, snapshots and lists as files: schemas, readers for batch and stream, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_type string, timestamp timestamp, source struct<protocol:string,adapter:string,vessel_id:string,device_id:string,transport:string,raw_sentence:string>, lat double, lon double, course double, speed double, heading double, altitude double, status string, confidence double, payload map<string,string>"
SIGNAL = "signal_id string, source_channel string, source_id string, source_name string, raw_text string, lat double, lon double, timestamp_utc timestamp, event_time_utc timestamp, persons int, vessel_type string, vessel_condition string, medical_emergency boolean, children_aboard boolean, extraction_confidence double, requires_human_review boolean, extraction_method string, language_detected string"
ASSET_AGE = "asset string, fetched_at timestamp"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines in a schema; blank lines and lines that do not parse are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def stream_log(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    rows = spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files).json(path)
    return rows.filter(F.col("_bad").isNull()).drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def snapshot_rows(rows: DataFrame, body: str = "body") -> DataFrame:
    """Aircraft of poll snapshots (poll_no, JSON body): the barometric altitude, else the plain one, else 0."""
    kind = "struct<aircraft:array<struct<hex:string,flight:string,squawk:string,alt_baro:double,altitude:double,lat:double,lon:double,track:double>>>"
    each = rows.select("poll_no", F.explode(F.from_json(body, kind)["aircraft"]).alias("a"))
    return each.select("poll_no", F.lower("a.hex").alias("icao"), F.trim("a.flight").alias("callsign"), F.col("a.squawk").alias("squawk"), F.coalesce("a.alt_baro", "a.altitude", F.lit(0.0)).alias("alt_ft"), F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"), F.col("a.track").alias("track"))


def listed_ids(rows: DataFrame, body: str = "body", kind: str = "MMSI") -> DataFrame:
    """Distinct ids of a kind in a sanctions list."""
    schema = "struct<sdnList:struct<sdnEntry:array<struct<idList:struct<id:array<struct<idType:string,idNumber:string>>>>>>>"
    ids = rows.select(F.explode(F.from_json(body, schema)["sdnList"]["sdnEntry"]).alias("e")).select(F.explode("e.idList.id").alias("i"))
    return ids.filter(F.upper("i.idType").contains(kind)).select(F.trim("i.idNumber").alias("mmsi")).distinct()


def point_features(rows: DataFrame, body: str = "body") -> DataFrame:
    """Features of GeoJSON collections with their kind and, for points, position."""
    schema = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    g = rows.select(F.explode(F.from_json(body, schema)["features"]).alias("f")).select("f.geometry.*")
    xy = F.from_json(F.when(F.col("type") == "Point", F.col("coordinates")), "array<double>")
    return g.select(F.col("type").alias("geom_type"), xy[1].alias("lat"), xy[0].alias("lon"))


def last_kp(body: Column) -> Column:
    """The second field of the last row of an array of arrays."""
    return F.get(F.element_at(F.from_json(body, "array<array<string>>"), -1), F.lit(1)).try_cast("double")


def fresh(rows: DataFrame, as_of: Column, hours: float = 48.0) -> DataFrame:
    """Cached assets (asset, fetched_at) with their age in hours and whether they are stale."""
    age = (F.unix_micros(as_of) - F.unix_micros("fetched_at")) / F.lit(3.6e9)
    return rows.select("asset", (F.floor(age * 10 + 0.5) / 10).alias("age_h"), (age > hours).alias("stale"))
