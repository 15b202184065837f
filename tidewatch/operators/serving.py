"""Small projections and renderers that views and exports need."""

from __future__ import annotations

import gzip
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators.tracks import LATEST, R, latest, nearest
from tidewatch.sources.fixtures import ctes, fixture


def wind_lines(rows: DataFrame) -> DataFrame:
    """A line from each observation along its wind, longer the stronger, in degrees."""
    scale, a = F.greatest(F.lit(0.12), F.least(F.lit(0.36), 0.08 + 0.018 * F.col("wind_ms"))), F.radians("wind_dir_deg")
    return rows.select("obs_id", geo.rounded(F.col("lat") + scale * F.cos(a), 5).alias("end_lat"), geo.rounded(F.col("lon") + scale * F.sin(a), 5).alias("end_lon"))


def bounding_box(rows: DataFrame, margin: float = 0.2) -> DataFrame:
    return rows.agg((F.min("lat") - margin).alias("south"), (F.max("lat") + margin).alias("north"), (F.min("lon") - margin).alias("west"), (F.max("lon") + margin).alias("east"))


def grid_cells(rows: DataFrame, places: int = 1) -> DataFrame:
    """Rows by cell of a tenth of a degree."""
    return rows.groupBy(geo.rounded(F.col("lat"), places).alias("cell_lat"), geo.rounded(F.col("lon"), places).alias("cell_lon")).agg(F.count(F.lit(1)).alias("n"))


def mock_wind(rows: DataFrame, at_s: float) -> DataFrame:
    """A wind that varies with place and a given second, where no source is on hand."""
    seed = F.pmod((F.abs("lat") * 100 + F.abs("lon") * 10).cast("long"), F.lit(997))
    speed = 5 + 4 * F.abs(F.sin(F.lit(at_s / 1800) + seed))
    return rows.select("event_id", geo.rounded(speed, 2).alias("wind_ms"), geo.rounded(geo.modulo(200 + 80 * F.sin(F.lit(at_s / 3600) + seed), 360.0), 1).alias("wind_deg"))


def waypoints(coordinates: Column) -> Column:
    """(lat, lon) of GeoJSON coordinates; short ones go."""
    return F.transform(F.filter(coordinates, lambda c: F.size(c) >= 2), lambda c: F.array(c[1], c[0]))


def proximity(vessels: DataFrame, lat: float, lon: float, k: int = 5) -> DataFrame:
    """Lines from a point to its nearest vessels, with their rank."""
    near = nearest(vessels, lat, lon, k).join(vessels.select("mmsi", "lat", "lon"), "mmsi")
    line = F.array(F.array(F.lit(lon), F.lit(lat)), F.array("lon", "lat"))
    return near.select("rank", "mmsi", F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).alias("geometry"))


def listed(text: Column) -> Column:
    """A list written as JSON or with commas, trimmed, without blanks."""
    raw = F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>"), F.split(text, ","))
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")


def with_count(rows: DataFrame) -> DataFrame:
    """rows, each as JSON too, with the count of all of them. A row for each event, so that an export has no largest size."""
    total = rows.agg(F.count(F.lit(1)).alias("count"))
    return rows.withColumn("event", F.to_json(F.struct(*rows.columns))).crossJoin(F.broadcast(total))  # one row


def export_with_count(rows: DataFrame, path: str) -> int:
    """Writes rows as JSON lines under path/events and their count as path/count, in this order; gives the count."""
    rows.write.mode("overwrite").json(f"{path}/events")
    n = rows.sparkSession.read.schema(rows.schema).json(f"{path}/events").count()
    rows.sparkSession.range(1).select(F.lit(n).cast("long").alias("count")).write.mode("overwrite").json(f"{path}/count")
    return n


def base64(binary: Column) -> Column:
    """Without line ends."""
    return F.replace(F.base64(binary), F.lit("\r\n"), F.lit(""))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def sealed(rows: DataFrame, key: bytes, column: str = "canonical") -> DataFrame:
    """rows with the column's text compressed and the HMAC-SHA256 of that; the key is the caller's and is never logged."""

    @F.pandas_udf("packed binary, hmac string")
    def seal(texts: pd.Series) -> pd.DataFrame:
        packed = [gzip.compress((t or "").encode(), 6, mtime=0) for t in texts]
        return pd.DataFrame({"packed": packed, "hmac": [hmac.new(key, p, hashlib.sha256).hexdigest() for p in packed]})

    return rows.withColumn("_s", seal(column)).select(*rows.columns, "_s.packed", "_s.hmac")


P = "ais_positions"
QUERIES = {
    "wind_lines": (lambda s, p: wind_lines(fixture(s, p, "weather_obs")), f"{ctes('weather_obs')}, s AS (SELECT *, greatest(0.12e0, least(0.36e0, 0.08e0 + 0.018e0 * wind_ms)) AS k, radians(wind_dir_deg) AS a FROM weather_obs) SELECT obs_id, {R('lat + k * cos(a)', 5)} AS end_lat, {R('lon + k * sin(a)', 5)} AS end_lon FROM s"),
    "bounding_box": (lambda s, p: bounding_box(fixture(s, p, "alerts")), f"{ctes('alerts')} SELECT min(lat) - 0.2e0 AS south, max(lat) + 0.2e0 AS north, min(lon) - 0.2e0 AS west, max(lon) + 0.2e0 AS east FROM alerts"),
    "grid_cells": (lambda s, p: grid_cells(fixture(s, p, P)), f"{ctes(P)} SELECT {R('lat', 1)} AS cell_lat, {R('lon', 1)} AS cell_lon, count(*) AS n FROM ais_positions GROUP BY ALL"),
    "mock_wind": (lambda s, p: mock_wind(fixture(s, p, "alerts"), 86_400.0), f"{ctes('alerts')}, s AS (SELECT *, CAST(trunc(abs(lat) * 100 + abs(lon) * 10) AS BIGINT) % 997 AS seed FROM alerts) SELECT event_id, {R('5 + 4 * abs(sin(86400e0 / 1800 + seed))', 2)} AS wind_ms, {R('fmod(200 + 80 * sin(86400e0 / 3600 + seed), 360e0)', 1)} AS wind_deg FROM s"),
    "proximity_ranked": (lambda s, p: proximity(latest(fixture(s, p, P)), 35.5, 12.6), f"""{ctes(P)}, {LATEST}, d AS (SELECT mmsi, lat, lon, asin(sqrt(sin(radians(lat - 35.5e0) / 2) ** 2 + cos(radians(35.5e0)) * cos(radians(lat)) * sin(radians(lon - 12.6e0) / 2) ** 2)) AS d FROM v) SELECT CAST(row_number() OVER (ORDER BY d, mmsi) AS INT) AS rank, mmsi, '{{"type":"LineString","coordinates":[[12.6,35.5],[' || lon || ',' || lat || ']]}}' AS geometry FROM d ORDER BY d, mmsi LIMIT 5"""),
    "events_with_count": (lambda s, p: with_count(fixture(s, p, "alerts").select("event_id", "status")), f"""{ctes('alerts')} SELECT event_id, status, '{{"event_id":' || event_id || ',"status":"' || status || '"}}' AS event, (SELECT count(*) FROM alerts) AS count FROM alerts"""),
    "waveform_base64": (lambda s, p: fixture(s, p, "nmea_lines").select("seq", base64(F.col("sentence").cast("binary")).alias("b64"), F.unbase64(base64(F.col("sentence").cast("binary"))).cast("string").alias("back")), f"{ctes('nmea_lines')} SELECT seq, to_base64(encode(sentence)) AS b64, sentence AS back FROM nmea_lines"),
    "sealed_packets": (lambda s, p: sealed(fixture(s, p, "nmea_lines").select("seq", F.col("sentence").alias("canonical")), b"test key").select("seq", "hmac"), None),
}
