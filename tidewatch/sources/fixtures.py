"""Maritime inputs derived from the driver tables, by SQL that runs as it stands in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "ais_positions": r"""
SELECT event_id, CAST(247000000 + user_id AS STRING) AS mmsi, ts,
  32 + CAST((event_id * 7919) % 6001 AS DOUBLE) / 1000 AS lat,
  10 + CAST((event_id * 104729) % 8001 AS DOUBLE) / 1000 AS lon,
  CAST((event_id * 13) % 250 AS DOUBLE) / 10 AS speed,
  CAST((event_id * 37) % 360 AS DOUBLE) AS course,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 41) % 360 AS DOUBLE) END AS heading,
  CASE user_id % 7 WHEN 0 THEN 'cargo' WHEN 1 THEN 'tanker' WHEN 2 THEN 'passenger' WHEN 3 THEN 'fishing'
    WHEN 4 THEN 'tug' WHEN 5 THEN 'sailing' ELSE '' END AS vessel_type
FROM events
""",
    "ais_reports": r"""
SELECT event_id, CAST(247000000 + CASE WHEN event_id % 5 < 3 THEN 0 ELSE user_id % 40 END AS STRING) AS mmsi, event_id * 5 + CASE WHEN event_id % 1000 < 30 THEN -90 ELSE 0 END AS t_s
FROM events
""",
    "vessel_static": r"""
SELECT CAST(247000000 + s_suppkey AS STRING) AS mmsi, s_name AS ship_name,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(9000000 + s_suppkey AS STRING) END AS imo,
  CAST(20 + s_suppkey % 80 AS INT) AS ship_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE 'A' END AS ais_class
FROM supplier
""",
    "sensor_events": r"""
SELECT event_id, user_id % 10 AS platform_id, event_id * 6 AS t_s,
  CASE (event_id * 31 + user_id) % 9 WHEN 0 THEN 'infrasound:events' WHEN 1 THEN 'seismic:events'
    WHEN 2 THEN 'hydro:events' WHEN 3 THEN 'adsb:anomalies' WHEN 4 THEN 'ais:anomalies'
    WHEN 5 THEN 'sensors:ionospheric' WHEN 6 THEN 'gnss:anomalies' WHEN 7 THEN 'traffic:anomalies'
    ELSE 'weather:alerts' END AS channel,
  CAST((event_id * 17) % 100 AS DOUBLE) / 100 AS confidence
FROM events
""",
    "waveform_samples": r"""
SELECT 'mic-1' AS sensor_id, event_id AS sample_no,
  CAST((event_id * 7919) % 2001 - 1000 AS DOUBLE) / 50000
  + CASE WHEN event_id % 4000 BETWEEN 3500 AND 3560 THEN 0.8 ELSE 0.0 END AS value
FROM events
""",
    "tec_series": r"""
SELECT o_orderkey AS seq, 15 + CAST((o_orderkey * 7919) % 1001 - 500 AS DOUBLE) / 250
  + CASE WHEN o_orderkey % 997 = 500 THEN 9 ELSE 0 END AS vtec,
  CAST((o_orderkey * 31) % 70 AS DOUBLE) / 10 AS kp
FROM orders
""",
    "rf_power": r"""
SELECT event_id, event_id % 7 AS band_no, CAST(floor(event_id / 7) AS BIGINT) AS seq,
  -70 + CAST((event_id * 7919) % 61 - 30 AS DOUBLE) / 10
  + CASE WHEN event_id % 331 = 7 THEN 16 ELSE 0 END AS power_db
FROM events
""",
    "aircraft": r"""
SELECT o_orderkey AS rec_id, o_orderkey % 40 AS poll_no,
  lpad(lower(hex(CASE o_orderkey % 4 WHEN 0 THEN 11403264 + o_orderkey % 65536 WHEN 1 THEN 3932160 + o_orderkey % 65536
    WHEN 2 THEN 4440064 + o_orderkey % 4096 ELSE 5000000 + o_orderkey % 65536 END)), 6, '0') AS icao,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'FL' || CAST(o_orderkey % 900 AS STRING) END AS callsign,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(1000 + o_orderkey % 6777 AS STRING) END AS squawk,
  CAST((o_orderkey * 53) % 36000 AS DOUBLE) AS alt_ft,
  CAST(34.5 AS DOUBLE) + CAST((o_orderkey * o_orderkey * 13 + o_orderkey * 17) % 151 AS DOUBLE) / 100 AS lat,
  CAST(13.5 AS DOUBLE) + CAST((o_orderkey * o_orderkey * 29 + o_orderkey * 5) % 157 AS DOUBLE) / 100 AS lon,
  CAST((o_orderkey * 29) % 360 AS DOUBLE) AS track
FROM orders
""",
    "conflict_events": r"""
SELECT p_partkey AS conflict_id, 30 + CAST((p_partkey * p_partkey * 7 + p_partkey * 11) % 10007 AS DOUBLE) / 1000 AS latitude,
  8 + CAST((p_partkey * p_partkey * 5 + p_partkey * 23) % 14009 AS DOUBLE) / 1000 AS longitude, p_type AS event_type
FROM part WHERE p_partkey % 4 = 0
""",
    "interference_features": r"""
SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 3 = 0 THEN 'Polygon' ELSE 'Point' END AS geom_type,
  25 + CAST((p_partkey * 3571) % 25001 AS DOUBLE) / 1000 AS lat, CAST((p_partkey * 4507) % 45001 AS DOUBLE) / 1000 AS lon
FROM part WHERE p_partkey % 50 = 0
""",
    "sanctioned_mmsi": r"""
SELECT DISTINCT CAST(247000000 + s_suppkey AS STRING) AS mmsi FROM supplier WHERE s_suppkey % 17 = 3
""",
    "alerts": r"""
SELECT c_custkey AS event_id, 33 + CAST((c_custkey * 7919) % 4001 AS DOUBLE) / 1000 AS lat,
  11 + CAST((c_custkey * 104729) % 6001 AS DOUBLE) / 1000 AS lon,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(1 + c_custkey % 90 AS INT) END AS persons,
  CASE c_custkey % 5 WHEN 0 THEN 'rubber_boat' WHEN 1 THEN 'wooden_boat' WHEN 2 THEN 'sailboat' WHEN 3 THEN 'life_raft' ELSE NULL END AS vessel_type,
  CASE c_custkey % 4 WHEN 0 THEN 'sinking' WHEN 1 THEN 'taking_water' WHEN 2 THEN 'engine_failure' ELSE NULL END AS vessel_condition,
  c_custkey % 7 = 0 AS medical_emergency, c_custkey % 3 = 0 AS children_aboard,
  CAST(c_custkey % 97 AS DOUBLE) / 10 AS hours_elapsed, CAST((c_custkey * 13) % 101 AS DOUBLE) / 100 AS extraction_confidence,
  CASE c_custkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END AS status
FROM customer
""",
    "weather_obs": r"""
SELECT p_partkey AS obs_id, 30 + CAST(p_partkey % 57 AS DOUBLE) / 4 AS lat, 6 + CAST(p_partkey % 121 AS DOUBLE) / 4 AS lon,
  CAST((p_partkey * 17) % 350 AS DOUBLE) / 10 AS wind_ms, CAST((p_partkey * 47) % 3600 AS DOUBLE) / 10 AS wind_dir_deg,
  CAST((p_partkey * 11) % 70 AS DOUBLE) / 10 AS wave_m, CAST((p_partkey * 7) % 320 AS DOUBLE) / 10 AS water_temp_c,
  CAST((p_partkey * 131) % 15000 AS DOUBLE) AS visibility_m
FROM part
""",
    "distress_messages": r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'sms' ELSE 'telegram' END AS channel,
  CASE doc_id % 10
   WHEN 0 THEN 'Position: 35.' || CAST(100 + doc_id % 900 AS STRING) || ', 12.' || CAST(100 + (doc_id * 7) % 900 AS STRING) || ' 45 persons on rubber boat, sinking'
   WHEN 1 THEN 'POSITION:34.' || CAST(100 + doc_id % 900 AS STRING) || 'N/15.' || CAST(100 + (doc_id * 3) % 900 AS STRING) || 'E PERS:' || CAST(1 + doc_id % 80 AS STRING) || ' TYPE:RB'
   WHEN 2 THEN 'https://maps.google.com/?q=35.' || CAST(100 + doc_id % 900 AS STRING) || ',14.' || CAST(100 + doc_id % 900 AS STRING) || ' aiuto, bambini a bordo'
   WHEN 3 THEN 'lat: 33.' || CAST(doc_id % 90 AS STRING) || ' lon: 13.' || CAST(doc_id % 90 AS STRING) || ' engine failure, ' || CAST(1 + doc_id % 60 AS STRING) || ' people'
   WHEN 4 THEN '36.5 N 12.25 W wooden boat taking water'
   WHEN 5 THEN '35 30 N 12 36 E gommone, motore rotto, 30 persone'
   WHEN 6 THEN CAST(10 + doc_id % 40 AS STRING) || ' miles north of Lampedusa, medical emergency'
   WHEN 7 THEN 'قارب مطاطي ٤٥ شخص يغرق 34.5123, 13.4567'
   WHEN 8 THEN '[TRANSCRIPT] we are near Malta, about 20 people'
   ELSE text END AS body
FROM documents
""",
    "nmea_lines": r"""
SELECT event_id AS seq, CASE event_id % 5
  WHEN 0 THEN '$GPRMC,1' || lpad(CAST(event_id % 10 AS STRING), 1, '0') || '3519,A,35' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || '.500,N,014' || lpad(CAST((event_id * 7) % 60 AS STRING), 2, '0') || '.250,E,8.5,' || CAST(event_id % 360 AS STRING) || '.0,230394,,*00'
  WHEN 1 THEN '$GPGGA,120000,33' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || '.000,S,012' || lpad(CAST((event_id * 3) % 60 AS STRING), 2, '0') || '.750,W,' || CAST(event_id % 3 AS STRING) || ',08,0.9,5.4,M,,,,*00'
  WHEN 2 THEN '!AIVDM,1,1,,' || CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END || ',15MgK45P3@G?fl0E`JbR0OwT0@MS,0*4E'
  WHEN 3 THEN '$GPVTG,' || CAST(event_id % 360 AS STRING) || '.0,T,,M,8.0,N,14.8,K*00'
  ELSE 'noise ' || CAST(event_id AS STRING) END AS sentence
FROM events
""",
    "vessel_events": r"""
SELECT event_id AS seq, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(247000000 + user_id AS STRING) END AS vessel_id,
  CASE WHEN event_id % 4 = 0 THEN 'vessel_track' ELSE 'position_fix' END AS event_kind,
  CASE event_id % 3 WHEN 0 THEN 'aisstream' WHEN 1 THEN 'nmea0183' ELSE 'ais' END AS adapter,
  CASE WHEN event_id % 4 = 0 THEN 'raw_ais_received' WHEN event_id % 6 = 1 THEN 'fix' ELSE 'valid' END AS status,
  CASE WHEN event_id % 9 = 0 THEN 'SHIP ' || CAST(user_id AS STRING) ELSE NULL END AS ship_name,
  CASE WHEN event_id % 26 = 0 THEN 'unit-' || CAST(user_id % 5 AS STRING) ELSE NULL END AS device_id, CASE WHEN event_id % 5 = 0 THEN 'PORT "' || CAST(event_id % 50 AS STRING) || '"' ELSE NULL END AS destination,
  CASE event_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '' ELSE NULL END AS class,
  CASE WHEN event_id % 8 = 1 THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END AS course, CAST((event_id * 13) % 250 AS DOUBLE) / 10 AS speed, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 41) % 360 AS DOUBLE) END AS heading,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 32 + CAST((event_id * 7919) % 6001 AS DOUBLE) / 1000 END AS lat,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 10 + CAST((event_id * 104729) % 8001 AS DOUBLE) / 1000 END AS lon
FROM events
""",
    "particles": r"""
SELECT l_orderkey % 20 AS run_id, l_linenumber AS step, l_partkey AS particle,
  14 + CAST((l_partkey * 7919 + l_linenumber * 131) % 1001 AS DOUBLE) / 10000 AS lon,
  35 + CAST((l_partkey * 104729 + l_linenumber * 17) % 1001 AS DOUBLE) / 10000 AS lat
FROM lineitem
""",
    "alert_writes": r"""
SELECT o_orderkey AS seq, o_custkey AS event_id, CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'received' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'note "' || CAST(o_orderkey AS STRING) || '"' END AS note, o_orderdate AS created_at
FROM orders
""",
    "static_reports": r"""
SELECT s_suppkey AS seq, CAST(247000000 + s_suppkey AS STRING) AS mmsi,
  CASE s_suppkey % 4 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE ' ' || s_name || '  ' END AS name, CASE WHEN s_suppkey % 4 < 2 THEN '  META ' || s_name ELSE NULL END AS meta_name,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 9000000 + s_suppkey END AS imo, CAST(20 + s_suppkey % 80 AS INT) AS ship_type,
  CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE ' PORT ' || CAST(s_nationkey AS STRING) END AS destination
FROM supplier
""",
    "radio_samples": r"""
SELECT l_orderkey % 7 AS band_no, l_linenumber AS scan_no, CAST((l_partkey * 7919) % 2001 - 1000 AS DOUBLE) / 1000 AS re, CAST((l_partkey * 104729) % 2001 - 1000 AS DOUBLE) / 1000 AS im
FROM lineitem
""",
    "ocean_grid": r"""
SELECT 32 + CAST(p_partkey % 13 AS DOUBLE) / 2 AS grid_lat, 10 + CAST(floor(p_partkey / 13) % 15 AS DOUBLE) / 2 AS grid_lon, CAST(floor(p_partkey / 195) AS BIGINT) AS hour, CAST(p_partkey % 2 AS DOUBLE) * 0.5 AS depth_m,
  CAST((p_partkey * 7919) % 201 - 100 AS DOUBLE) / 100 AS u, CAST((p_partkey * 104729) % 201 - 100 AS DOUBLE) / 100 AS v
FROM part
""",
    "forecasts": r"""
SELECT p_partkey % 10 AS cell_no, CAST(floor(p_partkey / 10) % 4 AS DOUBLE) * 3 + CAST(p_partkey % 10 AS DOUBLE) / 10 AS hour, CAST((p_partkey * 17) % 350 AS DOUBLE) / 10 AS wind_ms
FROM part
""",
    "environment_rows": r"""
SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 320 AS DOUBLE) / 10 END AS water_temp_c, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST((p_partkey * 5) % 300 AS DOUBLE) / 10 END AS air_temp_c,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 17) % 350 AS DOUBLE) / 10 END AS wind_ms, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((p_partkey * 11) % 70 AS DOUBLE) / 10 END AS wave_m
FROM part
""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a fixture over the tables in sf_dir; only the columns it names are read."""
    sql = FIXTURES[name]
    used = [t for t in TABLES if re.search(rf"FROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """WITH ... of fixtures, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
