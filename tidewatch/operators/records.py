"""Records kept by key, what views and exports read from them, and grids that are looked up by place and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo
from tidewatch.operators.rescue import CONE, PATH, drift_cones, drift_path, intercept_rows, scored, scored_sql
from tidewatch.operators.tracks import R
from tidewatch.sources import dims
from tidewatch.sources.fixtures import ctes, fixture


def current(writes: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """Insert or update: of each key, the row written last."""
    rest = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def with_status(rows: DataFrame, updates: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """rows with the status of the last update of their key; an update of a key that is not there changes nothing."""
    last = updates.groupBy(key).agg(F.max_by("status", order).alias("new_status"))
    return rows.join(last, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def by_id(rows: DataFrame, value: int, key: str = "event_id") -> DataFrame:
    """The row of a key; the comparison reaches the scan."""
    return rows.filter(F.col(key) == value)


def newest(rows: DataFrame, limit: int, time: str = "created_at", tie: str = "seq") -> DataFrame:
    """The rows written last, newest first, with their rank."""
    some = rows.orderBy(F.desc(time), F.desc(tie)).limit(limit)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(time), F.desc(tie))))


def ring(rows: DataFrame, size: int = 10_000, order: str = "seq") -> DataFrame:
    """A bounded buffer: the last rows by order. Only so many reach the driver's last task."""
    return rows.orderBy(F.desc(order)).limit(size)


def oldest_of_tail(rows: DataFrame, tail: int = 50, shown: int = 12, order: str = "seq") -> DataFrame:
    """The oldest few of the last rows of a log."""
    return ring(rows, tail, order).orderBy(order).limit(shown)


def since(rows: DataFrame, text: str | None, time: str = "created_at") -> DataFrame:
    """Rows from a time on (ISO, Z allowed), that time included; what is no time filters nothing."""
    iso = F.when(F.lit(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(text))  # Spark takes words such as yesterday, too
    start = F.try_to_timestamp(iso).cast("timestamp_ntz")
    return rows.filter(start.isNull() | (F.col(time) >= start))


def stored_or(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows, or others if there are none."""
    some = rows.limit(1).select(F.lit(True).alias("some"))
    return rows.unionByName(others.join(F.broadcast(some), how="left_anti"))


def static_report(rows: DataFrame) -> DataFrame:
    """Static reports of class A: names and destinations trimmed, empty ones null; the name falls back to the envelope's."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("meta_name"))
    return rows.select("mmsi", filled(named).alias("ship_name"), "imo", "ship_type", filled(F.col("destination")).alias("destination"))


def band_power(samples: DataFrame) -> DataFrame:
    """Power of each band and scan in dB: ten times the logarithm of the mean square, never of zero."""
    square = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return samples.groupBy("band_no", "scan_no").agg(geo.rounded(10 * F.log10(square + F.lit(1e-12)), 6).alias("power_db"))


def degrees(value: Column, hemisphere: Column) -> Column:
    """Degrees of a sentence's ddmm.mmm, the minutes being the two digits before the dot and what follows; blank is 0, south and west are negative."""
    dot = F.when(value.contains("."), F.instr(value, ".")).otherwise(F.length(value) + 1)
    whole = F.substr(value, F.lit(1), dot - 3).cast("int") + F.substr(value, dot - 2).cast("double") / 60
    return F.when(F.coalesce(value, F.lit("")) == "", 0.0).otherwise(F.when(hemisphere.isin("S", "W"), -whole).otherwise(whole))


def axis(grid: DataFrame, column: str) -> DataFrame:
    """One row: the distinct coordinates of a grid along an axis, which are few however large the grid."""
    return grid.agg(F.array_sort(F.collect_set(column)).alias(f"{column}_axis"))


def nearest_on(values: Column, x: Column) -> Column:
    """The value nearest to x, the lower one on ties."""
    return F.array_min(F.transform(values, lambda a: F.struct(F.abs(a - x).alias("d"), a.alias("a"))))["a"]


def ocean_at(points: DataFrame, grid: DataFrame, hours: tuple[int, int], margin: float = 0.2, depth: float = 1.0) -> DataFrame:
    """The current at each point: the nearest coordinate along each axis, then the last hour and the first depth there.

    Box, depth and hours go down to the scan of the grid; the box is that of the points and a margin.
    """
    box = points.agg((F.min("lat") - margin).alias("south"), (F.max("lat") + margin).alias("north"), (F.min("lon") - margin).alias("west"), (F.max("lon") + margin).alias("east")).first()
    near = grid.filter(F.col("grid_lat").between(box["south"], box["north"]) & F.col("grid_lon").between(box["west"], box["east"]) & (F.col("depth_m") <= depth) & F.col("hour").between(*hours))
    cells = near.groupBy("grid_lat", "grid_lon").agg(F.max_by(F.struct("u", "v"), F.struct("hour", -F.col("depth_m"))).alias("c"))
    at = points.crossJoin(F.broadcast(axis(near, "grid_lat"))).crossJoin(F.broadcast(axis(near, "grid_lon")))  # one row each
    at = at.select("event_id", nearest_on(F.col("grid_lat_axis"), F.col("lat")).alias("grid_lat"), nearest_on(F.col("grid_lon_axis"), F.col("lon")).alias("grid_lon"))
    speed, towards = geo.polar(F.col("c.u"), F.col("c.v"))
    out = at.join(cells, ["grid_lat", "grid_lon"], "left")
    return out.select("event_id", "grid_lat", "grid_lon", geo.rounded(speed, 4).alias("speed"), geo.rounded(towards, 4).alias("towards"))


def forecast_at(points: DataFrame, forecasts: DataFrame, at: str = "hours_elapsed") -> DataFrame:
    """Of the forecasts of a point's cell the first at or after its time, else the first of all."""
    hours = forecasts.groupBy("cell_no").agg(F.array_sort(F.collect_set(F.struct("hour", "wind_ms"))).alias("f"))
    met = points.join(hours, "cell_no", "left")
    later = F.filter("f", lambda x: x["hour"] >= F.col(at))
    chosen = F.coalesce(F.get(later, F.lit(0)), F.get("f", F.lit(0)))
    return met.select("event_id", chosen["hour"].alias("hour"), chosen["wind_ms"].alias("wind_ms"))


def grid_points(spark: SparkSession, n: int, south: float, north: float, west: float, east: float) -> DataFrame:
    """n times n points over a box, row by row from the south-west, numbered from 0."""
    if not 3 <= n <= 10:
        raise ValueError("n is 3 to 10")
    place = spark.range(n * n).select(F.col("id").alias("place"))
    lat, lon = F.floor(F.col("place") / n), F.pmod(F.col("place"), F.lit(n))
    return place.select("place", (south + (north - south) * lat / (n - 1)).alias("lat"), (west + (east - west) * lon / (n - 1)).alias("lon"))


def zipped(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Points with the row of the same number; a point without one keeps nulls."""
    return points.join(rows, "place", "left")


#: The environment where nothing is given.
DEFAULTS = {"water_temp_c": 18.0, "air_temp_c": 20.0, "wind_ms": 5.0, "wave_m": 1.0}


def environment(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The environment that holds: the last row, with defaults for what it leaves out."""
    last = rows.agg(F.max_by(F.struct("water_temp_c", "air_temp_c", "wind_ms", "wave_m"), order).alias("e"))
    return last.select(*[F.coalesce(F.col("e")[c], F.lit(d)).alias(c) for c, d in DEFAULTS.items()])


def mock_environment(rows: DataFrame, second: Column) -> DataFrame:
    """An environment that swings with the given second, where no source is on hand."""
    wave = lambda base, swing, period: geo.rounded(base + swing * F.sin(second / period), 2)
    rising = lambda base, swing, period: geo.rounded(base + swing * F.abs(F.sin(second / period)), 2)
    return rows.select("seq", wave(18.0, 2.0, 3600).alias("water_temp_c"), wave(20.0, 3.0, 7200).alias("air_temp_c"), rising(5.0, 3.0, 1800).alias("wind_ms"), rising(0.8, 0.4, 2400).alias("wave_m"))


def held_environment(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The environment after all updates: of each field the last value given, or its default if none was."""
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) for c in DEFAULTS}
    return rows.agg(*[F.coalesce(v, F.lit(DEFAULTS[c])).alias(c) for c, v in last.items()])


def engine_state(signals: DataFrame, resolved: DataFrame, env: DataFrame, assets: DataFrame) -> DataFrame:
    """Open signals, each as last written, scored under the environment that holds, highest priority first."""
    open_ = current(signals).join(resolved.select("event_id").distinct(), "event_id", "left_anti")
    met = open_.crossJoin(F.broadcast(held_environment(env)))  # one row
    return scored(met, assets, F.col("water_temp_c"), F.col("wind_ms"), F.col("wave_m"), "seq", "status", "water_temp_c", "wind_ms")


def hours_since(rows: DataFrame, as_of: Column, time: str) -> DataFrame:
    """Hours from a time to another, never below 0."""
    gone = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / F.lit(3.6e9)
    return rows.withColumn("hours_elapsed", F.greatest(F.lit(0.0), gone))


def alert_record(signals: DataFrame) -> DataFrame:
    """The alert that a signal becomes, its details in one struct; urgent if a person must look at it."""
    details = F.struct("persons", "vessel_type", "vessel_condition", "medical_emergency", "children_aboard", "raw_text", "requires_human_review")
    source = F.concat_ws(":", "source_channel", "source_id")
    urgency = F.when(F.col("requires_human_review"), "IMMEDIATE").otherwise("ROUTINE")
    return signals.select(F.col("signal_id").alias("alert_id"), source.alias("source"), "timestamp_utc", "lat", "lon", F.lit("distress_signal").alias("classification"), F.col("extraction_confidence").alias("confidence"), urgency.alias("urgency"), details.alias("metadata"))


def packets(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows with canonical, their fields as JSON in order of name, nulls and escapes included, and its SHA-256. Numbers with a fraction belong in whole units, which every writer renders alike."""
    text = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return rows.withColumn("canonical", text).withColumn("sha256", F.sha2("canonical", 256))


def checked(stored: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """event_id and whether a stored packet's digest is that of the fields it is stored with."""
    return packets(stored.withColumnRenamed("sha256", "claimed").drop("canonical"), fields).select("event_id", (F.col("sha256") == F.col("claimed")).alias("hash_match"))


def messages(rows: DataFrame, channel: str) -> DataFrame:
    """What is published: a channel (the key) and one JSON value for each row, as Kafka's writer takes them."""
    return rows.select(F.lit(channel).alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def of_kind(rows: DataFrame, kind: str = "all") -> DataFrame:
    """Rows of an anomaly type, which falls back to their source, or all."""
    typed = rows.withColumn("kind", F.coalesce("anomaly_type", "source"))
    return typed if kind == "all" else typed.filter(F.col("kind") == kind)


def first_payloads(events: DataFrame) -> DataFrame:
    """Of each platform and channel the oldest event's payload."""
    return events.groupBy("platform_id", "channel").agg(F.min_by(F.struct("event_id", "confidence"), F.struct("t_s", "event_id")).alias("p")).select("platform_id", "channel", F.col("p.event_id").alias("event_id"), F.col("p.confidence").alias("confidence"))


def features(alerts: DataFrame) -> DataFrame:
    """An alert's features in order, a row each: its path as a line, a cone for each horizon as a polygon, the end of the path as a point."""
    point = F.array("lon", "lat")
    path = drift_path(alerts).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("step", point.alias("xy")))).alias("s"))
    xy = F.transform("s", lambda p: p["xy"])
    line = path.select("event_id", F.lit(0).alias("place"), F.lit("trajectory").alias("kind"), F.lit("LineString").alias("type"), F.size("s").alias("points"), F.to_json(F.struct(xy.alias("c"))).alias("json"))
    end = path.select("event_id", F.lit(4).alias("place"), F.lit("impact").alias("kind"), F.lit("Point").alias("type"), F.lit(1).alias("points"), F.to_json(F.struct(F.element_at(xy, -1).alias("c"))).alias("json"))
    fans = drift_cones(alerts).groupBy("event_id", "hours").agg(F.array_sort(F.collect_list(F.struct("vertex", point.alias("xy")))).alias("s"))
    place = F.when(F.col("hours") == 6, 1).when(F.col("hours") == 12, 2).otherwise(3)
    cone = fans.select("event_id", place.alias("place"), F.concat(F.lit("cone_"), F.col("hours"), F.lit("h")).alias("kind"), F.lit("Polygon").alias("type"), F.size("s").alias("points"), F.to_json(F.struct(F.array(xy).alias("c"))).alias("json"))
    return reduce(DataFrame.unionByName, [line, cone, end])


def collection(alerts: DataFrame) -> DataFrame:
    """One GeoJSON collection for each alert."""
    geometry = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), F.col("type"), F.lit('","coordinates":'), F.regexp_extract("json", r'^\{"c":(.*)\}$', 1), F.lit('},"properties":{"kind":"'), F.col("kind"), F.lit('"}}'))
    each = features(alerts).select("event_id", F.struct("place", geometry.alias("f")).alias("f"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["f"]), ",")
    return each.groupBy("event_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


def vessel_collection(vessels: DataFrame) -> DataFrame:
    """A feature for each vessel with a position: the name falls back to the MMSI, the class to A, the destination to nothing."""
    row = vessels.filter("lat IS NOT NULL AND lon IS NOT NULL")
    return row.select("mmsi", "lon", "lat", F.coalesce(F.nullif(F.trim("ship_name"), F.lit("")), F.col("mmsi")).alias("name"), F.coalesce("ais_class", F.lit("A")).alias("ais_class"), F.coalesce("destination", F.lit("")).alias("destination"), F.count(F.lit(1)).over(Window.partitionBy()).alias("total"))


def chart_objects(alerts: DataFrame) -> DataFrame:
    """What a plotter takes: a mark at the last position, a route of the path's vertices, a zone for each cone."""
    f = features(alerts)
    kind = F.when(F.col("kind") == "impact", "mark").when(F.col("kind") == "trajectory", "route").otherwise("zone")
    return f.select("event_id", kind.alias("object"), F.concat_ws("-", F.lit("SAR"), F.col("event_id"), F.col("kind")).alias("name"), "points")


#: Fixed values of a drift's document: a style for each cone (id, colour) and its label.
CONE_STYLES = {6: ("amber", "7f00a5ff", "Amber 6h"), 12: ("orange_", "7f0055ff", "Orange 12h"), 24: ("red_", "7f0000ff", "Red 24h")}
KML_HEAD = "<?xml version='1.0' encoding='UTF-8'?>\n<kml xmlns=\"http://www.opengis.net/kml/2.2\">\n  <Document>\n    <name>Drift "
KML_STYLES = "</name>\n" + "".join(
    f'    <Style id="{i}">\n      <PolyStyle>\n        <color>{c}</color>\n        <fill>1</fill>\n        <outline>1</outline>\n      </PolyStyle>\n      <LineStyle>\n        <color>{c}</color>\n        <width>2</width>\n      </LineStyle>\n    </Style>\n'
    for i, c, _ in CONE_STYLES.values()
)
MARK = ("    <Placemark>\n      <name>", "</name>\n")
POINT = ("      <Point>\n        <coordinates>", "</coordinates>\n      </Point>\n    </Placemark>\n")
LINE = ("      <LineString>\n        <coordinates>", "</coordinates>\n      </LineString>\n    </Placemark>\n")
ZONE = ("      <Polygon>\n        <outerBoundaryIs>\n          <LinearRing>\n            <coordinates>", "</coordinates>\n          </LinearRing>\n        </outerBoundaryIs>\n      </Polygon>\n    </Placemark>\n")
KML_TAIL = "  </Document>\n</kml>"


def kml_documents(alerts: DataFrame) -> DataFrame:
    """A document for each alert with a position: styles, the datum, the path as a line and a zone for each cone. Alerts are dealt once, before they grow to documents."""
    alerts = alerts.repartition("event_id")
    at = lambda lon, lat: F.concat(lon.cast("string"), F.lit(","), lat.cast("string"), F.lit(",0"))
    line = lambda rows, order, *key: rows.groupBy("event_id", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, at(F.col("lon"), F.col("lat")).alias("at")))), lambda x: x["at"]), " ").alias("line"))
    path = line(drift_path(alerts), "step")
    zones = line(drift_cones(alerts), "vertex", "hours")
    style = lambda i: reduce(lambda c, h: c.when(F.col("hours") == h, CONE_STYLES[h][i]), CONE_STYLES, F)
    zone = F.concat(F.lit(MARK[0]), style(2), F.lit(MARK[1] + "      <styleUrl>#"), style(0), F.lit("</styleUrl>\n" + ZONE[0]), F.col("line"), F.lit(ZONE[1]))
    cones = zones.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hours", zone.alias("z")))), lambda x: x["z"]), "").alias("zones"))
    met = alerts.select("event_id", "lat", "lon").join(path.hint("merge"), "event_id").join(cones.hint("merge"), "event_id")
    name = F.substring(F.col("event_id").cast("string"), 1, 8)
    datum = F.concat(F.lit(MARK[0] + "DATUM" + MARK[1] + POINT[0]), at(F.col("lon"), F.col("lat")), F.lit(POINT[1]))
    track = F.concat(F.lit(MARK[0] + "Trajectory" + MARK[1] + LINE[0]), F.col("line"), F.lit(LINE[1]))
    return met.select("event_id", F.concat(F.lit(KML_HEAD), name, F.lit(KML_STYLES), datum, track, F.col("zones"), F.lit(KML_TAIL)).alias("kml"))


def _kml_sql() -> str:
    t = lambda x: "'" + x.replace("'", "''") + "'"
    style = lambda i: "CASE hours " + " ".join(f"WHEN {h} THEN {t(v[i])}" for h, v in CONE_STYLES.items()) + " END"
    return f"""{ctes("alerts")}, p AS (SELECT event_id, string_agg(lon || ',' || lat || ',0', ' ' ORDER BY step) AS line FROM ({PATH}) GROUP BY event_id),
    z AS (SELECT event_id, hours, string_agg(lon || ',' || lat || ',0', ' ' ORDER BY vertex) AS line FROM ({CONE}) GROUP BY ALL),
    c AS (SELECT event_id, string_agg({t(MARK[0])} || {style(2)} || {t(MARK[1] + "      <styleUrl>#")} || {style(0)} || {t("</styleUrl>" + chr(10) + ZONE[0])} || line || {t(ZONE[1])}, '' ORDER BY hours) AS zones FROM z GROUP BY event_id)
    SELECT event_id, {t(KML_HEAD)} || substring(CAST(event_id AS VARCHAR), 1, 8) || {t(KML_STYLES + MARK[0] + "DATUM" + MARK[1] + POINT[0])} || a.lon || ',' || a.lat || ',0' || {t(POINT[1] + MARK[0] + "Trajectory" + MARK[1] + LINE[0])} || p.line || {t(LINE[1])} || zones || {t(KML_TAIL)} AS kml
    FROM alerts a JOIN p USING (event_id) JOIN c USING (event_id)"""


def shortened(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """The first items of each key, at most so many, and how many there are."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(item))
    some = rows.select(key, item).distinct().withColumn("place", place)
    return some.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col(item)))).alias("items"), F.count(F.lit(1)).alias("total"))


#: Drift models that can be asked for, the domain and the public class of each, its parameters.
MODELS = (
    ("leeway", "ocean_sar", "opendrift.models.leeway.Leeway", "object_type=26 wind_drift_depth=0.1 wind_drift_factor=0.035", True),
    ("openoil", "ocean_oil", "opendrift.models.openoil.OpenOil", "do3D=true oil_type=GENERIC LIGHT CRUDE", False),
    ("windblow", "atmosphere", "opendrift.models.windblow.WindBlow", "weight=1.0", False),
    ("ballistic", "atmosphere", "", "", True),
)
#: Fixed values of the stand-in ionospheric event: bearing, speed, amplitude, stations, confidence, for a mock and for a replay.
IONOSPHERIC = (("mock", 42.0, 750.0, 0.45, 4, 0.82), ("replay", 45.0, 800.0, 0.5, 5, 0.85))


def model_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "name string, domain string, class string, parameters string, runs boolean")


def stand_in_events(spark: SparkSession, lat: float, lon: float, kp: float) -> DataFrame:
    rows = spark.createDataFrame(IONOSPHERIC, "data_source string, bearing double, velocity_ms double, amplitude_tecu double, stations int, confidence double")
    stub = F.base64(F.lit("TEC_STUB").cast("binary"))
    return rows.select("*", F.lit("ballistic_candidate").alias("classification"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.lit(kp).alias("kp_index"), stub.alias("raw_b64"))


def top_stats(positions: DataFrame, events: DataFrame, alerts: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """The console's four counters: vessels active in half an hour, recent events, open alerts, packets."""
    active = positions.filter(F.col("ts") >= as_of - F.expr("interval 30 minutes")).agg(F.count_distinct("mmsi").alias("n"))
    rows = [("AIS", active), ("Signals", events.limit(50).agg(F.count(F.lit(1)).alias("n"))), ("Alerts", alerts.filter("status <> 'completed'").agg(F.count(F.lit(1)).alias("n"))), ("Forensics", stored.agg(F.count(F.lit(1)).alias("n")))]
    return reduce(DataFrame.unionByName, [n.select(F.lit(label).alias("label"), F.col("n").cast("long").alias("value")) for label, n in rows])


W, E, A = "alert_writes", "environment_rows", "alerts"
FIELDS = ("event_id", "status", "note", "seq")
AS_OF = "timestamp_ntz'2024-01-29 00:00:00'"
CANONICAL = "'{{\"event_id\":' || event_id || ',\"note\":' || coalesce('\"' || replace(note, '\"', '\\\"') || '\"', 'null') || ',\"seq\":' || seq || ',\"status\":\"' || status || '\"}}'".replace("{{", "{").replace("}}", "}")
LAST = f"{ctes(W)}, l AS (SELECT * FROM alert_writes QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1)"
SIGNAL = {"signal_id": "CAST(event_id AS STRING)", "source_channel": "'sms'", "source_id": "CAST(event_id % 10 AS STRING)", "timestamp_utc": "timestamp_ntz'2024-01-01 00:00:00'", "raw_text": "vessel_condition", "requires_human_review": "extraction_confidence < 0.5"}


def signals_of(s, p) -> DataFrame:
    return fixture(s, p, A).withColumns({k: F.expr(v) for k, v in SIGNAL.items()})


def alert_records(s, p) -> DataFrame:
    return alert_record(signals_of(s, p)).select("alert_id", "source", "classification", "confidence", "urgency", "metadata.persons", "metadata.raw_text", "metadata.requires_human_review")


def vessels_of(s, p) -> DataFrame:
    last = fixture(s, p, "ais_positions").groupBy("mmsi").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "event_id")).alias("v")).select("mmsi", "v.*")
    return last.join(fixture(s, p, "vessel_static").select("mmsi", "ship_name", "ais_class", F.lit(None).cast("string").alias("destination")), "mmsi", "left")


NEAR_AXIS = "(SELECT x FROM (SELECT DISTINCT {c} AS x FROM n) ORDER BY abs(x - {p}), x LIMIT 1)"
QUERIES = {
    "alerts_current": (lambda s, p: current(fixture(s, p, W)), f"{LAST} SELECT event_id, seq, status, note, created_at FROM l"),
    "alerts_status_updated": (
        lambda s, p: with_status(fixture(s, p, A).select("event_id", "status"), fixture(s, p, W).filter("seq % 3 = 0")),
        f"{ctes(A, W)}, u AS (SELECT event_id, arg_max(status, seq) AS s FROM alert_writes WHERE seq % 3 = 0 GROUP BY event_id) SELECT event_id, coalesce(s, status) AS status FROM alerts LEFT JOIN u USING (event_id)",
    ),
    "alert_by_id": (lambda s, p: by_id(fixture(s, p, A), 7).select("event_id", "lat", "lon", "status"), f"{ctes(A)} SELECT event_id, lat, lon, status FROM alerts WHERE event_id = 7"),
    "alerts_newest": (lambda s, p: newest(fixture(s, p, W), 50).select("rank", "seq", "event_id"), f"{ctes(W)} SELECT CAST(row_number() OVER (ORDER BY created_at DESC, seq DESC) AS INT) AS rank, seq, event_id FROM alert_writes ORDER BY created_at DESC, seq DESC LIMIT 50"),
    "anomaly_ring": (lambda s, p: ring(fixture(s, p, "sensor_events").select("event_id", "channel"), 10_000, "event_id"), f"{ctes('sensor_events')} SELECT event_id, channel FROM sensor_events ORDER BY event_id DESC LIMIT 10000"),
    "ops_recent_events": (
        lambda s, p: oldest_of_tail(fixture(s, p, "vessel_events")).select("seq", "status", "adapter", "vessel_id", "ship_name", "lat", "lon"),
        f"{ctes('vessel_events')}, t AS (SELECT * FROM vessel_events ORDER BY seq DESC LIMIT 50) SELECT seq, status, adapter, vessel_id, ship_name, lat, lon FROM t ORDER BY seq LIMIT 12",
    ),
    "packets_since": (lambda s, p: since(fixture(s, p, W), "1996-01-01T00:00:00Z").select("seq"), f"{ctes(W)} SELECT seq FROM alert_writes WHERE created_at >= TIMESTAMP '1996-01-01 00:00:00'"),
    "packets_since_no_time": (lambda s, p: since(fixture(s, p, W), "yesterday").select("seq"), f"{ctes(W)} SELECT seq FROM alert_writes"),
    "packets_or_memory": (
        lambda s, p: stored_or(fixture(s, p, W).filter("seq < 0").select("seq"), fixture(s, p, W).filter("seq % 5 = 0").select("seq")).unionByName(stored_or(fixture(s, p, W).filter("seq % 7 = 0").select("seq"), fixture(s, p, W).select("seq"))),
        f"{ctes(W)} SELECT seq FROM alert_writes WHERE seq % 5 = 0 UNION ALL SELECT seq FROM alert_writes WHERE seq % 7 = 0",
    ),
    "static_reports": (
        lambda s, p: static_report(fixture(s, p, "static_reports")),
        f"{ctes('static_reports')} SELECT mmsi, nullif(trim(coalesce(nullif(name, ''), meta_name)), '') AS ship_name, imo, ship_type, nullif(trim(destination), '') AS destination FROM static_reports",
    ),
    "radio_power": (lambda s, p: band_power(fixture(s, p, "radio_samples")), f"{ctes('radio_samples')} SELECT band_no, scan_no, {R('10 * log10(avg(re * re + im * im) + 1e-12)', 6)} AS power_db FROM radio_samples GROUP BY band_no, scan_no"),
    "sentence_degrees": (
        lambda s, p: fixture(s, p, "nmea_lines").filter("sentence LIKE '$GPGGA%'").select("seq", F.split("sentence", ",").alias("f")).select("seq", degrees(F.col("f")[2], F.col("f")[3]).alias("lat"), degrees(F.col("f")[4], F.col("f")[5]).alias("lon"), degrees(F.lit(""), F.lit("N")).alias("blank"), degrees(F.lit("4530"), F.lit("N")).alias("no_dot")),
        f"""{ctes('nmea_lines')}, f AS (SELECT seq, string_split(sentence, ',') AS f FROM nmea_lines WHERE sentence LIKE '$GPGGA%') SELECT seq, (CASE f[4] WHEN 'S' THEN -1 ELSE 1 END) * (CAST(f[3][1:2] AS INT) + CAST(f[3][3:] AS DOUBLE) / 60) AS lat, (CASE f[6] WHEN 'W' THEN -1 ELSE 1 END) * (CAST(f[5][1:3] AS INT) + CAST(f[5][4:] AS DOUBLE) / 60) AS lon, 0e0 AS blank, 45.5e0 AS no_dot FROM f""",
    ),
    "longitudes_wrapped": (lambda s, p: fixture(s, p, A).select("event_id", geo.wrapped(F.col("lon") * 40 - 500).alias("lon")), f"{ctes(A)}, x AS (SELECT event_id, lon * 40 - 500 AS l FROM alerts) SELECT event_id, CASE WHEN abs(l) <= 180 THEN l ELSE l + 180 - floor((l + 180) / 360e0) * 360e0 - 180 END AS lon FROM x"),
    "wind_vectors": (
        lambda s, p: fixture(s, p, "weather_obs").select("obs_id", *[geo.rounded(x, 4).alias(n) for n, x in zip(("u", "v"), geo.vector(F.col("wind_ms"), F.col("wind_dir_deg")))]),
        f"{ctes('weather_obs')} SELECT obs_id, {R('wind_ms * sin(radians(wind_dir_deg))', 4)} AS u, {R('wind_ms * cos(radians(wind_dir_deg))', 4)} AS v FROM weather_obs",
    ),
    "ocean_currents": (
        lambda s, p: ocean_at(fixture(s, p, A), fixture(s, p, "ocean_grid"), (0, 20)),
        f"""{ctes(A, 'ocean_grid')}, n AS (SELECT * FROM ocean_grid WHERE depth_m <= 1 AND hour BETWEEN 0 AND 20 AND grid_lat BETWEEN (SELECT min(lat) - 0.2e0 FROM alerts) AND (SELECT max(lat) + 0.2e0 FROM alerts) AND grid_lon BETWEEN (SELECT min(lon) - 0.2e0 FROM alerts) AND (SELECT max(lon) + 0.2e0 FROM alerts)),
        c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY grid_lat, grid_lon ORDER BY hour DESC, depth_m) = 1), la AS (SELECT DISTINCT grid_lat AS x FROM n), lo AS (SELECT DISTINCT grid_lon AS x FROM n),
        pa AS (SELECT event_id, x AS grid_lat FROM alerts, la QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(x - lat), x) = 1), po AS (SELECT event_id, x AS grid_lon FROM alerts, lo QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(x - lon), x) = 1)
        SELECT event_id, grid_lat, grid_lon, {R('sqrt(u * u + v * v)', 4)} AS speed, {R('fmod(degrees(atan2(u, v)) + 360, 360e0)', 4)} AS towards FROM pa JOIN po USING (event_id) LEFT JOIN c USING (grid_lat, grid_lon)""",
    ),
    "forecast_of_cell": (
        lambda s, p: forecast_at(fixture(s, p, A).select("event_id", (F.col("event_id") % 12).alias("cell_no"), "hours_elapsed"), fixture(s, p, "forecasts")),
        f"""{ctes(A, 'forecasts')}, x AS (SELECT event_id, hours_elapsed, hour, wind_ms FROM alerts LEFT JOIN forecasts ON cell_no = event_id % 12)
        SELECT event_id, hour, wind_ms FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY coalesce(hour >= hours_elapsed, false) DESC, hour, wind_ms) = 1""",
    ),
    "weather_grid_zipped": (
        lambda s, p: zipped(grid_points(s, 5, 34.0, 38.0, 11.0, 15.0), fixture(s, p, "weather_obs").select((F.col("obs_id") * 2).alias("place"), "wind_ms", "wave_m")),
        f"{ctes('weather_obs')} SELECT g AS place, 34 + 4e0 * floor(g / 5e0) / 4 AS lat, 11 + 4e0 * (g % 5) / 4 AS lon, wind_ms, wave_m FROM range(25) r(g) LEFT JOIN weather_obs ON obs_id * 2 = g",
    ),
    "environment_now": (lambda s, p: environment(fixture(s, p, E)), f"{ctes(E)} SELECT coalesce(water_temp_c, 18e0) AS water_temp_c, coalesce(air_temp_c, 20e0) AS air_temp_c, coalesce(wind_ms, 5e0) AS wind_ms, coalesce(wave_m, 1e0) AS wave_m FROM environment_rows ORDER BY seq DESC LIMIT 1"),
    "environment_mock": (
        lambda s, p: mock_environment(fixture(s, p, E), F.col("seq") * 60),
        f"{ctes(E)} SELECT seq, {R('18 + 2e0 * sin(seq * 60e0 / 3600)', 2)} AS water_temp_c, {R('20 + 3e0 * sin(seq * 60e0 / 7200)', 2)} AS air_temp_c, {R('5 + 3e0 * abs(sin(seq * 60e0 / 1800))', 2)} AS wind_ms, {R('0.8e0 + 0.4e0 * abs(sin(seq * 60e0 / 2400))', 2)} AS wave_m FROM environment_rows",
    ),
    "alert_kml_documents": (lambda s, p: kml_documents(fixture(s, p, A)), _kml_sql()),
    "engine_state": (
        lambda s, p: engine_state(fixture(s, p, W).select("event_id", "seq", "status").join(fixture(s, p, A).drop("status"), "event_id"), fixture(s, p, A).filter("event_id % 4 = 1"), fixture(s, p, E), dims.assets(s)),
        f"""{ctes(W, A, E).replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT coalesce(arg_max(water_temp_c, seq), 18e0) AS water_temp_c, coalesce(arg_max(wind_ms, seq), 5e0) AS wind_ms, coalesce(arg_max(wave_m, seq), 1e0) AS wave_m FROM environment_rows),
        o AS (SELECT a.* EXCLUDE (status), w.seq, w.status, e.* FROM alerts a JOIN (SELECT event_id, max(seq) AS seq, arg_max(status, seq) AS status FROM alert_writes GROUP BY event_id) w USING (event_id), e WHERE event_id % 4 <> 1),
        {intercept_rows("o", "(SELECT water_temp_c FROM e)")}, {scored_sql("o", ("water_temp_c", "wind_ms", "wave_m"), "seq, status, water_temp_c, wind_ms,")}""",
    ),
    "hours_elapsed": (
        lambda s, p: hours_since(fixture(s, p, W), F.expr("timestamp_ntz'1997-01-01 00:00:00'"), "created_at").select("seq", geo.rounded(F.col("hours_elapsed"), 3).alias("hours_elapsed")),
        f"{ctes(W)} SELECT seq, {R('greatest(0e0, epoch_us(TIMESTAMP ' + chr(39) + '1997-01-01 00:00:00' + chr(39) + ') / 3.6e9 - epoch_us(created_at) / 3.6e9)', 3)} AS hours_elapsed FROM alert_writes",
    ),
    "alert_records": (alert_records, f"{ctes(A)} SELECT CAST(event_id AS STRING) AS alert_id, 'sms:' || (event_id % 10) AS source, 'distress_signal' AS classification, extraction_confidence AS confidence, CASE WHEN extraction_confidence < 0.5 THEN 'IMMEDIATE' ELSE 'ROUTINE' END AS urgency, persons, vessel_condition AS raw_text, extraction_confidence < 0.5 AS requires_human_review FROM alerts"),
    "forensic_packets": (lambda s, p: packets(fixture(s, p, W), FIELDS).select("seq", "canonical", "sha256"), f"{ctes(W)}, c AS (SELECT seq, {CANONICAL} AS canonical FROM alert_writes) SELECT seq, canonical, sha256(canonical) AS sha256 FROM c"),
    "forensic_checked": (
        lambda s, p: checked(packets(fixture(s, p, W), FIELDS).withColumn("status", F.when(F.col("seq") % 9 == 0, "forged").otherwise(F.col("status"))), FIELDS),
        f"{ctes(W)} SELECT event_id, seq % 9 <> 0 AS hash_match FROM alert_writes",
    ),
    "published_anomalies": (
        lambda s, p: messages(fixture(s, p, "sensor_events").filter("channel = 'ais:anomalies'").select("event_id", "platform_id", "t_s"), "ais:anomalies"),
        f"""{ctes('sensor_events')} SELECT 'ais:anomalies' AS key, '{{"event_id":' || event_id || ',"platform_id":' || platform_id || ',"t_s":' || t_s || '}}' AS value FROM sensor_events WHERE channel = 'ais:anomalies'""",
    ),
    "anomalies_of_kind": (
        lambda s, p: of_kind(fixture(s, p, "sensor_events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.split("channel", ":")[0]).alias("anomaly_type"), F.lit("adsb").alias("source")), "adsb").select("event_id", "kind"),
        f"{ctes('sensor_events')} SELECT event_id, 'adsb' AS kind FROM sensor_events WHERE event_id % 2 <> 0 OR string_split(channel, ':')[1] = 'adsb'",
    ),
    "first_payloads": (lambda s, p: first_payloads(fixture(s, p, "sensor_events")), f"{ctes('sensor_events')} SELECT platform_id, channel, event_id, confidence FROM sensor_events QUALIFY row_number() OVER (PARTITION BY platform_id, channel ORDER BY t_s, event_id) = 1"),
    "alert_feature_rows": (
        lambda s, p: features(fixture(s, p, A)).select("event_id", "place", "kind", "type", "points"),
        f"{ctes(A)} SELECT event_id, place, kind, type, points FROM alerts, (VALUES (0, 'trajectory', 'LineString', 25), (1, 'cone_6h', 'Polygon', 23), (2, 'cone_12h', 'Polygon', 23), (3, 'cone_24h', 'Polygon', 23), (4, 'impact', 'Point', 1)) v(place, kind, type, points)",
    ),
    "alert_impacts": (
        lambda s, p: features(fixture(s, p, A)).filter("kind = 'impact'").select("event_id", F.from_json("json", "c array<double>")["c"][0].alias("lon"), F.from_json("json", "c array<double>")["c"][1].alias("lat")),
        f"SELECT event_id, lon, lat FROM ({PATH}) WHERE step = 24",
    ),
    "alert_cone_rings": (
        lambda s, p: features(fixture(s, p, A)).filter("type = 'Polygon'").select("event_id", "kind", F.posexplode(F.from_json("json", "c array<array<array<double>>>")["c"][0]).alias("vertex", "xy")).select("event_id", "kind", "vertex", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat")),
        f"SELECT event_id, 'cone_' || hours || 'h' AS kind, vertex, lon, lat FROM ({CONE})",
    ),
    "chart_objects": (
        lambda s, p: chart_objects(fixture(s, p, A)),
        f"{ctes(A)} SELECT event_id, object, 'SAR-' || event_id || '-' || kind AS name, points FROM alerts, (VALUES ('route', 'trajectory', 25), ('zone', 'cone_6h', 23), ('zone', 'cone_12h', 23), ('zone', 'cone_24h', 23), ('mark', 'impact', 1)) v(object, kind, points)",
    ),
    "vessel_collection": (
        lambda s, p: vessel_collection(vessels_of(s, p)),
        f"{ctes('ais_positions', 'vessel_static')}, v AS (SELECT * FROM ais_positions QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) = 1) SELECT mmsi, lon, lat, coalesce(nullif(trim(ship_name), ''), mmsi) AS name, coalesce(ais_class, 'A') AS ais_class, '' AS destination, count(*) OVER () AS total FROM v LEFT JOIN vessel_static USING (mmsi)",
    ),
    "chokepoint_ids_shortened": (
        lambda s, p: shortened(fixture(s, p, "sensor_events"), "channel", "platform_id", 5).select("channel", F.array_join("items", ",").alias("items"), "total"),
        f"{ctes('sensor_events')}, d AS (SELECT DISTINCT channel, platform_id FROM sensor_events), n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY platform_id) AS k FROM d) SELECT channel, string_agg(CASE WHEN k <= 5 THEN platform_id END, ',' ORDER BY platform_id) AS items, count(*) AS total FROM n GROUP BY channel",
    ),
    "model_catalogue": (lambda s, p: model_catalogue(s), "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{d}', '{c}', '{q}', {str(r).lower()})" for n, d, c, q, r in MODELS) + ") v(name, domain, class, parameters, runs)"),
    "ionospheric_stand_ins": (
        lambda s, p: stand_in_events(s, 35.0, 14.0, 3.0),
        "SELECT *, 'ballistic_candidate' AS classification, 35e0 AS lat, 14e0 AS lon, 3e0 AS kp_index, 'VEVDX1NUVUI=' AS raw_b64 FROM (VALUES " + ", ".join(f"('{d}', {b}e0, {v}e0, {a}e0, {n}, {c}e0)" for d, b, v, a, n, c in IONOSPHERIC) + ") v(data_source, bearing, velocity_ms, amplitude_tecu, stations, confidence)",
    ),
    "top_stats": (
        lambda s, p: top_stats(fixture(s, p, "ais_positions"), fixture(s, p, "vessel_events"), fixture(s, p, A), fixture(s, p, W), F.expr(AS_OF)),
        f"{ctes('ais_positions', 'vessel_events', A, W)} SELECT 'AIS' AS label, count(DISTINCT mmsi) AS value FROM ais_positions WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 30 MINUTE UNION ALL SELECT 'Signals', least(50, count(*)) FROM vessel_events UNION ALL SELECT 'Alerts', count(*) FROM alerts WHERE status <> 'completed' UNION ALL SELECT 'Forensics', count(*) FROM alert_writes",
    ),
}
