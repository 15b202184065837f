"""Vessels and positions: anomalies of tracks, state, serving queries, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo
from tidewatch.operators import ordered
from tidewatch.operators.ranges import near_join
from tidewatch.sources import dims
from tidewatch.sources.fixtures import ctes, fixture
from tidewatch.sources.storage import stored

R = lambda x, n: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"  # noqa: E731  the oracle's rounding
GAP = "date_diff('microsecond', lag(ts) OVER w, ts) / 1e6"


def track():  # noqa: ANN201
    """The rows of a vessel in order of time."""
    return Window.partitionBy("mmsi").orderBy("ts", "event_id")


def seconds(a: Column, b: Column) -> Column:
    """From a to b."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def with_previous(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with prev_<column> of the row before in the track."""
    return rows.withColumns({f"prev_{c}": F.lag(c).over(track()) for c in columns})


def stepped(rows: DataFrame) -> DataFrame:
    rows = with_previous(rows, "lat", "lon", "ts")
    return rows.withColumn("gap_s", seconds(F.col("prev_ts"), F.col("ts"))).withColumn("dist_nm", geo.planar(F.col("lat"), F.col("lon"), F.col("prev_lat"), F.col("prev_lon"), 60.0)).withColumn("knots", F.when(F.col("gap_s") > 0, F.col("dist_nm") / (F.col("gap_s") / 3600)))


def impossible_speed(rows: DataFrame) -> DataFrame:
    most = dims.looked_up(F.col("vessel_type"), dims.MAX_SPEED, dims.ANY_SPEED)
    fast = stepped(rows).withColumn("most", most).filter((F.col("gap_s") > 0) & (F.col("dist_nm") > 0) & (F.col("knots") > F.col("most")) & (F.col("knots") > dims.LEAST_SPEED))
    sure = F.least(F.lit(0.9), 0.5 + (F.col("knots") - F.col("most")) / 100)
    return fast.select("event_id", "mmsi", F.lit("impossible_speed").alias("anomaly_type"), geo.rounded(F.col("dist_nm"), 4).alias("dist_nm"), geo.rounded(F.col("knots"), 4).alias("knots"), geo.rounded(sure, 4).alias("confidence"))


MOST = "CASE vessel_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.MAX_SPEED.items()) + " ELSE 50.0 END"
STEP = f"""s AS (SELECT *, {GAP} AS gap_s, sqrt((lat - lag(lat) OVER w) * (lat - lag(lat) OVER w) + (lon - lag(lon) OVER w) * (lon - lag(lon) OVER w)) * 60e0 AS dist_nm, lag(ts) OVER w AS prev_ts
  FROM ais_positions WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)), k AS (SELECT *, dist_nm / (gap_s / 3600) AS knots, {MOST} AS most FROM s)"""
IMPOSSIBLE = f"""{ctes("ais_positions")}, {STEP} SELECT event_id, mmsi, 'impossible_speed' AS anomaly_type, {R("dist_nm", 4)} AS dist_nm, {R("knots", 4)} AS knots, {R("least(0.9e0, 0.5e0 + (knots - most) / 100)", 4)} AS confidence
FROM k WHERE gap_s > 0 AND dist_nm > 0 AND knots > most AND knots > 55"""


def in_dark_zone(lat: Column, lon: Column, reading: str) -> Column:
    out = F.lit(False)
    for a, b, c, d in dims.DARK_ZONES[reading]:
        out = out | (lat.between(a, b) & lon.between(c, d))
    return out


def dark_sql(reading: str) -> str:
    return "(" + " OR ".join(f"(lat BETWEEN {a} AND {b} AND lon BETWEEN {c} AND {d})" for a, b, c, d in dims.DARK_ZONES[reading]) + ")"


def gaps(rows: DataFrame, reading: str = "as_coded") -> DataFrame:
    late = stepped(rows).filter((F.col("gap_s") > 180) & ~in_dark_zone(F.col("lat"), F.col("lon"), reading))
    return late.select("event_id", "mmsi", "gap_s", geo.rounded(F.least(F.lit(0.85), 0.4 + F.col("gap_s") / 3600), 4).alias("confidence"))


def dark_entries(rows: DataFrame, reading: str = "as_coded") -> DataFrame:
    zoned = rows.withColumn("dark", in_dark_zone(F.col("lat"), F.col("lon"), reading))
    return zoned.withColumn("was", F.lag("dark").over(track())).filter(F.col("dark") & ~F.coalesce("was", F.lit(False))).select("event_id", "mmsi", F.lit(0.65).alias("confidence"))


def sanctioned(rows: DataFrame, listed: DataFrame) -> DataFrame:
    return rows.join(listed.select("mmsi").distinct(), "mmsi", "left_semi").select("event_id", "mmsi", F.lit(0.95).alias("confidence"))


def gnss_anomalies(rows: DataFrame, features: DataFrame, within_km: float = 500.0) -> DataFrame:
    """Jumps, impossible speed and interference zones, each a row."""
    s = stepped(rows)
    jump = (F.col("dist_nm") > 0.1) & (F.col("gap_s") > 0) & (F.col("gap_s") < 1)
    kind = F.when(jump, "position_jump").when(F.col("knots") > 100, "impossible_speed")
    moved = s.withColumn("anomaly_type", kind).filter("anomaly_type IS NOT NULL").select("event_id", "anomaly_type", F.when(F.col("anomaly_type") == "position_jump", 0.85).otherwise(0.80).alias("confidence"))
    points = features.filter(F.col("geom_type") == "Point").select(F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    close = geo.planar(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"), 111.0) < within_km
    zone = near_join(rows, points, ("lat", "f_lat"), ("lon", "f_lon"), within_km / 111.0, close, "left_semi", planar=True).select("event_id", F.lit("spoofing_zone").alias("anomaly_type"), F.lit(0.75).alias("confidence"))
    return moved.unionByName(zone)


GNSS = f"""{ctes("ais_positions", "interference_features")}, {STEP},
m AS (SELECT event_id, CASE WHEN dist_nm > 0.1 AND gap_s > 0 AND gap_s < 1 THEN 'position_jump' WHEN gap_s > 0 AND knots > 100 THEN 'impossible_speed' END AS anomaly_type FROM k)
SELECT event_id, anomaly_type, CASE anomaly_type WHEN 'position_jump' THEN 0.85e0 ELSE 0.80e0 END AS confidence FROM m WHERE anomaly_type IS NOT NULL
UNION ALL SELECT event_id, 'spoofing_zone', 0.75e0 FROM ais_positions p WHERE EXISTS (SELECT 1 FROM interference_features f WHERE geom_type = 'Point' AND sqrt((p.lat - f.lat) * (p.lat - f.lat) + (p.lon - f.lon) * (p.lon - f.lon)) * 111e0 < 500)"""


def throttled(rows: DataFrame, gap_s: float = 60.0, key: str = "mmsi", at: str = "ts") -> DataFrame:
    """key and event_id of the rows that are kept: the first, then each that comes gap_s or more after the last one kept. Rows without a time are left out.

    A fold by blocks (ordered.folded), so that no vessel is one task however long and dense its track is. at is a
    time or whole seconds; a row's limit is the last row that is gap_s or more before it.
    """
    t = F.col(at) * 1_000_000 if dict(rows.dtypes)[at] in ("int", "bigint") else micros(F.col(at), dict(rows.dtypes)[at])
    timed = ordered.ranked(rows.filter(F.col(at).isNotNull()).select(key, "event_id", t.alias("_us")), key, "_us", "event_id")
    kept = ordered.folded(ordered.apart(timed, key, "_us", round(gap_s * 1e6)), key).select(F.col(key).alias("_key"), F.col("rank").alias("_rank"))
    return timed.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank"))).select(key, "event_id")


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), ts)


THROTTLE = f"""{ctes("ais_positions").replace("WITH ", "WITH RECURSIVE ", 1)}, k AS (SELECT mmsi, min(ts) AS ts FROM ais_positions GROUP BY mmsi
  UNION ALL SELECT k.mmsi, (SELECT min(p.ts) FROM ais_positions p WHERE p.mmsi = k.mmsi AND p.ts >= k.ts + INTERVAL 7200 SECOND) FROM k WHERE k.ts IS NOT NULL)
SELECT p.mmsi, p.event_id FROM ais_positions p JOIN k USING (mmsi, ts)"""


THROTTLE_60 = f"""{ctes("ais_reports").replace("WITH ", "WITH RECURSIVE ", 1)}, k AS (SELECT mmsi, min(t_s) AS t_s FROM ais_reports GROUP BY mmsi
  UNION ALL SELECT k.mmsi, (SELECT min(p.t_s) FROM ais_reports p WHERE p.mmsi = k.mmsi AND p.t_s >= k.t_s + 60) FROM k WHERE k.t_s IS NOT NULL)
SELECT p.mmsi, min(p.event_id) AS event_id FROM ais_reports p JOIN k USING (mmsi, t_s) GROUP BY p.mmsi, t_s"""


def tracks(rows: DataFrame, gap_s: float = 180.0) -> DataFrame:
    """Sessions of a vessel: a gap of gap_s or more starts another."""
    new = F.coalesce(seconds(F.lag("ts").over(track()), F.col("ts")) >= gap_s, F.lit(True))
    numbered = rows.withColumn("new", new.cast("int")).withColumn("track", F.sum("new").over(track()))
    return numbered.groupBy("mmsi", "track").agg(F.count(F.lit(1)).alias("positions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merged_payload(log: DataFrame, key: str, payload: str, order: str = "seq") -> DataFrame:
    """key and payload, the last value of every field that the key's payloads ever had, as JSON by name.

    A field is one aggregation over all its values; only the few fields of a key are brought together. A null value
    overwrites like any other; an empty or null payload changes nothing.
    """
    fields = log.select(key, order, F.explode(payload).alias("field", "value"))
    last = fields.groupBy(key, "field").agg(F.max_by(F.struct("value"), order).alias("last"))
    named = F.array_sort(F.collect_list(F.struct("field", "last.value")))
    return last.groupBy(key).agg(F.to_json(F.map_from_entries(named), {"ignoreNullFields": "false"}).alias("payload"))


def vessel_state(log: DataFrame) -> DataFrame:
    """State by vessel from a log in order of seq: counts, the last position with its course, speed and heading, and the payloads merged field by field. Lists are distinct in order of first sight.

    A vessel is its id, else its device, else the own ship. The name is the last one that is not empty.
    """
    log = log.withColumn("vessel", F.coalesce(F.nullif("vessel_id", F.lit("")), F.nullif("device_id", F.lit("")), F.lit("ownship")))

    def seen(column: str) -> DataFrame:
        firsts = log.filter(F.col(column) != "").groupBy("vessel", column).agg(F.min("seq").alias("at"))
        return firsts.groupBy("vessel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column]), ",").alias(column))

    fix = F.when((F.col("event_kind") == "position_fix") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("seq"))
    name = F.nullif(F.col("payload")["ship_name"], F.lit(""))
    at = F.max_by(F.struct("lat", "lon", "course", "speed", "heading"), fix).alias("at")
    state = log.groupBy("vessel").agg(F.count(F.lit(1)).alias("events"), F.max_by("ts", "seq").alias("last_seen"), F.max_by(name, F.when(name.isNotNull(), F.col("seq"))).alias("name"), at)
    state = state.select("vessel", "events", "last_seen", "name", "at.*")
    for more in (seen("adapter").withColumnRenamed("adapter", "sources"), seen("status").withColumnRenamed("status", "statuses"), merged_payload(log, "vessel", "payload")):
        state = state.join(more, "vessel", "left")
    return state.withColumn("payload", F.coalesce("payload", F.lit("{}")))


PAYLOAD = ("class", "destination", "ship_name")


def vessel_log(spark, d: str) -> DataFrame:
    """The log with its payload, a map of the fields that an event has."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in PAYLOAD]), lambda x: x["value"].isNotNull())
    return fixture(spark, d, "vessel_events").withColumn("payload", F.map_from_entries(pairs))


STATE = f"""{ctes("vessel_events")}, l AS (SELECT *, coalesce(vessel_id, device_id, 'ownship') AS vessel FROM vessel_events),
a AS (SELECT vessel, string_agg(adapter, ',' ORDER BY place) AS sources FROM (SELECT vessel, adapter, min(seq) AS place FROM l GROUP BY ALL) GROUP BY vessel),
s AS (SELECT vessel, string_agg(status, ',' ORDER BY place) AS statuses FROM (SELECT vessel, status, min(seq) AS place FROM l GROUP BY ALL) GROUP BY vessel),
p AS (SELECT vessel, '{{' || string_agg('"' || field || '":' || CAST(to_json(value) AS VARCHAR), ',' ORDER BY field) || '}}' AS payload FROM (SELECT vessel, field, arg_max(value, seq) AS value FROM (UNPIVOT (SELECT vessel, seq, {", ".join(PAYLOAD)} FROM l) ON {", ".join(PAYLOAD)} INTO NAME field VALUE value) GROUP BY ALL) GROUP BY vessel),
f AS (SELECT * FROM l WHERE event_kind = 'position_fix' AND lat IS NOT NULL),
n AS (SELECT vessel, lat, lon, course, speed, heading FROM f QUALIFY row_number() OVER (PARTITION BY vessel ORDER BY seq DESC) = 1),
g AS (SELECT vessel, count(*) AS events, arg_max(ts, seq) AS last_seen, arg_max(ship_name, seq) FILTER (WHERE ship_name <> '') AS name FROM l GROUP BY vessel)
SELECT g.*, lat, lon, course, speed, heading, sources, statuses, coalesce(payload, '{{}}') AS payload FROM g LEFT JOIN n USING (vessel) LEFT JOIN a USING (vessel) LEFT JOIN s USING (vessel) LEFT JOIN p USING (vessel)"""


def latest(rows: DataFrame) -> DataFrame:
    """The last position of each vessel."""
    at = F.struct("ts", "event_id")
    return rows.groupBy("mmsi").agg(*[F.max_by(c, at).alias(c) for c in ("lat", "lon", "speed", "course", "heading")], F.max("ts").alias("last_seen"))


def upserted(old: DataFrame, new: DataFrame, key: str = "mmsi") -> DataFrame:
    """A row per key of either: new values where there are any, else the old ones."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    pick = lambda c: F.coalesce(*([F.col(f"_n_{c}")] if c in new.columns else []), *([F.col(c)] if c in old.columns else [])).alias(c)
    return old.join(n, F.col(key) == F.col(f"_n_{key}"), "full_outer").select(*map(pick, names))


def vessel_table(spark, d: str) -> DataFrame:
    return upserted(latest(fixture(spark, d, "ais_positions")), fixture(spark, d, "vessel_static"))


LATEST = "v AS (SELECT mmsi, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon, arg_max(speed, ts) AS speed, arg_max(course, ts) AS course, arg_max(struct_pack(h := heading), ts).h AS heading, max(ts) AS last_seen FROM ais_positions GROUP BY mmsi)"  # ts differ


def vessel_stats(vessels: DataFrame, minutes: int = 30) -> DataFrame:
    newest = vessels.agg(F.max("last_seen").alias("as_of"))
    return vessels.crossJoin(F.broadcast(newest)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lat").isNotNull()).alias("positioned"), F.count_if(F.col("last_seen") >= F.col("as_of") - F.make_dt_interval(mins=F.lit(minutes))).alias("active"))


def nearest(vessels: DataFrame, lat: float, lon: float, k: int = 5) -> DataFrame:
    """The k nearest vessels to a point with their rank; k from 1 to 20."""
    km = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    near = vessels.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("km", km).orderBy("km", "mmsi").limit(max(1, min(20, k)))
    return near.select(F.row_number().over(Window.orderBy("km", "mmsi")).alias("rank"), "mmsi", geo.rounded(F.col("km"), 3).alias("km"))


#: Widths of cells in degrees, each a quarter of the one before; the first is wider than the world.
CELLS = tuple(720.0 / 4**level for level in range(13))


def cells(lat: Column, lon: Column) -> Column:
    """(level, x, y) of the cell that a point is in, for every width."""
    at = lambda v, w: F.floor(v / F.lit(w)).cast("long")
    return F.array(*[F.struct(F.lit(i).alias("level"), at(lat, w).alias("x"), at(lon, w).alias("y")) for i, w in enumerate(CELLS)])


def around(rows: DataFrame, cell: str) -> DataFrame:
    """rows for the cell in a column and for the eight around it."""
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = F.col(cell)
    return rows.withColumn("_o", F.explode(steps)).withColumn(cell, F.struct(c["level"].alias("level"), (c["x"] + F.col("_o.i")).alias("x"), (c["y"] + F.col("_o.j")).alias("y"))).drop("_o")


def nearest_each(points: DataFrame, vessels: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest vessels of every point by planar degrees, exactly; ties by mmsi.

    Vessels are counted by cells of all widths in one pass. A point takes the narrowest width at which its cell and the
    eight around it hold k vessels: these lie within 2.83 widths, so the cells four times as wide are sure to have the
    nearest, and one join by equal cells and one ranking, of what lies within 2.83 widths, verify them. Of vessels at one place the first k are enough.
    """
    place = Window.partitionBy("v_lat", "v_lon").orderBy("mmsi")
    v = vessels.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("mmsi", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    v = stored(v.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k).select("mmsi", "v_lat", "v_lon", F.explode(cells(F.col("v_lat"), F.col("v_lon"))).alias("cell")))
    held = around(v.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= k)
    p = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("event_id", "lat", "lon").withColumn("_row", F.struct("event_id", "lat", "lon"))
    fine = p.select("_row", F.explode(cells(F.col("lat"), F.col("lon"))).alias("cell")).join(held.hint("merge"), "cell").groupBy("_row").agg(F.max("cell.level").alias("level"))
    level = F.greatest(F.coalesce("level", F.lit(0)) - 1, F.lit(0))  # with fewer than k vessels in all, everywhere
    asks = p.join(fine.hint("merge"), "_row", "left").select("event_id", "lat", "lon", F.get(cells(F.col("lat"), F.col("lon")), level).alias("cell"), (F.pow(F.lit(0.25), "level") * CELLS[0] * 2.83).alias("bound"))
    met = around(asks, "cell").join(v.hint("merge"), "cell").withColumn("deg", geo.planar(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon"), 1.0)).filter(F.col("bound").isNull() | (F.col("deg") <= F.col("bound")))
    rank = F.row_number().over(Window.partitionBy("event_id", "lat", "lon").orderBy("deg", "mmsi"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("event_id", "rank", "mmsi", geo.rounded(F.col("deg"), 6).alias("deg"))


NEAREST_EACH = f"""{ctes("ais_positions", "alerts")}, {LATEST}, d AS (SELECT a.event_id, v.mmsi, sqrt((a.lat - v.lat) * (a.lat - v.lat) + (a.lon - v.lon) * (a.lon - v.lon)) AS deg FROM alerts a, v),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY deg, mmsi) AS rank FROM d) SELECT event_id, CAST(rank AS INT) AS rank, mmsi, {R("deg", 6)} AS deg FROM r WHERE rank <= 3"""


def chokepoint_counts(vessels: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones with how many vessels are inside and the ten smallest ids; zones without any stay. There are a handful of zones, so they are broadcast and vessels do not move."""
    hits = vessels.join(F.broadcast(zones), geo.inside(F.col("lat"), F.col("lon"))).select("id", "mmsi")
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("mmsi"))).filter("n <= 10")
    ten = ranked.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("mmsi")), ",").alias("vessels"))
    return zones.join(hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").join(ten, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("vessels", F.lit("")).alias("vessels"))


CHOKE = f"""{ctes("ais_positions")}, {LATEST}, z AS (SELECT * FROM {dims.values(dims.CHOKEPOINTS, "id, name, min_lat, max_lat, min_lon, max_lon")}),
h AS (SELECT id, mmsi, row_number() OVER (PARTITION BY id ORDER BY mmsi) AS r FROM v, z WHERE lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon)
SELECT z.id, z.name, count(h.mmsi) AS n, coalesce(string_agg(h.mmsi, ',' ORDER BY h.mmsi) FILTER (WHERE r <= 10), '') AS vessels FROM z LEFT JOIN h ON z.id = h.id GROUP BY ALL"""


def ship_label(code: Column) -> Column:
    out = F.lit("UNKNOWN")
    for lo, hi, label in reversed(dims.SHIP_TYPES):
        out = F.when(code.between(lo, hi), label).otherwise(out)
    return out


def position_a(rows: DataFrame) -> DataFrame:
    """Normalised positions: 0 and null latitudes fall back to the other source, heading 511 is none, rows without position or id go."""
    fix = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(f"meta_{c}"))
    out = rows.withColumn("lat", fix("lat")).withColumn("lon", fix("lon")).withColumn("heading", F.nullif(F.col("heading"), F.lit(511.0)))
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.coalesce("mmsi", F.lit("")) != ""))


def position_b(rows: DataFrame) -> DataFrame:
    """Course and heading under 360 and speed under 102.3, else null."""
    less = lambda c, m: F.when(F.col(c) < m, F.col(c))
    return rows.withColumn("course", less("course", 360)).withColumn("speed", less("speed", 102.3)).withColumn("heading", less("heading", 360))


def geojson(rows: DataFrame, lat: str = "lat", lon: str = "lon", properties: tuple[str, ...] = ("mmsi",)) -> DataFrame:
    """A GeoJSON feature for each row with a position."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*properties, F.to_json(feature).alias("feature"))


def ais(d):  # noqa: ANN001, ANN201
    return lambda f: lambda s, p: f(fixture(s, p, d))


P, V = "ais_positions", "vessel_events"
QUERIES = {
    "ais_impossible_speed": (ais(P)(impossible_speed), IMPOSSIBLE),
    "ais_gaps": (ais(P)(gaps), f"{ctes(P)}, {STEP} SELECT event_id, mmsi, gap_s, {R('least(0.85e0, 0.4e0 + gap_s / 3600)', 4)} AS confidence FROM k WHERE gap_s > 180 AND NOT {dark_sql('as_coded')}"),
    "ais_gaps_swapped_zones": (ais(P)(lambda r: gaps(r, "swapped")), f"{ctes(P)}, {STEP} SELECT event_id, mmsi, gap_s, {R('least(0.85e0, 0.4e0 + gap_s / 3600)', 4)} AS confidence FROM k WHERE gap_s > 180 AND NOT {dark_sql('swapped')}"),
    "ais_dark_entry": (ais(P)(lambda r: dark_entries(r, "swapped")), f"{ctes(P)}, z AS (SELECT *, {dark_sql('swapped')} AS dark FROM ais_positions), w AS (SELECT *, lag(dark) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS was FROM z) SELECT event_id, mmsi, 0.65e0 AS confidence FROM w WHERE dark AND NOT coalesce(was, false)"),
    "ais_sanctions": (lambda s, p: sanctioned(fixture(s, p, P), fixture(s, p, "sanctioned_mmsi")), f"{ctes(P, 'sanctioned_mmsi')} SELECT event_id, mmsi, 0.95e0 AS confidence FROM ais_positions WHERE mmsi IN (SELECT mmsi FROM sanctioned_mmsi)"),
    "gnss_anomalies": (lambda s, p: gnss_anomalies(fixture(s, p, P), fixture(s, p, "interference_features")), GNSS),
    "ais_throttled": (ais(P)(lambda r: throttled(r, 7200.0)), THROTTLE),
    "ais_throttled_60s": (ais("ais_reports")(lambda r: throttled(r, 60.0, at="t_s")), THROTTLE_60),
    "ais_tracks": (ais(P)(lambda r: tracks(r, 3600.0)), f"{ctes(P)}, n AS (SELECT *, CASE WHEN coalesce({GAP} >= 3600, true) THEN 1 ELSE 0 END AS new FROM ais_positions WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)), t AS (SELECT *, CAST(sum(new) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS BIGINT) AS track FROM n) SELECT mmsi, track, count(*) AS positions, min(ts) AS first_seen, max(ts) AS last_seen FROM t GROUP BY ALL"),
    "vessel_state": (lambda s, p: vessel_state(vessel_log(s, p)), STATE),
    "vessel_summary": (lambda s, p: vessel_state(vessel_log(s, p)).agg(F.count(F.lit(1)).alias("vessels"), F.count_if(F.col("lat").isNotNull()).alias("positioned"), F.sum(F.when(F.col("statuses").contains("raw_ais_received"), 1).otherwise(0)).alias("raw_ais")), f"SELECT count(*) AS vessels, count(lat) AS positioned, CAST(count(*) FILTER (WHERE statuses LIKE '%raw_ais_received%') AS BIGINT) AS raw_ais FROM ({STATE})"),
    "vessel_upsert": (vessel_table, f"{ctes(P, 'vessel_static')}, {LATEST} SELECT coalesce(s.mmsi, v.mmsi) AS mmsi, lat, lon, speed, course, heading, last_seen, ship_name, imo, ship_type, ais_class FROM v FULL JOIN vessel_static s ON v.mmsi = s.mmsi"),
    "vessel_stats": (lambda s, p: vessel_stats(vessel_table(s, p)), f"{ctes(P, 'vessel_static')}, {LATEST}, t AS (SELECT lat, last_seen FROM v FULL JOIN vessel_static s ON v.mmsi = s.mmsi) SELECT count(*) AS total, count(lat) AS positioned, count(*) FILTER (WHERE last_seen >= (SELECT max(last_seen) FROM t) - INTERVAL 30 MINUTE) AS active FROM t"),
    "vessels_since": (lambda s, p: latest(fixture(s, p, P)).filter(F.col("last_seen") >= F.expr("timestamp_ntz'2024-01-29 00:00:00'")).select("mmsi", "last_seen").orderBy(F.desc("last_seen")), f"{ctes(P)}, {LATEST} SELECT mmsi, last_seen FROM v WHERE last_seen >= TIMESTAMP '2024-01-29 00:00:00'"),
    "vessels_nearest": (lambda s, p: nearest(latest(fixture(s, p, P)), 35.5, 12.6), f"{ctes(P)}, {LATEST}, d AS (SELECT mmsi, 2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT mmsi, sin(radians(lat - 35.5e0) / 2) ** 2 + cos(radians(35.5e0)) * cos(radians(lat)) * sin(radians(lon - 12.6e0) / 2) ** 2 AS a FROM v)) SELECT CAST(row_number() OVER (ORDER BY km, mmsi) AS INT) AS rank, mmsi, {R('km', 3)} AS km FROM d ORDER BY km, mmsi LIMIT 5"),
    "vessels_nearest_each": (lambda s, p: nearest_each(fixture(s, p, "alerts"), latest(fixture(s, p, P))), NEAREST_EACH),
    "chokepoint_counts": (lambda s, p: chokepoint_counts(latest(fixture(s, p, P)), dims.chokepoints(s)), CHOKE),
    "ship_labels": (lambda s, p: fixture(s, p, "vessel_static").select("mmsi", ship_label(F.col("ship_type")).alias("label")), f"{ctes('vessel_static')} SELECT mmsi, CASE " + " ".join(f"WHEN ship_type BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in dims.SHIP_TYPES) + " ELSE 'UNKNOWN' END AS label FROM vessel_static"),
    "vessel_features": (lambda s, p: geojson(latest(fixture(s, p, P)).filter("lat IS NOT NULL").select("mmsi", "lat", "lon")), f"""{ctes(P)}, {LATEST} SELECT mmsi, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"mmsi":"' || mmsi || '"}}}}' AS feature FROM v"""),
    "positions_normalised": (lambda s, p: position_b(position_a(fixture(s, p, P).withColumn("meta_lat", F.col("lat") + 1).withColumn("meta_lon", F.col("lon") + 1).withColumn("lat", F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("lat"))))).select("event_id", "lat", "lon", "course", "speed", "heading"), f"{ctes(P)} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN lat + 1 ELSE lat END AS lat, lon, CASE WHEN course < 360 THEN course END AS course, CASE WHEN speed < 102.3 THEN speed END AS speed, CASE WHEN heading < 360 AND heading <> 511 THEN heading END AS heading FROM ais_positions"),
}
