"""Survival, interception, priority, drift, ensembles, alerts and forensic records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, sea
from tidewatch.operators.sensing import survival_sql
from tidewatch.operators.tracks import STEP, R, impossible_speed
from tidewatch.sources import dims
from tidewatch.sources.fixtures import ctes, fixture

WATER, WIND, WAVE = 18.0, 5.0, 1.0  # the environment where none is given
DRIFT_KN, DRIFT_DEG, WINDOW = 1.5, 0.0, 1.5
CONES = ((6, 10.0), (12, 18.0), (24, 28.0))  # hours, half angle


def column(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def with_survival(alerts: DataFrame, water: float | Column = WATER, wind: float | Column = WIND, wave: float | Column = WAVE) -> DataFrame:
    p = sea.survival_probability(F.col("hours_elapsed"), column(water), column(wind), column(wave), F.col("vessel_condition"), F.coalesce("medical_emergency", F.lit(False)), F.coalesce("children_aboard", F.lit(False)))
    return alerts.withColumn("p", p)


def survival(alerts: DataFrame, **env: float) -> DataFrame:
    return with_survival(alerts, **env).select("event_id", geo.rounded(F.col("p"), 4).alias("survival_prob"), sea.urgency(F.col("p")).alias("urgency"))


def effective_sql(water: str, wind: str, wave: str) -> str:
    """Effective survival hours."""
    condition = "CASE vessel_condition " + " ".join(f"WHEN '{c}' THEN {x}e0" for c, x in sea.CONDITIONS) + " ELSE 1e0 END"
    return f"{survival_sql(water)} * greatest(0.5e0, 1 - 0.05e0 * {wave}) / greatest(0.1e0, 1 + 0.25e0 * (37 - {water}) * (1 + 0.03e0 * {wind}) / 10) * {condition} * CASE WHEN medical_emergency THEN 0.7e0 ELSE 1e0 END * CASE WHEN children_aboard THEN 0.8e0 ELSE 1e0 END"


GIVEN = (f"{WATER}e0", f"{WIND}e0", f"{WAVE}e0")


def survival_rows(rows: str = "alerts", env: tuple[str, str, str] = GIVEN) -> str:
    return f"sv AS (SELECT *, greatest(0e0, least(1e0, exp(-hours_elapsed / ({effective_sql(*env)})))) AS p FROM {rows})"


SURVIVAL = survival_rows()
URGENCY = "CASE WHEN p >= 0.8 THEN 'ROUTINE' WHEN p >= 0.5 THEN 'ELEVATED' WHEN p >= 0.2 THEN 'URGENT' ELSE 'IMMEDIATE' END"


def interceptions(alerts: DataFrame, assets: DataFrame, drift_kn: float = DRIFT_KN, drift_deg: float = DRIFT_DEG, water: float | Column = WATER) -> DataFrame:
    """Each alert with each asset: the time at which the asset meets what drifts, as a fixed point of at most 50 steps. Assets are a handful and broadcast."""
    both = alerts.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("event_id", "lat", "lon", column(water).alias("_water")).crossJoin(F.broadcast(assets))
    lat, lon = F.col("lat"), F.col("lon")

    def met(t: Column) -> tuple[Column, Column, Column]:
        a, b = geo.ahead_nm(lat, lon, F.lit(drift_deg), drift_kn * t)
        return a, b, geo.haversine_nm(F.col("a_lat"), F.col("a_lon"), a, b)

    def step(s: Column, _: Column) -> Column:
        new = met(s["t"])[2] / F.greatest(F.lit(0.1), F.col("speed_kn"))
        return F.when(s["done"], s).otherwise(F.struct(new.alias("t"), (F.abs(new - s["t"]) < 1e-4).alias("done")))

    start = F.struct(F.lit(0.0).alias("t"), F.lit(False).alias("done"))
    t = both.withColumn("t", F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, step)["t"])
    a, b, d = met(F.col("t"))
    t = t.withColumn("i_lat", a).withColumn("i_lon", b).withColumn("d", d)
    feasible = (F.col("t") <= F.col("endurance_h")) & (F.col("t") <= WINDOW * sea.survival_hours(F.col("_water")))
    return t.select(
        "event_id", "asset_id", geo.rounded(F.col("d"), 2).alias("distance_nm"), geo.rounded(F.col("t"), 3).alias("hours"), geo.rounded(F.col("i_lat"), 5).alias("intercept_lat"), geo.rounded(F.col("i_lon"), 5).alias("intercept_lon"),
        geo.rounded(geo.bearing(F.col("a_lat"), F.col("a_lon"), F.col("i_lat"), F.col("i_lon")), 1).alias("heading"), feasible.alias("feasible"), F.col("t").alias("exact_h"),
    )


HAV = "2 * 3440.065e0 * asin(sqrt(sin((radians({c}) - radians({a})) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2))"
DLAT = f"(lat + {DRIFT_KN}e0 * t * cos(radians({DRIFT_DEG}e0)) / 60)"
DLON = f"(lon + {DRIFT_KN}e0 * t * sin(radians({DRIFT_DEG}e0)) / (60 * cos(radians(lat)) + 1e-9))"
HAV_T = HAV.format(a="a_lat", b="a_lon", c=DLAT, d=DLON)
def intercept_rows(rows: str = "alerts", water: str = GIVEN[0]) -> str:
    return f"""x AS (SELECT event_id, lat, lon, v.* FROM {rows}, {dims.values(dims.ASSETS, "asset_id, a_lat, a_lon, speed_kn, endurance_h, asset_type")}),
i AS (SELECT *, 0e0 AS t, false AS done, 0 AS k FROM x UNION ALL SELECT * EXCLUDE (t, done, k, n), n, abs(n - t) < 1e-4, k + 1 FROM (SELECT *, {HAV_T} / greatest(0.1e0, speed_kn) AS n FROM i WHERE NOT done AND k < 50)),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY event_id, asset_id ORDER BY k DESC) = 1),
r AS (SELECT event_id, asset_id, {HAV_T} AS d, t, {DLAT} AS i_lat, {DLON} AS i_lon, a_lat, a_lon, t <= endurance_h AND t <= {WINDOW} * {survival_sql(water)} AS feasible FROM l)"""


INTERCEPT = f"{ctes('alerts').replace('WITH ', 'WITH RECURSIVE ', 1)}, {intercept_rows()}"
BEARING = "fmod(degrees(atan2(sin(radians(i_lon - a_lon)) * cos(radians(i_lat)), cos(radians(a_lat)) * sin(radians(i_lat)) - sin(radians(a_lat)) * cos(radians(i_lat)) * cos(radians(i_lon - a_lon)))) + 360, 360e0)"


def scored(active: DataFrame, assets: DataFrame, water: float | Column = WATER, wind: float | Column = WIND, wave: float | Column = WAVE, *keep: str) -> DataFrame:
    """Signals by priority: confidence, danger, and a bonus where an asset can be there in half the survival window. The environment is given by numbers or by columns of the signals."""
    active = with_survival(active, water, wind, wave).withColumn("_water", column(water))
    near = interceptions(active, assets, water=F.col("_water")).filter("feasible").groupBy("event_id").agg(F.min("exact_h").alias("h"))
    bonus = F.when(F.col("h") <= WINDOW * sea.survival_hours(F.col("_water")) * 0.5, 0.10).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * F.col("extraction_confidence") + 0.50 * (1 - F.col("p")) + 0.15 * bonus))
    out = active.join(near, "event_id", "left").select("event_id", *keep, geo.rounded(F.col("p"), 4).alias("survival_prob"), sea.urgency(F.col("p")).alias("urgency"), geo.rounded(score, 4).alias("priority"), geo.rounded(F.col("h"), 2).alias("nearest_h"))
    return out.orderBy(F.desc("priority"), "event_id")


def priorities(alerts: DataFrame, assets: DataFrame) -> DataFrame:
    """Alerts that are not completed, by priority."""
    return scored(alerts.filter(F.col("status") != "completed"), assets)


def scored_sql(rows: str = "alerts", env: tuple[str, str, str] = GIVEN, keep: str = "", where: str = "true") -> str:
    return f"""{survival_rows(rows, env)}, n AS (SELECT event_id, min(t) AS h FROM r WHERE feasible GROUP BY event_id)
SELECT event_id, {keep} {R("p", 4)} AS survival_prob, {URGENCY} AS urgency, {R(f"greatest(0e0, least(1e0, 0.35e0 * extraction_confidence + 0.5e0 * (1 - p) + 0.15e0 * CASE WHEN h <= {WINDOW} * {survival_sql(env[0])} * 0.5e0 THEN 0.1e0 ELSE 0e0 END))", 4)} AS priority, {R("h", 2)} AS nearest_h FROM sv LEFT JOIN n USING (event_id) WHERE {where}"""


PRIORITY = f"{INTERCEPT}, {scored_sql(where=chr(39).join(('status <> ', 'completed', '')))}"


def drift_speed(wind: Column) -> Column:
    """km/h; a wind above 30 is taken for km/h, then 1 to 25 m/s hold."""
    ms = F.greatest(F.lit(1.0), F.least(F.when(wind <= 30, wind).otherwise(wind / 3.6), F.lit(25.0)))
    return (ms * 0.035 + 0.15) * 3.6


def drift_path(alerts: DataFrame, wind: float = 6.0, wind_from: float = 225.0, hours: int = 24, reverse: bool = False) -> DataFrame:
    """Positions step by step, from 0, with a small meander; a row per vertex."""
    n = max(8, hours)
    course = geo.modulo(F.lit(wind_from) + 195 + (180 if reverse else 0), 360.0)
    seed = F.pmod((F.col("lat") * 1000 + F.col("lon") * 100).cast("long"), F.lit(999))
    steps = alerts.select("event_id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step"))
    lat, lon = geo.ahead_km(F.col("lat"), F.col("lon"), course + F.sin(F.col("step") * 0.9 + seed) * 0.3, drift_speed(F.lit(wind)) * (F.lit(float(hours)) * F.col("step") / n))
    return steps.select("event_id", "step", geo.rounded(lat, 6).alias("lat"), geo.rounded(lon, 6).alias("lon"))


def drift_cones(alerts: DataFrame, wind: float = 6.0, wind_from: float = 225.0, arc: int = 20) -> DataFrame:
    """The fan of each horizon as a closed ring, a row per vertex: the apex, arc + 1 points, the apex."""
    fans = F.array(*[F.struct(F.lit(h).alias("hours"), F.lit(a).alias("half")) for h, a in CONES])
    v = alerts.select("event_id", "lat", "lon", F.inline(fans)).withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(arc + 2))))
    course = geo.modulo(F.lit(wind_from) + 195, 360.0) - F.col("half") + 2 * F.col("half") * (F.col("vertex") - 1) / arc
    lat, lon = geo.ahead_km(F.col("lat"), F.col("lon"), course, drift_speed(F.lit(wind)) * F.col("hours"))
    apex = (F.col("vertex") == 0) | (F.col("vertex") == arc + 2)
    return v.select("event_id", "hours", "vertex", geo.rounded(F.when(apex, F.col("lat")).otherwise(lat), 6).alias("lat"), geo.rounded(F.when(apex, F.col("lon")).otherwise(lon), 6).alias("lon"))


KMH, AWAY = "((6e0 * 0.035e0 + 0.15e0) * 3.6e0)", "60e0"
PATH = f"""{ctes("alerts")}, s AS (SELECT event_id, lat, lon, step, radians({AWAY} + sin(step * 0.9e0 + CAST(trunc(lat * 1000 + lon * 100) AS BIGINT) % 999) * 0.3e0) AS a, {KMH} * (24e0 * step / 24) AS d FROM alerts, range(25) r(step))
SELECT event_id, CAST(step AS INT) AS step, {R("lat + d * cos(a) / 111.32e0", 6)} AS lat, {R("lon + d * sin(a) / (111.32e0 * cos(radians(lat)) + 1e-9)", 6)} AS lon FROM s"""
CONE = f"""{ctes("alerts")}, s AS (SELECT event_id, lat, lon, hours, vertex, radians({AWAY} - half + 2 * half * (vertex - 1) / 20) AS a, {KMH} * hours AS d FROM alerts, (VALUES (6, 10e0), (12, 18e0), (24, 28e0)) h(hours, half), range(23) r(vertex))
SELECT event_id, hours, CAST(vertex AS INT) AS vertex, {R("CASE WHEN vertex IN (0, 22) THEN lat ELSE lat + d * cos(a) / 111.32e0 END", 6)} AS lat, {R("CASE WHEN vertex IN (0, 22) THEN lon ELSE lon + d * sin(a) / (111.32e0 * cos(radians(lat)) + 1e-9) END", 6)} AS lon FROM s"""


def mean_path(particles: DataFrame) -> DataFrame:
    """The mean position of a run at each step, of particles that have one."""
    p = particles.filter(~F.isnan("lon") & ~F.isnan("lat") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return p.groupBy("run_id", "step").agg(geo.rounded(F.avg("lon"), 6).alias("lon"), geo.rounded(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("n"))


def nearest_step(steps: DataFrame, horizons: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """The output step (run_id, step, at_h) nearest to each horizon; the earlier one on ties."""
    h = steps.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return h.groupBy("run_id", "horizon").agg(F.min(F.struct(F.abs(F.col("at_h") - F.col("horizon")), "step")).alias("m")).select("run_id", "horizon", "m.step")


def cross(a: Column, b: Column, q: Column) -> Column:
    """Above 0 if q lies to the left of the way from a to b."""
    return (b["lon"] - a["lon"]) * (q["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (q["lon"] - a["lon"])


def chain(points: Column) -> Column:
    """The lower half of the hull of points in order of longitude and latitude, or the upper half if they come in reverse."""

    def add(held: Column, q: Column) -> Column:
        turns = F.filter(F.sequence(F.lit(2), F.size(held)), lambda i: cross(F.element_at(held, i - 1), F.element_at(held, i), q) > 0)
        return F.when(F.size(held) < 2, F.concat(held, F.array(q))).otherwise(F.concat(F.slice(held, F.lit(1), F.coalesce(F.array_max(turns), F.lit(1))), F.array(q)))

    return F.aggregate(points, F.array().cast("array<struct<lon:double,lat:double>>"), add)


def hull(points: Column) -> Column:
    """The convex hull of distinct points in order, counterclockwise from the first, without points on its edges."""
    low, high = chain(points), chain(F.reverse(points))
    return F.when(F.size(points) <= 2, points).otherwise(F.concat(F.slice(low, F.lit(1), F.size(low) - 1), F.slice(high, F.lit(1), F.size(high) - 1)))


#: The eight directions in which a cloud's farthest points are taken, counterclockwise: parts of longitude and latitude.
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def hulls(particles: DataFrame, salts: int = 16) -> DataFrame:
    """The closed hull of each run and step, a row per vertex; a single point becomes a small square.

    Of equal points one is looked at. Points inside the polygon of the farthest ones in eight directions go first. What is left is dealt to salts parts;
    their hulls are folded apart and then once more together, so that a large cloud is never in one task whole. Points
    without a position are left out.
    """
    p = particles.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    p = p.select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("int").alias("step"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).distinct()
    p = p.select("run_id", "step", F.struct("lon", "lat").alias("q"))
    far = [F.max_by("q", F.struct(x * F.col("q.lon") + y * F.col("q.lat"), "q")) for x, y in DIRECTIONS]
    shares = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    frame = p.groupBy("run_id", "step").agg(F.array(*far).alias("frame")).withColumn("salt", F.explode(shares))
    at = lambda i: F.get("frame", F.lit(i % len(DIRECTIONS)))
    inside = ~F.array_contains("frame", F.col("q"))
    for i in range(len(DIRECTIONS)):
        inside = inside & ((at(i) == at(i + 1)) | (cross(at(i), at(i + 1), F.col("q")) > 1e-12))  # by more than rounding
    outer = p.withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(salts))).join(frame, ["run_id", "step", "salt"]).filter(~inside)
    part = outer.groupBy("run_id", "step", "salt").agg(hull(F.sort_array(F.collect_set("q"))).alias("h"))
    whole = part.groupBy("run_id", "step").agg(hull(F.sort_array(F.array_distinct(F.flatten(F.collect_list("h"))))).alias("h"))
    corner = lambda x, y: F.struct((F.get("h", F.lit(0))["lon"] + 0.01 * x).alias("lon"), (F.get("h", F.lit(0))["lat"] + 0.01 * y).alias("lat"))
    ring = F.when(F.size("h") == 1, F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).otherwise(F.col("h"))
    closed = whole.withColumn("h", ring).withColumn("h", F.concat("h", F.slice("h", 1, 1)))
    return closed.select("run_id", "step", F.posexplode("h").alias("vertex", "q")).select("run_id", "step", "vertex", "q.lon", "q.lat")


TURN = "(s[i].lon - s[i - 1].lon) * (q[1].lat - s[i - 1].lat) - (s[i].lat - s[i - 1].lat) * (q[1].lon - s[i - 1].lon) > 0"
CHAIN = f"list_reduce(list_transform({{}}, lambda x: [x]), lambda s, q: list_concat(s[1:coalesce(list_max(list_filter(range(2, len(s) + 1), lambda i: {TURN})), 1)], q))"
HULLS = f"""{ctes("particles")}, g AS (SELECT run_id, step, list(DISTINCT struct_pack(lon := CAST(lon AS DOUBLE), lat := CAST(lat AS DOUBLE)) ORDER BY struct_pack(lon := CAST(lon AS DOUBLE), lat := CAST(lat AS DOUBLE))) AS p FROM particles GROUP BY ALL),
h AS (SELECT run_id, step, {CHAIN.format("p")} AS low, {CHAIN.format("list_reverse(p)")} AS high, p FROM g),
r AS (SELECT run_id, step, CASE WHEN len(p) = 1 THEN list_transform([[-1, -1], [1, -1], [1, 1], [-1, 1]], lambda c: struct_pack(lon := p[1].lon + 0.01e0 * c[1], lat := p[1].lat + 0.01e0 * c[2])) WHEN len(p) = 2 THEN p ELSE list_concat(low[:-2], high[:-2]) END AS h FROM h)
SELECT run_id, step, CAST(i AS INT) AS vertex, h[i % len(h) + 1].lon AS lon, h[i % len(h) + 1].lat AS lat FROM (SELECT *, unnest(range(len(h) + 1)) AS i FROM r)"""


def ballistic(rows: DataFrame) -> DataFrame:
    """Impact of what falls (event_id, lat, lon, angle_deg, speed_ms, altitude_m, wind_ms, wind_deg): Euler steps of 0.01 s with quadratic drag, a batch of rows at a time, dealt by event_id as a small file is much work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k, a, w = 0.5 * 0.47 * 1.225 * 0.05 / 10.0, np.radians(b.angle_deg.to_numpy(float)), np.radians(b.wind_deg.to_numpy(float))
            x, y, vx, vy = np.zeros(len(b)), b.altitude_m.to_numpy(float).copy(), b.speed_ms.to_numpy(float) * np.cos(a), -b.speed_ms.to_numpy(float) * np.sin(a)
            wx = b.wind_ms.to_numpy(float) * np.sin(w)
            while (up := np.flatnonzero((y > 0) & (x < 500_000))).size:
                rel = vx[up] - wx[up]
                size = np.sqrt(rel**2 + vy[up] ** 2)
                vx[up] -= k * size * rel * 0.01
                vy[up] += (-9.81 - k * size * vy[up]) * 0.01
                x[up] += vx[up] * 0.01
                y[up] += vy[up] * 0.01
            lat, lon = b.lat.to_numpy(float), b.lon.to_numpy(float)
            yield pd.DataFrame({"event_id": b.event_id, "impact_lat": lat + x * np.cos(w) / 111_320, "impact_lon": lon + x * np.sin(w) / (111_320 * np.cos(np.radians(lat))), "range_m": np.rint(x), "fragment_radius_m": np.rint(np.maximum(50.0, x * 0.02))})

    return rows.repartition("event_id").mapInPandas(run, "event_id long, impact_lat double, impact_lon double, range_m double, fragment_radius_m double")


def leeway_lines(alerts: DataFrame, particles: int = 128, wind_u: float = 4.0, wind_v: float = 3.0, current_u: float = 0.1, current_v: float = 0.05, downwind: float = 0.035, crosswind: float = 0.01, radius_m: float = 150.0, step_s: int = 3600, sign: float = 1.0) -> DataFrame:
    """The particles of leeway(), each as the line it moves along: run_id, particle, lon0, lat0 and by_lon, by_lat, the way of a step."""
    p = alerts.select(F.col("event_id").alias("run_id"), "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(particles - 1))).alias("particle"))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), "run_id", "particle"), F.lit(1 << 30)) / (1 << 30)
    r, a, side = F.sqrt(draw(1)) * radius_m, draw(2) * 2 * np.pi, F.when(F.col("particle") % 2 == 0, 1.0).otherwise(-1.0)
    u = sign * (F.lit(current_u) + downwind * wind_u - side * crosswind * wind_v)
    v = sign * (F.lit(current_v) + downwind * wind_v + side * crosswind * wind_u)
    east = 111_320 * F.cos(F.radians("lat"))
    return p.select("run_id", "particle", (F.col("lon") + r * F.cos(a) / east).alias("lon0"), (F.col("lat") + r * F.sin(a) / 111_320).alias("lat0"), (u * step_s / east).alias("by_lon"), (v * step_s / 111_320).alias("by_lat"))


def leeway(alerts: DataFrame, particles: int = 128, hours: int = 24, step_s: int = 3600, **forcing: float) -> DataFrame:
    """An ensemble under constant forcing in closed form: particles seeded on a disc by a hash, half drifting to each side of the wind. run_id, step, particle, lon, lat. sign -1 tracks back. Leeway per cent are arguments, by the published tables of the object's type."""
    p = leeway_lines(alerts, particles, step_s=step_s, **forcing).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(hours * 3600 // step_s))))
    return p.select("run_id", "step", "particle", (F.col("lon0") + F.col("by_lon") * F.col("step")).alias("lon"), (F.col("lat0") + F.col("by_lat") * F.col("step")).alias("lat"))


def leeway_mean_path(alerts: DataFrame, particles: int = 128, hours: int = 24, step_s: int = 3600, **forcing: float) -> DataFrame:
    """mean_path(leeway(...)), all particles counted: as they move along lines, their mean moves along the mean of the lines, and steps are made of one row for each run instead of one for each particle."""
    p = leeway_lines(alerts, particles, step_s=step_s, **forcing)
    p = p.filter(~F.isnan("lon0") & ~F.isnan("lat0") & F.col("lon0").isNotNull() & F.col("lat0").isNotNull())
    mean = p.groupBy("run_id").agg(*[F.avg(c).alias(c) for c in ("lon0", "lat0", "by_lon", "by_lat")], F.count(F.lit(1)).alias("n"))
    steps = mean.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(hours * 3600 // step_s))))
    at = lambda c: geo.rounded(F.col(f"{c}0") + F.col(f"by_{c}") * F.col("step"), 6).alias(c)
    return steps.select("run_id", "step", at("lon"), at("lat"), "n")


def object_type(vessel: Column, persons: Column) -> Column:
    return F.when(vessel == "life_raft", F.when(F.coalesce(persons, F.lit(1)) <= 4, 27).otherwise(29)).otherwise(dims.looked_up(vessel, dims.LEEWAY_TYPE, 26))


def drift_results(alerts: DataFrame) -> DataFrame:
    """The last position of each path, for alerts that are not in work."""
    last = drift_path(alerts.filter(F.col("status") != "processing")).filter("step = 24").select("event_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    return last.withColumn("drift_id", F.sha2(F.concat_ws("|", F.lit("drift"), "event_id"), 256))


RESULTS = f"""dr AS (SELECT event_id, lat AS d_lat, lon AS d_lon, sha256('drift|' || event_id) AS drift_id FROM ({PATH.replace(ctes("alerts") + ",", "WITH", 1)}) WHERE step = 24 AND event_id IN (SELECT event_id FROM alerts WHERE status <> 'processing'))"""


def alerts_with_drift(alerts: DataFrame) -> DataFrame:
    return alerts.select("event_id", "lat", "lon", "status").join(drift_results(alerts), "event_id", "left")


def ops_summary(alerts: DataFrame) -> DataFrame:
    """Open is whatever is not completed."""
    return alerts.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") != "completed").alias("open"), F.count_if(F.col("status") == "failed").alias("failed"))


def anomalies(rows: DataFrame, as_of: Column, minutes: int, kind: str = "all", lat: float | None = None, lon: float | None = None, radius_km: float = 100.0) -> DataFrame:
    """Anomalies (anomaly_type, confidence, ts, lat, lon, event_id) of the last minutes, of a type or all, within a radius (those without a position pass), surest first."""
    out = rows.filter(F.col("ts") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))
    out = out if kind == "all" else out.filter(F.col("anomaly_type") == kind)
    if lat is not None and lon is not None:
        out = out.filter(F.col("lat").isNull() | F.col("lon").isNull() | (geo.planar(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon), 111.0) <= radius_km))
    return out.orderBy(F.desc("confidence"), F.desc("event_id"))


def canonical(rows: DataFrame) -> DataFrame:
    """Fields as JSON with sorted keys and whole numbers only, and its SHA-256; the signing keys of the published design are not on hand here."""
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    text = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"lat_e6":'), micro("lat"), F.lit(',"lon_e6":'), micro("lon"), F.lit(',"status":"'), F.col("status"), F.lit('"}'))
    return rows.withColumn("canonical", text).withColumn("sha256", F.sha2("canonical", 256))


def verified(rows: DataFrame) -> DataFrame:
    """Packets (with canonical and sha256) and whether the digest is theirs."""
    return rows.select("event_id", (F.sha2("canonical", 256) == F.col("sha256")).alias("hash_match"))


def export_rows(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Columns as text, missing ones empty; what a CSV with a header holds."""
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in columns])


def kml(rows: DataFrame) -> DataFrame:
    """A placemark for each row."""
    point = F.concat(F.lit("<Placemark><name>"), F.col("event_id"), F.lit("</name><Point><coordinates>"), geo.rounded(F.col("lon"), 5), F.lit(","), geo.rounded(F.col("lat"), 5), F.lit("</coordinates></Point></Placemark>"))
    return rows.select("event_id", point.alias("kml"))


def grid_nearest(points: DataFrame, lats: list[float], lons: list[float]) -> DataFrame:
    """The cell of a grid that is nearest along each axis, the lower one on ties."""
    near = lambda axis, c: F.array_min(F.transform(F.array(*map(F.lit, axis)), lambda x: F.struct(F.abs(x - c).alias("d"), x.alias("x"))))["x"]
    return points.select("event_id", near(lats, F.col("lat")).alias("grid_lat"), near(lons, F.col("lon")).alias("grid_lon"))


def first_forecast(points: DataFrame, hours: list[float], at: str) -> DataFrame:
    """The first forecast hour at or after a time, else the first of all."""
    axis = F.array(*map(F.lit, hours))
    return points.select("event_id", F.coalesce(F.array_min(F.filter(axis, lambda h: h >= F.col(at))), F.array_min(axis)).alias("hour"))


A = "alerts"
LATS, LONS, HOURS = [33 + x / 2 for x in range(9)], [11 + x / 2 for x in range(13)], [0.0, 3.0, 6.0]


def recent(s, p):
    pos = fixture(s, p, "ais_positions")
    rows = impossible_speed(pos).join(pos.select("event_id", "ts", "lat", "lon"), "event_id")
    return anomalies(rows.select("event_id", "anomaly_type", "confidence", "ts", "lat", "lon"), F.expr("timestamp_ntz'2024-01-29 00:00:00'"), 20_000, lat=35.0, lon=14.0, radius_km=250.0).select("event_id", "anomaly_type", "confidence")


QUERIES = {
    "survival": (lambda s, p: survival(fixture(s, p, A)), f"{ctes(A)}, {SURVIVAL} SELECT event_id, {R('p', 4)} AS survival_prob, {URGENCY} AS urgency FROM sv"),
    "interceptions": (lambda s, p: interceptions(fixture(s, p, A), dims.assets(s)).drop("exact_h"), f"{INTERCEPT} SELECT event_id, asset_id, {R('d', 2)} AS distance_nm, {R('t', 3)} AS hours, {R('i_lat', 5)} AS intercept_lat, {R('i_lon', 5)} AS intercept_lon, {R(BEARING, 1)} AS heading, feasible FROM r"),
    "priority_active": (lambda s, p: priorities(fixture(s, p, A), dims.assets(s)), PRIORITY),
    "drift_path": (lambda s, p: drift_path(fixture(s, p, A)), PATH),
    "drift_cones": (lambda s, p: drift_cones(fixture(s, p, A)), CONE),
    "particle_mean_path": (lambda s, p: mean_path(fixture(s, p, "particles")), f"{ctes('particles')} SELECT run_id, step, {R('avg(lon)', 6)} AS lon, {R('avg(lat)', 6)} AS lat, count(*) AS n FROM particles GROUP BY run_id, step"),
    "particle_nearest_step": (lambda s, p: nearest_step(fixture(s, p, "particles").select("run_id", "step", (F.col("step") * 4.5).alias("at_h")).distinct()), f"{ctes('particles')}, d AS (SELECT DISTINCT run_id, step FROM particles), h AS (SELECT *, unnest([6, 12, 24]) AS horizon FROM d) SELECT run_id, horizon, step FROM h QUALIFY row_number() OVER (PARTITION BY run_id, horizon ORDER BY abs(step * 4.5e0 - horizon), step) = 1"),
    "particle_hulls": (lambda s, p: hulls(fixture(s, p, "particles")), HULLS),
    "ballistic_impacts": (lambda s, p: ballistic(fixture(s, p, A).select("event_id", "lat", "lon", (30.0 + F.col("event_id") % 40).alias("angle_deg"), (300.0 + F.col("event_id") % 500).alias("speed_ms"), F.lit(8000.0).alias("altitude_m"), F.lit(5.0).alias("wind_ms"), F.lit(225.0).alias("wind_deg"))), None),
    "leeway_ensemble": (lambda s, p: leeway_mean_path(fixture(s, p, A), step_s=900), None),
    "object_types": (lambda s, p: fixture(s, p, A).select("event_id", object_type(F.col("vessel_type"), F.col("persons")).alias("object_type")), f"{ctes(A)} SELECT event_id, CASE vessel_type WHEN 'life_raft' THEN CASE WHEN coalesce(persons, 1) <= 4 THEN 27 ELSE 29 END WHEN 'rubber_boat' THEN 38 WHEN 'wooden_boat' THEN 46 ELSE 26 END AS object_type FROM alerts"),
    "alerts_with_drift": (lambda s, p: alerts_with_drift(fixture(s, p, A)), f"{ctes(A)}, {RESULTS} SELECT event_id, lat, lon, status, d_lat, d_lon, drift_id FROM alerts LEFT JOIN dr USING (event_id)"),
    "alert_features": (lambda s, p: alerts_with_drift(fixture(s, p, A)).filter("status = 'completed'").select("event_id", "d_lat", "d_lon"), f"{ctes(A)}, {RESULTS} SELECT event_id, d_lat, d_lon FROM alerts JOIN dr USING (event_id) WHERE status = 'completed'"),
    "ops_summary": (lambda s, p: ops_summary(fixture(s, p, A)), f"{ctes(A)} SELECT count(*) AS alerts, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status <> 'completed') AS open, count(*) FILTER (WHERE status = 'failed') AS failed FROM alerts"),
    "anomalies_recent": (recent, f"{ctes('ais_positions')}, {STEP} SELECT event_id, 'impossible_speed' AS anomaly_type, {R('least(0.9e0, 0.5e0 + (knots - most) / 100)', 4)} AS confidence FROM k WHERE gap_s > 0 AND dist_nm > 0 AND knots > most AND knots > 55 AND ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 20000 MINUTE AND sqrt((lat - 35) * (lat - 35) + (lon - 14) * (lon - 14)) * 111e0 <= 250"),
    "forensic_digest": (lambda s, p: canonical(fixture(s, p, A)).select("event_id", "sha256"), f"""{ctes(A)} SELECT event_id, sha256('{{"event_id":' || event_id || ',"lat_e6":' || CAST(round(lat * 1000000) AS BIGINT) || ',"lon_e6":' || CAST(round(lon * 1000000) AS BIGINT) || ',"status":"' || status || '"}}') AS sha256 FROM alerts"""),
    "forensic_verify": (lambda s, p: verified(canonical(fixture(s, p, A)).withColumn("sha256", F.when(F.col("event_id") % 7 == 0, "0").otherwise(F.col("sha256")))), f"{ctes(A)} SELECT event_id, event_id % 7 <> 0 AS hash_match FROM alerts"),
    "forensic_export": (lambda s, p: export_rows(fixture(s, p, A), ("event_id", "persons", "vessel_type", "status", "classification")), f"{ctes(A)} SELECT CAST(event_id AS STRING) AS event_id, coalesce(CAST(persons AS STRING), '') AS persons, coalesce(vessel_type, '') AS vessel_type, status, '' AS classification FROM alerts"),
    "ocean_nearest": (lambda s, p: grid_nearest(fixture(s, p, A), LATS, LONS), f"{ctes(A)} SELECT event_id, (SELECT arg_min(x, abs(x - lat) * 1000000 + x * 1e-6) FROM unnest([{', '.join(f'{x}e0' for x in LATS)}]) u(x)) AS grid_lat, (SELECT arg_min(x, abs(x - lon) * 1000000 + x * 1e-6) FROM unnest([{', '.join(f'{x}e0' for x in LONS)}]) u(x)) AS grid_lon FROM alerts"),
    "forecast_first": (lambda s, p: first_forecast(fixture(s, p, A), HOURS, "hours_elapsed"), f"{ctes(A)} SELECT event_id, CASE WHEN hours_elapsed <= 0 THEN 0e0 WHEN hours_elapsed <= 3 THEN 3e0 WHEN hours_elapsed <= 6 THEN 6e0 ELSE 0e0 END AS hour FROM alerts"),
    "alerts_kml": (lambda s, p: kml(fixture(s, p, A)), f"{ctes(A)} SELECT event_id, '<Placemark><name>' || event_id || '</name><Point><coordinates>' || {R('lon', 5)} || ',' || {R('lat', 5)} || '</coordinates></Point></Placemark>' AS kml FROM alerts"),
}
