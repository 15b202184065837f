"""Joins by distance and nearest neighbours against all pairs, with crowds and empty cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import ranges, records, rescue, sensing, tracks

V = "mmsi string, lat double, lon double"


def town(r, n, lat, lon, wide):
    return [(lat + r.uniform(-wide, wide), lon + r.uniform(-wide, wide)) for _ in range(n)]


def nearest(points, vessels, k):
    out = set()
    for e, a, b in points:
        if a is not None and b is not None:
            best = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), m) for m, x, y in vessels if x is not None and y is not None)[:k]
            out |= {(e, i + 1, m) for i, (_, m) in enumerate(best)}
    return out


@pytest.mark.parametrize("k,crowd", [(3, 400), (1, 50), (7, 3)])
def test_nearest_each(spark, k, crowd):
    r = random.Random(k)
    at = town(r, crowd, 35.5, 12.6, 1e-5) + town(r, crowd, 35.6, 12.7, 0.3) + town(r, 5, -60, -179.9, 3) + [(10.0, 10.0)] * 30 + [(0.0, 0.0), (-90.0, 180.0)]
    vessels = [(f"{i:05d}", *p) for i, p in enumerate(at)] + [("none", None, 1.0), ("nowhere", None, None)]
    points = [(i, *p) for i, p in enumerate(town(r, 30, 35.5, 12.6, 0.2) + town(r, 20, 0, 0, 80) + [(35.5, 12.6), (10.0, 10.0), (90.0, -180.0), (None, 2.0)])]
    got = tracks.nearest_each(spark.createDataFrame(points, "event_id long, lat double, lon double"), spark.createDataFrame(vessels, V), k)
    assert {(x.event_id, x["rank"], x.mmsi) for x in got.collect()} == nearest(points, vessels, k)


def test_nearest_each_of_few_vessels_and_of_none(spark):
    points = [(1, 50.0, 4.0), (2, -50.0, -170.0)]
    vessels = [("a", 1.0, 1.0), ("b", -1.0, -1.0)]
    df = spark.createDataFrame(points, "event_id long, lat double, lon double")
    assert {(x.event_id, x["rank"], x.mmsi) for x in tracks.nearest_each(df, spark.createDataFrame(vessels, V), 5).collect()} == nearest(points, vessels, 5)
    assert tracks.nearest_each(df, spark.createDataFrame([], V), 5).count() == 0


def test_plan_does_not_follow_the_data(spark):
    plans = []
    for n in (10, 3000):
        v = spark.range(n).select(F.col("id").cast("string").alias("mmsi"), (F.col("id") % 90).cast("double").alias("lat"), (F.col("id") % 7 / 1000).alias("lon"))
        p = spark.range(20).select(F.col("id").alias("event_id"), F.lit(3.0).alias("lat"), F.lit(0.001).alias("lon"))
        plan = tracks.nearest_each(p, v)._jdf.queryExecution().sparkPlan().toString()
        plans.append(plan.count("Join"))
    assert plans[0] == plans[1] <= 4


@pytest.mark.parametrize("room", [8192, 20])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_near_join_with_crowds_is_all_pairs(spark, room, how, monkeypatch):
    monkeypatch.setattr(ranges, "ROOM", room)
    r = random.Random(room)
    left = [(i, *p) for i, p in enumerate(town(r, 300, 40, 10, 0.2) + town(r, 60, 0, 0, 9) + [(5.0, 5.0)] * 40 + [(None, 3.0)])]
    right = [(i, *p) for i, p in enumerate(town(r, 80, 40, 10, 0.2) + town(r, 60, 0, 0, 9) + [(5.3, 5.3)] * 40 + [(3.0, None)])]
    a, b = spark.createDataFrame(left, "i long, lat double, lon double"), spark.createDataFrame(right, "j long, b_lat double, b_lon double")
    close = geo.planar(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"), 1.0) < 0.7
    want = {(i, j) for i, x, y in left for j, u, v in right if None not in (x, y, u, v) and math.sqrt((x - u) ** 2 + (y - v) ** 2) < 0.7}
    for planar in (False, True):
        got = ranges.near_join(a, b, ("lat", "b_lat"), ("lon", "b_lon"), 0.7, close, how, planar=planar).collect()
        if how == "inner":
            assert len(got) == len(want) and {(x.i, x.j) for x in got} == want
        else:
            assert sorted(x.i for x in got) == sorted({i for i, _ in want})


def test_no_share_of_a_city_is_large(spark):
    """A million positions in one cell: their shares are even, and every position is counted once."""
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.lit(36.0) + F.rand(1) / 10).alias("lat"), (F.lit(13.0) + F.rand(2) / 10).alias("lon"))
    keyed = rows.withColumn("_x", ranges.cell("lat", 4.5)).withColumn("_y", ranges.cell("lon", 4.5))
    shares = ranges.dealt(keyed, ranges.crowded(keyed, ["_x", "_y"]), ["_x", "_y"]).groupBy("_x", "_y", "_share").count()
    low, high, total, many = shares.agg(F.median("count"), F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    assert total == n and many > 100 and high <= 1.2 * low
    far = spark.createDataFrame([(36.0, 17.4), (36.05, 13.05)], "f_lat double, f_lon double")
    close = geo.planar(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"), 1.0) < 4.5
    assert ranges.near_join(rows, far, ("lat", "f_lat"), ("lon", "f_lon"), 4.5, close, "left_semi", planar=True).count() == n
    assert ranges.near_join(rows, far, ("lat", "f_lat"), ("lon", "f_lon"), 4.5, close).count() == 2 * n


@pytest.mark.parametrize("frame", [1, 2, 7, 64, 300])
def test_sliding_is_a_loop(spark, frame):
    r = random.Random(frame)
    xs = [r.uniform(-1, 1) * (1e6 if 500 < i < 520 else 1) for i in range(1500)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, n long, value double")
    at = sensing.blocked(df, "k", "n", frame, 350)
    got = {x.n: (x.s, x.m) for x in sensing.sliding(at, "k", "n", frame, s=("sum", F.col("value") * F.col("value")), m=("max", F.abs("value"))).filter("own").collect()}
    assert len(got) == len(xs)
    for i in range(len(xs)):
        part = xs[max(0, i - frame + 1) : i + 1]
        assert got[i][1] == max(map(abs, part))
        assert math.isclose(got[i][0], sum(x * x for x in part), rel_tol=1e-12)


def aircraft(spark, n):
    i = F.col("id")
    return spark.range(n).select(i.alias("rec_id"), (i % 2).alias("poll_no"), (34 + i * 37 % 11 / 300).alias("lat"), (12 + i * 53 % 13 / 300).alias("lon"), F.when(i % 17 > 0, (i * 29 % 400 - 20) / 1.0).alias("track"))


@pytest.mark.parametrize("wrap", [False, True])
def test_formations_are_all_pairs_and_broadcast_nothing(spark, wrap):
    a = aircraft(spark, 300)
    found = sensing.formations(a, wrap=wrap)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [r for r in a.collect() if r.track is not None]
    off = lambda x, y: min(abs(x - y), 360 - abs(x - y)) if wrap else abs(x - y)
    want = {(x.rec_id, y.rec_id, x.poll_no) for x in rows for y in rows if x.poll_no == y.poll_no and x.rec_id < y.rec_id and math.sqrt((x.lat - y.lat) ** 2 + (x.lon - y.lon) ** 2) * 60 < 1 and off(x.track, y.track) < 5}
    got = [tuple(x) for x in found.collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_traffic_rules_broadcast_nothing(spark):
    a = aircraft(spark, 50).select("*", F.lit("abc").alias("icao"), F.lit("x").alias("callsign"), F.lit("").alias("squawk"), F.lit(400.0).alias("alt_ft"))
    c = spark.range(9).select(F.col("id").alias("conflict_id"), (34 + F.col("id") / 1000).alias("latitude"), (12 + F.col("id") / 1000).alias("longitude"))
    rules = sensing.traffic_rules(a, c)
    assert "Broadcast" not in rules._jdf.queryExecution().executedPlan().toString()
    assert {(r.rec_id, r.confidence) for r in rules.filter("anomaly_type = 'low_altitude'").collect()} == {(i, 0.9) for i in range(50)}


@pytest.mark.parametrize("most", [1, 5])
def test_first_within_is_all_pairs_and_meets_few(spark, most, monkeypatch):
    r = random.Random(most)
    at = town(r, 12, 0, 0, 1.5) + [(0.0, 0.0), (0.125, 0.125), (50.0, 50.0), (float("nan"), 1.0), (None, 1.0)]
    rows = [(k - 300, *p) for k, p in enumerate(town(r, 1500, 0, 0, 2.0) + [(1.0, 0.0), (0.0, 1.0), (float("nan"), 0.0), (None, 0.0), (50.0, 51.0), (50.5, 50.0)])]
    tables, stored = [], ranges.stored
    monkeypatch.setattr(ranges, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    places, others = spark.createDataFrame(at, "lat double, lon double"), spark.createDataFrame(rows, "k long, b_lat double, b_lon double")
    close = geo.planar(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"), 1.0) <= 1.0
    got = [tuple(x) for x in ranges.first_within(places, others, ("lat", "lon"), ("b_lat", "b_lon"), "k", 1.0, close, most).collect()]
    pairs = {(a, b, k) for a, b in at if a is not None and a == a for k, x, y in rows if x is not None and math.sqrt((a - x) ** 2 + (b - y) ** 2) <= 1.0}
    want = {(a, b, k) for a, b in at for k in sorted(k for x, y, k in pairs if (x, y) == (a, b))[:most]}
    assert set(got) == want and len(got) == len(want)
    assert tables[-1].count() <= most * len(at) < len(pairs)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_each_ranks_only_what_lies_within_its_bound(spark):
    p = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") / 10).alias("lat"), (F.col("id") / 7).alias("lon"))
    plan = plan_of(tracks.nearest_each(p, p.select(F.col("event_id").cast("string").alias("mmsi"), "lat", "lon")))
    assert "bound" in plan and "Broadcast" not in plan


def test_few_bytes_of_much_work_are_dealt(spark):
    a = spark.range(20).select(F.col("id").alias("event_id"), (33 + F.col("id") / 10).alias("lat"), (11 + F.col("id") / 7).alias("lon"), *[(F.col("id") * 1.0).alias(c) for c in ("angle_deg", "speed_ms", "altitude_m", "wind_ms", "wind_deg")])
    assert "Exchange hashpartitioning(event_id" in plan_of(rescue.ballistic(a))
    plan = plan_of(records.kml_documents(a))
    assert plan.count("REPARTITION_BY_COL") == plan.count("Exchange") >= 1  # documents' parts are put together where alerts are


def test_hulls_look_at_a_place_once(spark):
    at = spark.range(200).select((F.col("id") % 2).alias("run_id"), F.lit(1).alias("step"), (F.col("id") % 5 / 1.0).alias("lon"), (F.col("id") % 7 / 1.0).alias("lat"))
    plan = rescue.hulls(at)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [run_id") >= 1 and all(x in plan for x in ("lon#", "lat#"))
    assert [x for x in plan.splitlines() if "Aggregate [" in x][-1].count("max_by") == 0
