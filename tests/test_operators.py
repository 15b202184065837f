"""Literal cases, brute force and invariants where SQL has no say."""

import hashlib
import json
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from plain import Fusion
from pyspark.sql import functions as F

from tidewatch.functions import geo, messages, sea
from tidewatch.operators import ranges, records, rescue, sensing, signals, tracks
from tidewatch.plans.queries import QUERIES
from tidewatch.sources import dims, storage
from tidewatch.sources.fixtures import fixture
from tidewatch.streaming import keyed, replay, stateful

POS = "event_id long, mmsi string, ts timestamp_ntz, lat double, lon double, vessel_type string"
T0 = datetime(2024, 1, 1)


def test_impossible_speed_of_a_cargo_ship(spark):
    rows = [(1, "a", T0, 35.0, 14.0, "cargo"), (2, "a", T0 + timedelta(seconds=60), 36.0, 15.0, "cargo"), (3, "b", T0, 36.0, 15.0, "cargo"), (4, None, None, None, None, None)]
    found = tracks.impossible_speed(spark.createDataFrame(rows, POS)).collect()
    assert [(r.event_id, r.confidence) for r in found] == [(2, 0.9)]


def test_gnss_jump(spark):
    rows = [(1, "a", T0, 35.5, 14.0, ""), (2, "a", T0 + timedelta(milliseconds=300), 35.51, 14.01, "")]
    none = spark.createDataFrame([], "geom_type string, lat double, lon double")
    assert [r.anomaly_type for r in tracks.gnss_anomalies(spark.createDataFrame(rows, POS), none).collect()] == ["position_jump"]


def test_weather_gives_three(spark):
    rows = [(1, 27 / 1.944, 3.2, 9999.0), (2, 45 / 1.944, 5.0, 9999.0), (3, 10 / 1.944, 0.0, 200.0)]
    found = sensing.weather_rules(spark.createDataFrame(rows, "obs_id long, wind_ms double, wave_m double, visibility_m double")).collect()
    assert sorted((r.obs_id, r.anomaly_type) for r in found) == [(1, "SAR"), (2, "STORM"), (3, "LOW_VISIBILITY")]


def test_beaufort_and_survival_scales(spark):
    df = spark.createDataFrame([(0.0, -5.0), (0.3, 0.0), (8.0, 12.5), (40.0, 99.0)], "w double, t double")
    got = df.select(sea.beaufort(F.col("w")), sea.survival_hours(F.col("t")), sea.compass(F.col("w") * 9)).collect()
    assert [tuple(r) for r in got] == [(0, 0.5, "N"), (1, 0.5, "N"), (5, 4.0, "ENE"), (12, 40.0, "N")]


def test_cold_water_is_urgent(spark):
    df = spark.createDataFrame([(2.0, "sinking", False, True)], "hours_elapsed double, vessel_condition string, medical_emergency boolean, children_aboard boolean").withColumn("event_id", F.lit(1))
    assert rescue.survival(df, water=10.0, wind=12.0, wave=3.0).first().urgency in ("URGENT", "IMMEDIATE")


def test_correlation_weights_and_clear_on_emit(spark):
    chans = ["infrasound:events", "seismic:events", "hydro:events", "infrasound:events"]
    rows = [(i, 1, 10 * i, c) for i, c in enumerate(chans)]
    df = spark.createDataFrame(rows, "event_id long, platform_id long, t_s long, channel string")
    assert [r.weight for r in sensing.scores(df).orderBy("event_id").collect()] == [28, 50, 62, 62]
    assert [(r.event_id, r.weight, r.threat) for r in sensing.threats(df).collect()] == [(2, 62, "physical_threat_candidate")]
    five = [(i, 1, i, c) for i, c in enumerate(["infrasound:events", "sensors:ionospheric", "adsb:anomalies", "hydro:events", "seismic:events"])]
    out = sensing.threats(spark.createDataFrame(five, df.schema)).collect()
    assert [(r.event_id, r.weight) for r in out] == [(3, 58)]


def test_threats_are_those_of_a_plain_loop_and_of_the_stream(spark, small):
    rows = fixture(spark, small, "sensor_events")
    want = set()
    for p in {r.platform_id for r in rows.collect()}:
        fusion = Fusion([])
        for r in sorted((r for r in rows.collect() if r.platform_id == p), key=lambda r: (r.t_s, r.event_id)):
            if (f := fusion.add(r.t_s, dims.SENSOR.get(r.channel, ""))) is not None:
                want.add((p, r.event_id, f["weight"], f["sources"]))
    pick = lambda df: {(r.platform_id, r.event_id, r.weight, r.sources) for r in df.collect()}
    assert pick(sensing.threats(rows)) == want
    assert pick(replay.stream_threats(spark, small)) == want
    sliced = replay.replayed(rows.select("platform_id", "event_id", "t_s", "channel"), keyed.threats, batches=5, order="t_s")
    assert pick(sliced) == want


def test_stream_windows_sessions_and_throttle(spark, small):
    rows = fixture(spark, small, "sensor_events").withColumn("ts", F.timestamp_seconds(F.col("t_s")))
    events = rows.select("event_id", "ts", "platform_id", "channel")
    out = replay.replayed(events, stateful.channel_counts, batches=3)
    # a window is out once the watermark is past its end
    seen = rows.agg(F.max("t_s") - 600).first()[0]
    want = rows.groupBy("platform_id", "channel", (F.floor(F.col("t_s") / 120) * 120).alias("start")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("start") + 120 <= seen)
    assert {(r.platform_id, r.channel, int(r.start.timestamp()), r.n) for r in out.select("platform_id", "channel", F.col("start"), "n").collect()} == {tuple(r) for r in want.collect()}
    pos = fixture(spark, small, "ais_positions").withColumn("t_s", F.unix_seconds(F.col("ts").cast("timestamp")))
    out = replay.replayed(pos.select("event_id", "mmsi", "t_s"), lambda r: stateful.throttled(r, 7200), batches=4, order="t_s")
    assert {r.event_id for r in out.collect()} == {r.event_id for r in tracks.throttled(pos, 7200.0).collect()}
    own = pos.select("event_id", "mmsi", "t_s", F.col("ts").cast("timestamp").alias("ts"))
    out = replay.replayed(own, lambda r: stateful.sessions(r, "1 hour"), batches=4, order="t_s")
    by, want, last = defaultdict(list), set(), pos.agg(F.max("ts")).first()[0]
    for r in pos.select("mmsi", "ts").collect():
        by[r.mmsi].append(r.ts)
    for mmsi, times in by.items():
        times.sort()
        begin, n = times[0], 1
        for before, at in [*zip(times, times[1:]), (times[-1], None)]:
            if at is None or at - before >= timedelta(hours=1):
                if before + timedelta(hours=1) <= last - timedelta(minutes=10):
                    want.add((mmsi, begin.isoformat(), n))
                begin, n = at, 0
            n += 1
    assert {(r.mmsi, r.first_seen, r.positions) for r in out.select("mmsi", F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("first_seen"), "positions").collect()} == {(m, b if "." in b else b + ".000000", n) for m, b, n in want}


def test_a_stream_goes_on_from_its_checkpoint(spark, small, tmp_path):
    rows = fixture(spark, small, "sensor_events").select("platform_id", "event_id", "t_s", "channel")
    root, half = f"file://{tmp_path}", rows.agg(F.max("t_s") / 2).first()[0]
    for part in (rows.filter(F.col("t_s") <= half), rows.filter(F.col("t_s") > half)):
        replay.arriving(part, f"{root}/in", 2, "t_s")
        out = replay.drained(keyed.threats(replay.source(spark, rows, f"{root}/in")), root)
    pick = lambda df: {(r.platform_id, r.event_id, r.weight, r.sources) for r in df.collect()}
    assert pick(out) == pick(sensing.threats(fixture(spark, small, "sensor_events")))


def test_last_values_of_a_stream(spark, small):
    pos = fixture(spark, small, "ais_positions").select("event_id", "mmsi", "lat", "lon", "ts")
    found = []
    root = storage.shared_dir(spark) + "/last"
    replay.arriving(pos, f"{root}/in", 3, "event_id")
    keep = lambda batch, _: found.append({r.mmsi: (r.lat, r.lon) for r in batch.collect()})
    stateful.last_values(replay.source(spark, pos, f"{root}/in")).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    assert found[-1] == {r.mmsi: (r.lat, r.lon) for r in tracks.latest(fixture(spark, small, "ais_positions")).collect()}


def test_blocks_change_no_frame(spark):
    r = random.Random(4)
    rows = [(k, i * 3 + k, float(r.randrange(100))) for k in range(2) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, at long, x double")
    from pyspark.sql import Window

    for size, halo in ((40, 39), (64, 10), (1000, 39)):
        b = sensing.blocked(df, "k", "at", halo, size)
        own = b.select("k", "at", "own", F.sum("x").over(Window.partitionBy("k", "block").orderBy("at").rowsBetween(-halo, 0)).alias("s"), F.count("x").over(Window.partitionBy("k", "block").orderBy("at").rowsBetween(-halo, 0)).alias("n")).filter("own").drop("own")
        w = Window.partitionBy("k").orderBy("at").rowsBetween(-halo, 0)
        assert sorted(own.collect()) == sorted(df.select("k", "at", F.sum("x").over(w), F.count("x").over(w)).collect())
    assert sensing.blocked(df.filter("false"), "k", "at", 5).collect() == []


def test_alert_collections_are_geojson(spark, small):
    alerts = fixture(spark, small, "alerts").limit(5)
    got = {r.event_id: json.loads(r.geojson) for r in records.collection(alerts).collect()}
    assert len(got) == 5
    for c in got.values():
        assert c["type"] == "FeatureCollection" and [f["properties"]["kind"] for f in c["features"]] == ["trajectory", "cone_6h", "cone_12h", "cone_24h", "impact"]
        line, *cones, end = [f["geometry"] for f in c["features"]]
        assert len(line["coordinates"]) == 25 and line["coordinates"][-1] == end["coordinates"]
        assert all(ring["coordinates"][0][0] == ring["coordinates"][0][-1] for ring in cones)


def test_packets_hold_odd_texts_and_nulls(spark):
    df = spark.createDataFrame([(1, 'a "b" \\ c\n', None, True), (2, None, 5, False)], "event_id long, note string, persons int, open boolean")
    p = records.packets(df, ("persons", "note", "event_id", "open"))
    for r in p.collect():
        assert json.loads(r.canonical) == {"event_id": r.event_id, "note": r.note, "open": r.open, "persons": r.persons}
        assert list(json.loads(r.canonical)) == ["event_id", "note", "open", "persons"]
        assert r.sha256 == hashlib.sha256(r.canonical.encode()).hexdigest()
    assert all(r.hash_match for r in records.checked(p, ("persons", "note", "event_id", "open")).collect())
    assert not any(r.hash_match for r in records.checked(p.withColumn("persons", F.lit(9)), ("persons", "note", "event_id", "open")).collect())


def test_messages(spark):
    cases = {
        "Position: 35.1, 12.2 45 persons on rubber boat, sinking": (35.1, 12.2, "alarm_phone_format", 45, "rubber_boat", "sinking"),
        "https://maps.google.com/?q=95.0,14.0 then lat: 33.5 lon: 13.5": (33.5, 13.5, "decimal_labeled", None, None, None),
        "36.5 N 12.25 W wooden boat taking water": (36.5, -12.25, "decimal_explicit", None, "wooden_boat", "taking_water"),
        "قارب مطاطي ٤٥ شخص يغرق 34.5123, 13.4567": (34.5123, 13.4567, "decimal_plain", 45, "rubber_boat", "sinking"),
        "10 miles north of Lampedusa": (35.507 + 18.52 / 111.32, 12.611, "natural_language", None, None, None),
        "ΒΥΘΊΖΕΤΑΙ παιδιά": (None, None, "none", None, None, None),
        "": (None, None, "none", None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    t = F.col("t")
    for r in df.select("t", messages.coordinates(t).alias("c"), messages.persons(t).alias("n"), messages.keyword(t, messages.VESSELS).alias("v"), messages.keyword(t, messages.CONDITIONS).alias("k")).collect():
        lat, lon, how, n, v, k = cases[r.t]
        assert (r.c.method, r.n, r.v) == (how, n, v)
        assert (r.c.lat is None) == (lat is None) and (lat is None or math.isclose(r.c.lat, lat) and math.isclose(r.c.lon, lon))
        assert k is None or r.k == k


def test_channels(spark):
    df = spark.createDataFrame([(1, "sms", "POSITION:34.5S/15.2W PERS:45 TYPE:RB"), (2, "sms", "[TRANSCRIPT] near Malta"), (3, "sms", None)], "doc_id long, channel string, body string")
    a = {r.doc_id: r for r in signals.from_sms(df).collect()}
    assert (a[1].lat, a[1].lon, a[1].confidence, a[1].persons, a[1].vessel_type) == (34.5, 15.2, 0.97, 45, "rubber_boat")
    assert (a[2].confidence, a[2].review, a[3].method) == (0.45, True, "none")
    s = signals.from_sms(df, signed=True).filter("doc_id = 1").first()
    assert (s.lat, s.lon) == (-34.5, -15.2)
    rt = spark.createDataFrame([(1, "x", "RT @foe 35.123, 12.123", "nobody"), (2, "x", "35.123, 12.123 #medrescue", "MSF_Sea"), (3, "x", "RT @msf_sea 35.123, 12.123", None)], "doc_id long, channel string, body string, author string")
    b = {r.doc_id: r for r in signals.from_microblog(rt).collect()}
    assert (b[1].confidence, b[1].lat, b[2].confidence, b[3].confidence) == (0.0, None, 0.8, 0.8)


def test_hull_and_ballistic(spark):
    pts = [(1, 0, x / 4, y / 4) for x in range(5) for y in range(5)] + [(2, 0, 1.0, 1.0)]
    got = rescue.hulls(spark.createDataFrame(pts, "run_id long, step int, lon double, lat double")).collect()
    assert {(r.lon, r.lat) for r in got if r.run_id == 1} == {(0, 0), (1, 0), (1, 1), (0, 1)}
    assert len([r for r in got if r.run_id == 2]) == 5
    fall = spark.createDataFrame([(1, 55.5, 15.7, 45.0, 800.0, 10_000.0, 0.0, 0.0)], "event_id long, lat double, lon double, angle_deg double, speed_ms double, altitude_m double, wind_ms double, wind_deg double")
    x, y, vx, vy, k = 0.0, 10_000.0, 800 * math.cos(math.pi / 4), -800 * math.sin(math.pi / 4), 0.5 * 0.47 * 1.225 * 0.05 / 10
    while y > 0:
        v = math.hypot(vx, vy)
        vx, vy = vx - k * v * vx * 0.01, vy + (-9.81 - k * v * vy) * 0.01
        x, y = x + vx * 0.01, y + vy * 0.01
    assert rescue.ballistic(fall).first().range_m == round(x)


def test_leeway_is_closed_form_and_tracks_back(spark):
    a = spark.createDataFrame([(1, 35.0, 12.0)], "event_id long, lat double, lon double")
    there = rescue.mean_path(rescue.leeway(a, 64, 6)).filter("step = 6").first()
    back = rescue.mean_path(rescue.leeway(a, 64, 6, sign=-1.0)).filter("step = 6").first()
    assert there.lon > 12 > back.lon and there.lat > 35 > back.lat and there.n == 64


def test_mean_of_leeway_is_the_mean_of_all_particles_without_a_row_for_each_step_of_one(spark, small):
    a = spark.createDataFrame([(1, 35.0, 12.0), (2, -60.0, 179.0), (2, 10.0, 5.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 1.0, None)], "event_id long, lat double, lon double")
    forcing = {"wind_u": -7.0, "current_v": 0.3, "sign": -1.0}
    got = rescue.leeway_mean_path(a, 33, 5, 900, **forcing)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rescue.mean_path(rescue.leeway(a, 33, 5, 900, **forcing)).collect()} and got.count() == 42
    plan = QUERIES["leeway_ensemble"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("step") < plan.index("Aggregate")  # steps are made of means


def test_upsert_keeps_old_values_where_new_ones_are_null(spark):
    old = spark.createDataFrame([("a", "X", 1.0), ("b", "Y", 2.0)], "mmsi string, ship_name string, lat double")
    new = spark.createDataFrame([("a", None, 9.0), ("c", "Z", None)], "mmsi string, ship_name string, lat double")
    assert {tuple(r) for r in tracks.upserted(old, new).collect()} == {("a", "X", 9.0), ("b", "Y", 2.0), ("c", "Z", None)}


def test_near_join_is_the_cross_join(spark):
    a = spark.range(200).select(F.col("id").alias("i"), ((F.col("id") * 37) % 101 / 10).alias("lat"), ((F.col("id") * 53) % 97 / 10).alias("lon"))
    b = a.select(F.col("i").alias("j"), F.col("lat").alias("b_lat"), (F.col("lon") + 0.05).alias("b_lon"))
    close = geo.planar(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"), 1.0) < 0.7
    got = {(r.i, r.j) for r in ranges.near_join(a, b, ("lat", "b_lat"), ("lon", "b_lon"), 0.7, close).collect()}
    assert got == {(r.i, r.j) for r in a.crossJoin(b).filter(close).collect()} and got


@pytest.mark.parametrize("gap", [3, 7])
def test_spaced_is_greedy(spark, gap):
    xs = [0, 1, 3, 4, 5, 8, 20, 21, 22, 23, 24, 27, 40]
    got = sorted(r.n for r in sensing.spaced(spark.createDataFrame([("s", x) for x in xs], "k string, n long"), "k", "n", gap).collect())
    want = []
    for x in xs:
        if not want or x - want[-1] >= gap:
            want.append(x)
    assert got == want


def test_gate_is_an_as_of_join(spark):
    import random

    import duckdb

    r = random.Random(2)
    kinds = ["sensors:ionospheric", "ionosphere:anomalies", "seismic:events", "unknown"]
    events = [(i, r.choice(kinds), r.randrange(200_000), r.choice([0.2, 0.5, 0.9])) for i in range(400)]
    events += [(900, kinds[0], 11_100, 0.9), (901, kinds[2], 11_100, 0.1), (902, kinds[0], 10_200 + 10_800, 0.9)]
    reports = [(10_200, 5.0), *[(t, r.choice([1.0, 4.0, 4.5, 8.0])) for t in r.sample(range(22_000, 200_000), 15)]]
    got = sensing.gated(spark.createDataFrame(events, "event_id long, channel string, t_s long, confidence double"), spark.createDataFrame(reports, "t_s long, kp double"))
    assert got.columns == ["event_id", "channel", "t_s", "confidence"]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, channel VARCHAR, t_s BIGINT, confidence DOUBLE)")
    con.execute("CREATE TABLE k (t_s BIGINT, kp DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", events)
    con.executemany("INSERT INTO k VALUES (?, ?)", reports)
    want = con.execute("""SELECT event_id FROM e ASOF LEFT JOIN k ON e.t_s >= k.t_s WHERE channel NOT IN ('sensors:ionospheric', 'ionosphere:anomalies')
      OR (confidence >= 0.5 AND NOT coalesce(kp > 4 AND e.t_s - k.t_s < 10800, false))""").fetchall()
    ids = sorted(x.event_id for x in got.collect())
    assert ids == sorted(x[0] for x in want)
    assert 900 not in ids and {901, 902} <= set(ids)
