"""What views and exports read: documents, counts, scores under an environment, merged payloads, bursts."""

import json
import math
import random
import xml.etree.ElementTree as ET
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import records, rescue, sensing, serving, signals, tracks
from tidewatch.sources import dims
from tidewatch.sources.fixtures import fixture


def test_kml_is_what_a_writer_of_xml_makes(spark):
    alerts = spark.createDataFrame([(123456789, 35.5, 12.25)], "event_id long, lat double, lon double")
    made = records.kml_documents(alerts).first().kml
    kml = ET.Element("kml", xmlns="http://www.opengis.net/kml/2.2")
    doc = ET.SubElement(kml, "Document")
    ET.SubElement(doc, "name").text = "Drift 12345678"
    for i, colour, _ in records.CONE_STYLES.values():
        style = ET.SubElement(doc, "Style", id=i)
        for kind, rest in (("PolyStyle", (("color", colour), ("fill", "1"), ("outline", "1"))), ("LineStyle", (("color", colour), ("width", "2")))):
            part = ET.SubElement(style, kind)
            for k, v in rest:
                ET.SubElement(part, k).text = v

    def mark(name, *way, style=None):
        at = ET.SubElement(doc, "Placemark")
        ET.SubElement(at, "name").text = name
        if style:
            ET.SubElement(at, "styleUrl").text = f"#{style}"
        for w in way:
            at = ET.SubElement(at, w)
        return at

    mark("DATUM", "Point", "coordinates").text = "12.25,35.5,0"
    at = lambda rows: " ".join(f"{r.lon},{r.lat},0" for r in rows)
    mark("Trajectory", "LineString", "coordinates").text = at(rescue.drift_path(alerts).orderBy("step").collect())
    for hours, (i, _, label) in records.CONE_STYLES.items():
        mark(label, "Polygon", "outerBoundaryIs", "LinearRing", "coordinates", style=i).text = at(rescue.drift_cones(alerts).filter(F.col("hours") == hours).orderBy("vertex").collect())
    ET.indent(kml)
    assert made == "<?xml version='1.0' encoding='UTF-8'?>\n" + ET.tostring(kml, encoding="unicode")


def test_counts_have_no_cap(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("event_id"))
    out = serving.with_count(rows)
    assert out.agg(F.count(F.lit(1)), F.min("count"), F.max("count")).first() == (20_000, 20_000, 20_000)
    assert serving.export_with_count(rows, str(tmp_path / "e")) == 20_000
    assert serving.with_count(rows.filter("false")).count() == 0


def test_a_new_environment_scores_open_signals_anew(spark, small):
    alerts = fixture(spark, small, "alerts")
    writes = alerts.withColumn("seq", F.col("event_id"))
    env = spark.createDataFrame([(1, 18.0, None, 5.0, 1.0), (2, None, None, None, None)], "seq long, water_temp_c double, air_temp_c double, wind_ms double, wave_m double")
    resolved = alerts.filter("event_id % 3 = 0").select("event_id")
    assets = dims.assets(spark)
    pick = lambda df: [(r.event_id, r.priority, r.urgency) for r in df.collect()]
    same = pick(records.engine_state(writes, resolved, env, assets))
    open_ = alerts.filter("event_id % 3 <> 0").withColumn("status", F.lit("failed"))
    assert same == pick(rescue.priorities(open_, assets))
    colder = env.union(spark.createDataFrame([(3, 2.0, None, None, 4.0)], env.schema))
    cold = pick(records.engine_state(writes, resolved, colder, assets))
    assert cold == pick(rescue.scored(open_, assets, 2.0, 5.0, 4.0)) and cold != same
    assert [p for _, p, _ in cold] == sorted((p for _, p, _ in cold), reverse=True)
    assert {e for e, *_ in cold} == {e for e, *_ in same}


@pytest.mark.parametrize("keep", [0.5, 0.99, 0.9995, 0.999999])
def test_bursts_for_any_decay(spark, keep):
    r = random.Random(9)
    rows = [(i, i % 3, i, r.choice([-70.0, -68.5, -73.25]) + (25 if r.random() < 0.01 else 0)) for i in range(9000)] + [(9001, 0, 9001, None), (9002, 6, 9002, -60.0)]
    want, means = {}, {}
    for e, b, _, p in rows:
        if p is not None:
            m = means.setdefault(b, p)
            if p - m >= 10:
                want[e] = p - m
            means[b] = keep * m + (1 - keep) * p
    got = {x.event_id: x.excess_db for x in sensing.rf_bursts(spark.createDataFrame(rows, "event_id long, band_no long, seq long, power_db double"), keep).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    assert all(math.isclose(got[e], want[e], abs_tol=1e-4) for e in want)


def test_payloads_are_merged_field_by_field(spark):
    r = random.Random(7)
    rows, want, nav = [], defaultdict(dict), {}
    for i in range(400):
        v, d = r.choice([("a", None), (None, "dev"), (None, None), ("", "dev"), ("b", "dev")])
        p = r.choice([None, {}, {"x": str(i)}, {"x": None, "y": f'"{i}'}, {"ship_name": r.choice(["S", ""])}])
        kind, lat = r.choice(["position_fix", "vessel_track"]), r.choice([None, float(i)])
        rows.append((i, v, d, kind, "ad", "ok", p, lat, 1.0, None if i % 2 else 2.0, 3.0, 4.0))
        name = v or d or "ownship"
        want[name].update(p or {})
        if kind == "position_fix" and lat is not None:
            nav[name] = (lat, None if i % 2 else 2.0)
    schema = "seq long, vessel_id string, device_id string, event_kind string, adapter string, status string, payload map<string,string>, lat double, lon double, course double, speed double, heading double"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("seq")).repartition(3)
    got = {x.vessel: x for x in tracks.vessel_state(df).collect()}
    assert {k: json.loads(x.payload) for k, x in got.items()} == dict(want)
    assert {k: (x.lat, x.course) for k, x in got.items()} == nav


def test_webhook_payloads(spark):
    bodies = [
        '{"lat": 35.1, "lon": "15.2", "text": "x", "source": "ngo", "timestamp": "2024-01-01T10:00:00"}', '{"position": {"lat": 1, "longitude": 2}, "message": "20 people"}', '{"lat": null, "lon": 3, "body": "lat: 33.5 lon: 13.5"}',
        '{"lat": "x", "lon": 3}', "not json", None, '{"persons": 4, "medical_emergency": true, "children_aboard": 0, "timestamp": "never"}',
    ]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id long, payload string").withColumn("received_at", F.timestamp_seconds(F.lit(5)))
    got = {r.doc_id: r for r in signals.from_webhook(rows.withColumn("at_s", F.lit(0))).withColumn("at_s", F.unix_seconds("at")).collect()}
    assert (got[0].lat, got[0].lon, got[0].confidence, got[0].channel, got[0].at_s, got[0].method) == (35.1, 15.2, 0.95, "ngo", 1704103200, "webhook_explicit")
    assert (got[1].lat, got[1].lon, got[1].persons) == (1.0, 2.0, 20)
    assert (got[2].lat, got[2].lon, got[2].confidence) == (33.5, 13.5, 0.95)
    assert all((got[i].lat, got[i].confidence, got[i].method) == (None, 0.0, "none") for i in (3, 4, 5))
    assert (got[6].persons, got[6].medical_emergency, got[6].children_aboard, got[6].at_s) == (4, True, False, 5)
