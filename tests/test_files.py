from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import serving, tracks
from tidewatch.sources import files
from tidewatch.sources.fixtures import fixture


def test_logs_skip_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_type":"position_fix","lat":1.5,"source":{"adapter":"x"}}\n\nnot json\n{"event_type":"b"}\n')
    rows = files.read_log(spark, str(tmp_path), files.EVENT)
    assert [(r.event_type, r.lat) for r in rows.orderBy("event_type").collect()] == [("b", None), ("position_fix", 1.5)]
    files.append_log(rows.filter("event_type = 'b'"), str(tmp_path / "more"))
    q = files.stream_log(spark, str(tmp_path / "more"), files.EVENT).writeStream.format("memory").queryName("log_stream").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("log_stream").count() == 1


def test_nested_sources(spark):
    one = lambda s: spark.createDataFrame([(3, s)], "poll_no int, body string")
    a = files.snapshot_rows(one('{"aircraft":[{"hex":"AE01","flight":"X ","altitude":300},{"hex":"b","alt_baro":5,"altitude":7}]}')).orderBy("icao").collect()
    assert [(r.icao, r.callsign, r.alt_ft) for r in a] == [("ae01", "X", 300.0), ("b", None, 5.0)]
    s = files.listed_ids(one('{"sdnList":{"sdnEntry":[{"idList":{"id":[{"idType":"Vessel MMSI","idNumber":" 9 "},{"idType":"IMO","idNumber":"1"},{"idType":"mmsi","idNumber":"9"}]}}]}}'))
    assert [r.mmsi for r in s.collect()] == ["9"]
    f = files.point_features(one('{"features":[{"geometry":{"type":"Point","coordinates":[14.5,35.25]}},{"geometry":{"type":"Polygon","coordinates":[[[1,2]]]}}]}')).orderBy("geom_type").collect()
    assert [tuple(r) for r in f] == [("Point", 35.25, 14.5), ("Polygon", None, None)]
    k = one('[["t","kp"],["x","4.33"]]').select(files.last_kp(F.col("body"))).first()[0]
    assert k == 4.33
    old = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 3))], files.ASSET_AGE)
    assert [tuple(r) for r in files.fresh(old, F.lit(datetime(2024, 1, 3, 12))).orderBy("asset").collect()] == [("a", 60.0, True), ("b", 12.0, False)]


def test_lists_and_exports(spark, tmp_path):
    df = spark.createDataFrame([('["a", " b "]',), ("a, ,b",), ("",)], "t string")
    assert [r[0] for r in df.select(serving.listed(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], []]
    serving.write_csv(spark.createDataFrame([("1", "")], "a string, b string"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", None)]
    w = spark.createDataFrame([([[1.0, 2.0], [3.0]],)], "c array<array<double>>").select(serving.waypoints(F.col("c"))).first()[0]
    assert w == [[2.0, 1.0]]
