"""State by key, bucketed tables, united channels, feeds and polls: against batch results, late rows and restarts."""

import json
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewatch.operators import sensing
from tidewatch.sources import feed
from tidewatch.streaming import channels, keyed, merge, poll, replay


def at(rows, column="t_s"):
    return rows.withColumn("ts", F.timestamp_seconds(column))


def test_storm_flag_lapses_and_survives_restarts(spark, tmp_path):
    """Reports and events over days, in slices, each a run of its own from the checkpoint: the same events as the batch gate."""
    r = random.Random(3)
    events = [(i, "sensors:ionospheric", r.randrange(400_000), 0.9) for i in range(400)]
    reports = [(r.randrange(400_000), r.choice([1.0, 3.9, 5.0, 8.0])) for _ in range(25)]
    e = at(spark.createDataFrame(events, "event_id long, channel string, t_s long, confidence double"))
    k = at(spark.createDataFrame(reports, "t_s long, kp double"))
    root = f"file://{tmp_path}"
    for begin in range(0, 400_000, 100_000):
        for name, rows in (("e", e), ("k", k)):
            rows.filter(F.col("t_s").between(begin, begin + 99_999)).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        out = replay.drained(keyed.gated(spark.readStream.schema(e.schema).parquet(f"{root}/e"), spark.readStream.schema(k.schema).parquet(f"{root}/k")), root)
    want = {x.event_id for x in sensing.gated(e.drop("ts"), k.drop("ts")).collect()}
    assert 0 < len(want) < 400
    got = [x.event_id for x in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_ring_survives_a_restart(spark, tmp_path):
    rows = [(k, i * 3 + k) for k in (1, 2, None) if k for i in range(40 * k)]
    df, root = spark.createDataFrame(rows, "k long, seq long"), f"file://{tmp_path}"
    for low in (0, 50, 100):
        df.filter(F.col("seq").between(low, low + 49)).coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = replay.drained(keyed.ring(replay.source(spark, df, f"{root}/in"), "k", 7), root)
    last = defaultdict(dict)
    for x in out.collect():
        last[x.k].setdefault(x.version, set()).add(x.seq)
    for k in (1, 2):
        seen = sorted(s for q, s in rows if q == k and s < 150)
        assert last[k][max(last[k])] == set(seen[-7:])
        assert all(len(v) <= 7 for v in last[k].values())


V = "mmsi string, name string, lat double, ts long, event_id long"


def size(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_merge_touches_only_its_buckets(spark, tmp_path):
    path, r, table = f"{tmp_path}/t", random.Random(1), {}
    into = merge.merge_into(f"file://{path}", V, "mmsi", ("ts", "event_id"), 32)
    written = []
    for number in range(5):
        rows = [(f"v{r.randrange(2000) if number == 0 else r.randrange(3)}", r.choice([None, f"n{i}"]), r.choice([None, float(i)]), r.randrange(100), number * 10_000 + i) for i in range(4000 if number == 0 else 30)]
        fresh = {}
        for m, n, lat, t, e in sorted(rows, key=lambda x: x[3:]):
            old = fresh.get(m, (None, None))
            fresh[m] = (n if n is not None else old[0], lat if lat is not None else old[1], t, e)
        for m, new in fresh.items():
            old = table.get(m, (None, None, -1, -1))
            first, second = (new, old) if new[2:] >= old[2:] else (old, new)
            table[m] = tuple(x if x is not None else y for x, y in zip(first, second))
        before = size(path)
        batch = spark.createDataFrame(rows, V)
        into(batch, number)
        written.append(sum(s for f, s in size(path).items() if f not in before))
        if number == 3:
            into(batch, number)  # the same batch once more
        got = {x.mmsi: (x.name, x.lat, x.ts, x.event_id) for x in merge.merged(spark, f"file://{path}", V).collect()}
        assert got == table
    assert max(written[1:]) < written[0] / 5
    assert len({f.split("/v=")[1].split("/")[0] for f in size(path)}) <= 4  # old versions of touched buckets are gone


def test_a_merge_that_broke_off_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/t"
    into = merge.merge_into(f"file://{path}", V, "mmsi", ("ts", "event_id"), 4)
    into(spark.createDataFrame([("a", "x", 1.0, 1, 1)], V), 0)
    into(spark.createDataFrame([("a", "y", 2.0, 2, 2)], V), 1)
    os.remove(f"{path}/v=1/_SUCCESS")
    assert [x.name for x in merge.merged(spark, f"file://{path}", V).collect()] == ["x"]
    into(spark.createDataFrame([("a", "y", 2.0, 2, 2)], V), 1)
    assert [x.name for x in merge.merged(spark, f"file://{path}", V).collect()] == ["y"]


def test_late_rows_of_united_channels_are_counted(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    when = lambda m: start + timedelta(minutes=m)
    a = [[(1, when(0)), (2, when(300))], [(3, when(5)), (4, when(600))]]  # 3 is late once both channels are at 300
    b = [[("x", 1.5, when(290))], [("y", None, when(610))]]
    s = [spark.createDataFrame(a[0], "id long, ts timestamp").schema, spark.createDataFrame(b[0], "k string, v double, ts timestamp").schema]
    for policy, dropped in ((True, 1), (False, 1)):
        root = f"file://{tmp_path}/{policy}"
        total = 0
        for i in (0, 1):
            spark.createDataFrame(a[i], s[0]).coalesce(1).write.mode("append").parquet(f"{root}/a")
            spark.createDataFrame(b[i], s[1]).coalesce(1).write.mode("append").parquet(f"{root}/b")
            sa, sb = (spark.readStream.schema(x).parquet(f"{root}/{n}") for x, n in zip(s, "ab"))
            one = channels.united([channels.channel(sa, "a", F.col("id"), F.col("ts"), F.col("id")), channels.channel(sb, "b", F.col("k"), F.col("ts"), F.lit(0))], slowest=policy)
            q = channels.counted(one, "1 hour").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
            q.awaitTermination()
            total += channels.late_rows(q)
        assert total == dropped
        got = Counter((x.channel, int(x.start.timestamp() - start.timestamp()) // 3600, x.n) for x in spark.read.parquet(f"{root}/out").collect())
        assert got[("a", 0, 1)] == 1 and got[("a", 5, 1)] == 1 and got[("b", 4, 1)] == 1


def message(kind, mmsi, lat=35.0, lon=13.0, **body):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "ShipName": " META ", "latitude": lat, "longitude": lon, "time_utc": "2024-01-01 10:00:00.123456789 +0000 UTC"}, "Message": {kind: body}})


LINES = [
    message("PositionReport", 247000001, Latitude=0, Longitude=13.5, Cog=360, Sog=102.3, TrueHeading=511),
    message("StandardClassBPositionReport", 2, Latitude=36.0, Longitude=14.0, Cog=10.5, Sog=3.2, TrueHeading=90),
    message("ExtendedClassBPositionReport", 3, Latitude=36.0, Longitude=14.0, Name=" EXT "),
    message("ShipStaticData", 4, Name="NAME  ", ImoNumber=9000000, Type=70, Destination=" PORT "),
    message("BaseStationReport", 5), message("PositionReport", ""), "not json", "[1]", '{"MessageType": 3}', "", message("PositionReport", 6, 60.0, 60.0),
]


def test_messages_of_a_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES))
    spark.dataSource.register(feed.Feed)
    load = lambda **o: spark.read.format("vessel_feed").options(path=str(tmp_path), **o).load()
    (tmp_path / "b.json").write_text("")
    rows = {x.mmsi: x for x in load().collect()}
    assert set(rows) == {"247000001", "2", "3", "4", "6"}
    one = rows["247000001"]
    assert (one.lat, one.lon, one.course, one.speed, one.heading, one["class"], one.ship_name) == (35.0, 13.5, None, None, None, "A", "META")
    assert (rows["2"]["class"], rows["2"].course, rows["3"].ship_name, rows["4"].ship_name, rows["4"].imo, rows["4"].ship_type, rows["4"].destination) == ("B", 10.5, "EXT", "NAME", 9000000, 70, "PORT")
    assert one.ts is not None
    assert {x.mmsi for x in load(box="34,12,37,15").collect()} == {"247000001", "2", "3", "4"}
    assert {x.mmsi for x in load(types="ShipStaticData").collect()} == {"4"}
    assert Counter(x.mmsi for x in load(span="50").collect()) == Counter(list(rows))  # lines longer than a span


def test_polls_of_a_growing_feed_lose_and_double_nothing(spark, tmp_path):
    spark.dataSource.register(feed.Feed)
    os.mkdir(tmp_path / "feed")
    stream = lambda: spark.readStream.format("vessel_feed").options(path=str(tmp_path / "feed"), span="300").load()
    root, seen = f"file://{tmp_path}/poll", []
    take = lambda p: sorted(int(x.mmsi) for x in p.take().collect())
    line = lambda i: message("PositionReport", i, Latitude=1.0, Longitude=1.0) + "\n"
    with open(tmp_path / "feed/001", "w") as f:
        f.write("".join(map(line, range(1, 11))) + line(11)[:40])  # the last line is still being written
    p = poll.Poll(stream(), root)
    assert take(p) == list(range(1, 11))
    p.done()
    with open(tmp_path / "feed/001", "a") as f:
        f.write(line(11)[40:] + line(12))
    p = poll.Poll(stream(), root)
    assert take(p) == [11, 12]  # and the consumer ends before it acknowledges
    with open(tmp_path / "feed/002", "w") as f:
        f.write(line(13))
    p = poll.Poll(stream(), root)
    assert take(p) == [11, 12, 13]
    p.done()
    p = poll.Poll(stream(), root)
    assert take(p) == seen == []


def test_gated_comes_in_batches_of_one_size(spark, small, monkeypatch):
    want, files, written = sorted(map(tuple, replay.stream_gated(spark, small).collect())), [], replay.drained
    monkeypatch.setattr(replay, "BATCH", 400)

    def seen(out, root, *more):
        files.extend(spark.read.parquet(f"{root}/{name}").groupBy(F.input_file_name()).count().collect() for name in ("events", "reports"))
        return written(out, root, *more)

    monkeypatch.setattr(replay, "drained", seen)
    assert want and sorted(map(tuple, replay.stream_gated(spark, small).collect())) == want
    assert len(files[1]) > 1 and max(x["count"] for f in files for x in f) <= 500
