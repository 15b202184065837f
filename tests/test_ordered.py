"""Folds, ranks and running maxima of long series against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest
from plain import Fusion
from pyspark.sql import functions as F

from tidewatch.operators import ordered, sensing, tracks


def fold(limits):
    kept, last = [], -1
    for rank, limit in enumerate(limits):
        if limit is not None and last <= limit:
            kept.append((rank, last))
            last = rank
    return kept


@pytest.mark.parametrize("block,fan", [(8192, 256), (16, 4), (5, 2)])
def test_fold_is_a_loop(spark, block, fan, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", fan)
    r = random.Random(block)
    keys = {k: [r.choice([None, r.randrange(-1, i), r.randrange(max(-1, i - 9), i), i - 1]) if i else r.choice([-1, None]) for i in range(n)] for k, n in ((None, 90), (1, 1), (2, 700), (3, 333), (4, 5))}
    keys[5] = [max(-1, i - 40) for i in range(900)]  # far back, and never more than one in forty
    keys[6] = [-1] * 600
    rows = spark.createDataFrame([(k, i, x) for k, l in keys.items() for i, x in enumerate(l)], "k long, rank long, limit long").repartition(7)
    got = defaultdict(list)
    for x in ordered.folded(rows, "k", block).collect():
        got[x.k].append((x["rank"], x.previous))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(l) for k, l in keys.items() if fold(l)}


def test_ranks_and_running_maxima(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2]), r.randrange(50), i, r.choice([None, r.randrange(1000)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long").repartition(11)
    out = ordered.running_max(ordered.ranked(df, "k", "t", "id"), "k", ("rank",), best=F.col("v"), last=F.when(F.col("v") > 900, F.col("rank")))
    want = {}
    for k in (None, 1, 2):
        best = last = None
        for rank, x in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: x[1:3])):
            if x[3] is not None:
                best = max(x[3], best if best is not None else -1)
                last = rank if x[3] > 900 else last
            want[x[2]] = (rank, best, last)
    assert {x.id: (x["rank"], x.best, x.last) for x in out.collect()} == want


def test_a_vessel_without_silence(spark):
    """A million positions of one vessel, five seconds apart, at a throttle of a minute: every twelfth stays, and no task sees more than a few blocks."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("247000001").alias("mmsi"), F.col("id").alias("event_id"), (F.col("id") * 5).alias("t_s"))
    out = tracks.throttled(rows, 60.0, at="t_s")
    assert out.agg(F.count(F.lit(1)), F.sum("event_id"), F.max(F.col("event_id") % 12)).first() == (-(-n // 12), sum(range(0, n, 12)), 0)
    blocks = ordered.ranked(rows, "mmsi", "t_s").groupBy(F.floor(F.col("rank") / ordered.BLOCK)).count()
    assert blocks.agg(F.max("count")).first()[0] <= ordered.BLOCK


def test_throttle_with_ties_and_nulls(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randrange(400), r.randrange(400)])) for i in range(900)]
    want = Counter()
    for k in ("a", "b", None):
        last = None
        for m, i, t in sorted((x for x in rows if x[0] == k and x[2] is not None), key=lambda x: (x[2], x[1])):
            if last is None or t - last >= 30:
                last = t
                want[(m, i)] += 1
    df = spark.createDataFrame(rows, "mmsi string, event_id long, t_s long")
    assert Counter(tuple(x) for x in tracks.throttled(df, 30.0, at="t_s").collect()) == want
    timed = df.select("mmsi", "event_id", F.timestamp_seconds("t_s").alias("ts"))
    assert Counter(tuple(x) for x in tracks.throttled(timed, 30.0).collect()) == want


@pytest.mark.parametrize("block", [8192, 8])
def test_threats_of_a_busy_platform(spark, block, monkeypatch):
    """Several events a second without a silence, ties in time, sensors without weight and unknown channels."""
    monkeypatch.setattr(ordered, "BLOCK", block)
    r, channels = random.Random(6), [*sensing.dims.SENSOR, "unheard"]
    rows = [(r.choice([1, 1, 1, 2]), i, r.choice([i // 3, i // 3, i * 9]), r.choice(channels)) for i in range(1500)]
    want = Counter()
    for p in (1, 2):
        fusion = Fusion([])
        for _, e, t, c in sorted((x for x in rows if x[0] == p), key=lambda x: (x[2], x[1])):
            if c in sensing.dims.SENSOR and (found := fusion.add(t, sensing.dims.SENSOR[c])):
                want[(p, e, t, found["weight"], found["sources"])] += 1
    df = spark.createDataFrame(rows, "platform_id long, event_id long, t_s long, channel string")
    assert Counter((x.platform_id, x.event_id, x.t_s, x.weight, x.sources) for x in sensing.threats(df).collect()) == want


def test_python_is_given_few_blocks_at_a_time(spark, monkeypatch):
    seen, conf = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    stored, before = ordered.stored, spark.conf.get(conf)
    monkeypatch.setattr(ordered, "stored", lambda df: seen.append((spark.conf.get(conf), "EvalPython" in df._jdf.queryExecution().executedPlan().toString())) or stored(df))
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("rank"), (F.floor(F.col("id") / 2) - 3).alias("limit"))
    kept = ordered.folded(rows, "k", 4)
    assert {tuple(x) for x in kept.collect()} == {(k, r, r - 3 if r > 2 else -1) for k in (0, 1) for r in range(2, 50, 3)}
    assert {n for n, python in seen if python} == {str(ordered.AT_ONCE)} and spark.conf.get(conf) == before


def test_what_a_fold_keeps_is_not_broadcast(spark):
    """Every row stays: the kept ranks are as many as the rows, and their files are a small part of that."""
    rows = spark.range(200_000).select((F.col("id") % 50).cast("string").alias("mmsi"), F.col("id").alias("event_id"), (F.col("id") * 60).alias("t_s"))
    events = rows.select((F.col("event_id") % 2).alias("platform_id"), "event_id", "t_s", F.lit("seismic:events").alias("channel"))
    found = tracks.throttled(rows, 60.0, at="t_s")
    for out in (found, sensing.spaced(rows, "mmsi", "t_s", 60), sensing.threats(events)):
        assert re.search(r"\w+Join", out._jdf.queryExecution().executedPlan().toString())[0] == "SortMergeJoin"
    assert found.distinct().count() == 200_000
