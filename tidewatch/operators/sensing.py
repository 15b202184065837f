"""Aircraft, weather, radio, waveforms, ionosphere, and their correlation into threats."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo, sea
from tidewatch.operators import ordered
from tidewatch.operators.ranges import first_within, near_join
from tidewatch.operators.tracks import R
from tidewatch.sources import dims
from tidewatch.sources.fixtures import ctes, fixture
from tidewatch.sources.storage import stored


def emitted(rows: DataFrame, columns: list[str], rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """A row for each rule that holds: columns, anomaly_type, confidence."""
    each = F.array(*[F.when(when, F.struct(F.lit(kind).alias("anomaly_type"), sure.alias("confidence"))) for when, kind, sure in rules])
    return rows.select(*columns, F.inline(F.filter(each, lambda x: x.isNotNull())))


def military(icao: Column, ranges=dims.MILITARY) -> Column:
    v = F.when(icao.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(icao, 16, 10).cast("long"))
    return F.coalesce(reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in ranges]), F.lit(False))


def near_airport(lat: Column, lon: Column, degrees: float = 0.83) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [(F.abs(lat - a) < degrees) & (F.abs(lon - b) < degrees) for a, b in dims.AIRPORTS]), F.lit(False))


def no_squawk() -> Column:
    return (F.coalesce("squawk", F.lit("")) == "") & (F.coalesce("callsign", F.lit("")) != "")


def adsb_rules(rows: DataFrame) -> DataFrame:
    low = (F.col("alt_ft") > 0) & (F.col("alt_ft") < 500) & ~near_airport(F.col("lat"), F.col("lon"))
    rules = [(low, "low_altitude", F.lit(0.80)), (military(F.col("icao")), "military_pattern", F.lit(0.75)), (no_squawk(), "no_transponder", F.lit(0.60))]
    return emitted(rows.filter(F.coalesce("icao", F.lit("")) != ""), ["rec_id"], rules)


AIRPORT = " OR ".join(f"(abs(lat - {a}) < 0.83 AND abs(lon - {b}) < 0.83)" for a, b in dims.AIRPORTS)
mil_sql = lambda ranges: "(" + " OR ".join(f"CAST('0x' || icao AS BIGINT) BETWEEN {a} AND {b}" for a, b in ranges) + ")"
ADSB = f"""{ctes("aircraft")} SELECT rec_id, 'low_altitude' AS anomaly_type, 0.8e0 AS confidence FROM aircraft WHERE alt_ft > 0 AND alt_ft < 500 AND NOT ({AIRPORT})
UNION ALL SELECT rec_id, 'military_pattern', 0.75e0 FROM aircraft WHERE {mil_sql(dims.MILITARY)}
UNION ALL SELECT rec_id, 'no_transponder', 0.6e0 FROM aircraft WHERE squawk = '' AND callsign <> ''"""


def low_conflicts(rows: DataFrame, conflicts: DataFrame, km: float = 200.0, most: int = 5) -> DataFrame:
    """Low aircraft with up to five conflicts within km, smallest ids first. Aircraft at one place meet the same ones."""
    low = rows.filter((F.col("alt_ft") > 0) & (F.col("alt_ft") < 500)).select("rec_id", "lat", "lon")
    close = geo.planar(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"), 111.0) <= km
    met = first_within(low, conflicts, ("lat", "lon"), ("latitude", "longitude"), "conflict_id", km / 111.0, close, most)
    met = low.join(met.hint("merge"), ["lat", "lon"])
    return met.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("conflict_id"))).filter(F.col("n") <= most).select("rec_id", "conflict_id", "n")


CONFLICTS = """c AS (SELECT a.rec_id, f.conflict_id, CAST(row_number() OVER (PARTITION BY a.rec_id ORDER BY f.conflict_id) AS INT) AS n FROM aircraft a, conflict_events f
  WHERE a.alt_ft > 0 AND a.alt_ft < 500 AND sqrt((f.latitude - a.lat) * (f.latitude - a.lat) + (f.longitude - a.lon) * (f.longitude - a.lon)) * 111e0 <= 200)"""


def formations(rows: DataFrame, nm: float = 1.0, turn: float = 5.0, wrap: bool = False) -> DataFrame:
    """Pairs of a poll within nm of each other and on like tracks; wrap compares tracks across north.

    Without wrap, rows also meet by bands of tracks, six turns wide; the other of a pair is in the bands that it is within a turn of.
    """
    other = rows.select(F.col("rec_id").alias("other_id"), "poll_no", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("track").alias("o_track"))
    off = F.abs(F.col("track") - F.col("o_track"))
    off = F.least(off, 360 - off) if wrap else off
    exact = (F.col("rec_id") < F.col("other_id")) & (geo.planar(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"), 60.0) < nm) & (off < turn)
    own, on = rows.select("rec_id", "poll_no", "lat", "lon", "track"), ("poll_no",)
    if not wrap:
        band = lambda track: F.floor(track / (6 * turn))
        own, on = own.withColumn("_band", band(F.col("track"))), ("poll_no", "_band")
        other = other.withColumn("_band", F.explode(F.sequence(band(F.col("o_track") - turn), band(F.col("o_track") + turn))))
    return near_join(own, other, ("lat", "o_lat"), ("lon", "o_lon"), nm / 60.0, exact, on=on).select("rec_id", "other_id", "poll_no")


FORMATION = "p AS (SELECT a.rec_id, b.rec_id AS other_id, a.poll_no FROM aircraft a JOIN aircraft b ON a.poll_no = b.poll_no AND a.rec_id < b.rec_id WHERE sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) * 60e0 < 1 AND abs(a.track - b.track) < 5)"


def traffic_rules(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    n = low_conflicts(rows, conflicts).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = formations(rows).select(F.explode(F.array("rec_id", "other_id")).alias("rec_id")).distinct().withColumn("paired", F.lit(True))
    r = rows.join(n.hint("merge"), "rec_id", "left").join(pairs.hint("merge"), "rec_id", "left")
    low = (F.col("alt_ft") > 0) & (F.col("alt_ft") < 500)
    sure = 0.75 + F.least(F.lit(0.15), 0.03 * F.coalesce("n", F.lit(0)))
    rules = [(low, "low_altitude", geo.rounded(sure, 4)), (military(F.col("icao"), dims.MILITARY[:2]), "military_pattern", F.lit(0.75)), (no_squawk() & (F.col("alt_ft") < 5000), "no_transponder", F.lit(0.60)), (F.coalesce("paired", F.lit(False)), "formation", F.lit(0.70))]
    return emitted(r, ["rec_id"], rules)


TRAFFIC = f"""{ctes("aircraft", "conflict_events")}, {CONFLICTS}, {FORMATION}
SELECT rec_id, 'low_altitude' AS anomaly_type, {R("0.75e0 + least(0.15e0, 0.03e0 * (SELECT count(*) FROM c WHERE c.rec_id = aircraft.rec_id))", 4)} AS confidence FROM aircraft WHERE alt_ft > 0 AND alt_ft < 500
UNION ALL SELECT rec_id, 'military_pattern', 0.75e0 FROM aircraft WHERE {mil_sql(dims.MILITARY[:2])}
UNION ALL SELECT rec_id, 'no_transponder', 0.6e0 FROM aircraft WHERE squawk = '' AND callsign <> '' AND alt_ft < 5000
UNION ALL SELECT rec_id, 'formation', 0.7e0 FROM aircraft WHERE rec_id IN (SELECT rec_id FROM p UNION SELECT other_id FROM p)"""


def disappeared(rows: DataFrame, poll_s: int = 60, silent_s: int = 120) -> DataFrame:
    """Aircraft last seen more than silent_s before the newest poll, by their last position, away from airports."""
    last = rows.groupBy("icao").agg(F.max("poll_no").alias("poll_no"), F.max_by("lat", F.struct("poll_no", "rec_id")).alias("lat"), F.max_by("lon", F.struct("poll_no", "rec_id")).alias("lon"))
    now = rows.agg(F.max("poll_no").alias("now"))
    gone = last.crossJoin(F.broadcast(now)).filter(((F.col("now") - F.col("poll_no")) * poll_s > silent_s) & (F.coalesce("lat", F.lit(0.0)) != 0) & ~near_airport(F.col("lat"), F.col("lon")))
    return gone.select("icao", F.lit("disappeared").alias("anomaly_type"), F.lit(0.65).alias("confidence"))


def weather_rules(rows: DataFrame) -> DataFrame:
    kts = F.col("wind_ms") * 1.944
    rules = [(kts > 40, "STORM", F.lit(0.90)), (~(kts > 40) & (kts > 25) & (F.col("wave_m") > 2.5), "SAR", F.lit(0.90)), (F.col("visibility_m") < 500, "LOW_VISIBILITY", F.lit(0.90))]
    return emitted(rows, ["obs_id"], rules)


def weather_derived(rows: DataFrame) -> DataFrame:
    """What follows from an observation; absent values take the defaults 5 m/s, 270 degrees, 1 m, and 18 degrees."""
    w, d, h, t = (F.coalesce(c, F.lit(v)) for c, v in (("wind_ms", 5.0), ("wind_dir_deg", 270.0), ("wave_m", 1.0), ("water_temp_c", 18.0)))
    force, hours = sea.beaufort(w), sea.survival_hours(t)
    speed, direction = sea.drift(w, d)
    return rows.select(
        "obs_id", force.alias("beaufort"), sea.beaufort_label(force).alias("beaufort_label"), sea.compass(d).alias("compass"), geo.rounded(hours, 4).alias("survival_h"), sea.sea_state(h).alias("sea_state"),
        geo.rounded(3 + 2.5 * h, 1).alias("wave_period_s"), geo.rounded(speed, 4).alias("drift_ms"), geo.rounded(direction, 4).alias("drift_deg"), ((h > 2.0) | (force >= 6) | (hours < 6)).alias("sar_conditions"),
    )


def case(x: str, steps, last) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {q(v)}" for b, v in steps) + f" ELSE {q(last)} END"


SURVIVAL = "CASE " + " ".join(f"WHEN {{t}} <= {t1}e0 THEN {h0}e0 + ({{t}} - {t0}e0) / {t1 - t0}e0 * {h1 - h0}e0" for (t0, h0), (t1, h1) in zip(sea.SURVIVAL, sea.SURVIVAL[1:])) + " END"
survival_sql = lambda t: SURVIVAL.format(t=f"greatest(0e0, least({t}, 30e0))")
DERIVED = f"""{ctes("weather_obs")}, b AS (SELECT *, {case("wind_ms", [(x, i) for i, x in enumerate(sea.BEAUFORT)], 12)} AS beaufort, {survival_sql("water_temp_c")} AS hours FROM weather_obs)
SELECT obs_id, beaufort, [{", ".join(f"'{x}'" for x in sea.BEAUFORT_LABELS)}][beaufort + 1] AS beaufort_label, [{", ".join(f"'{x}'" for x in sea.COMPASS)}][CAST(floor((wind_dir_deg + 11.25) / 22.5) AS INT) % 16 + 1] AS compass,
 {R("hours", 4)} AS survival_h, {case("wave_m", sea.SEA_STATES, "High")} AS sea_state, {R("3 + 2.5e0 * wave_m", 1)} AS wave_period_s, {R("0.035e0 * wind_ms + 0.15e0", 4)} AS drift_ms, {R("fmod(wind_dir_deg + 195, 360e0)", 4)} AS drift_deg,
 (wave_m > 2.0 OR beaufort >= 6 OR hours < 6) AS sar_conditions FROM b"""


def weather_grid(spark, south: float, west: float, north: float, east: float, n: int) -> DataFrame:
    """n * n points over a box, both ends included; n from 3 to 10."""
    n = max(3, min(10, n))
    axis = lambda a, b, c: geo.rounded(F.lit(a) + (F.lit(b) - F.lit(a)) * F.col(c) / (n - 1), 3)
    ids = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    return ids.select("i", "j", axis(south, north, "i").alias("lat"), axis(west, east, "j").alias("lon"))


def blocked(rows: DataFrame, key: str, order: str, halo: int, size: int = 0) -> DataFrame:
    """rows of each key in blocks of size by order, a whole number, each with the halo rows before it (own is false for these), so that no frame of halo rows needs a whole series in one task.

    A block has four times the halo unless size says otherwise. A row's rank is the count of the ranges of order before its own, which are few and small, and its place in its own.
    """
    size = size or max(1024, 4 * halo)
    if halo > size:
        raise ValueError("a halo reaches into one block only")
    ranged = rows.withColumn("range", F.floor(F.col(order) / size))
    counts = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n_range"))
    before = F.sum("n_range").over(Window.partitionBy(key).orderBy("range")) - F.col("n_range")
    starts = counts.select(key, "range", before.alias("n_before"))
    place = F.row_number().over(Window.partitionBy(key, "range").orderBy(order)) - 1
    ranked = ranged.withColumn("rank", place).join(starts, [key, "range"]).withColumn("rank", F.col("rank") + F.col("n_before"))
    block = F.floor(F.col("rank") / size)
    own, next_ = F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    dealt = F.when(F.col("rank") % size >= size - halo, F.array(own, next_)).otherwise(F.array(own))
    return ranked.select(*rows.columns, F.inline(dealt))


def sliding(rows: DataFrame, key: str, order: str, frame: int, **values: tuple[str, Column]) -> DataFrame:
    """rows of blocked() with each value ("sum" or "max", column) over the frame rows up to and including a row, or as many as its block has.

    A block is cut into segments as long as the frame: what a frame covers is the end of one segment and the beginning
    of the next, so running sums and maxima from both sides of a segment give it. The cost of a row does not depend on
    the frame, and nothing is subtracted, so loud samples leave no error behind.
    """
    ahead = Window.partitionBy(key, "block").orderBy(order)
    rows = rows.withColumn("_place", F.row_number().over(ahead) - 1).withColumn("_segment", F.floor(F.col("_place") / frame))
    begun, ended = (Window.partitionBy(key, "block", "_segment").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order)))
    made = {"sum": F.sum, "max": F.max}
    rows = rows.withColumns({f"_end_{n}": made[f](v).over(ended) for n, (f, v) in values.items()}).withColumns({f"_begin_{n}": made[f](v).over(begun) for n, (f, v) in values.items()})
    rows = rows.withColumns({f"_end_{n}": F.lag(f"_end_{n}", frame - 1).over(ahead) for n in values})
    met = {"sum": lambda x, y: x + F.coalesce(y, F.lit(0.0)), "max": lambda x, y: F.greatest(x, y)}
    whole = F.col("_place") % frame == frame - 1
    return rows.withColumns({n: F.when(whole, F.col(f"_begin_{n}")).otherwise(met[f](F.col(f"_begin_{n}"), F.col(f"_end_{n}"))) for n, (f, _) in values.items()}).drop("_segment", *[f"_{x}_{n}" for n in values for x in ("begin", "end")])


def sta_lta(rows: DataFrame, short: int = 100, long: int = 3000, ratio: float = 3.5) -> DataFrame:
    """Samples at which the short energy stands out from that of a full long window. Samples without a value are left out, here and below."""
    x2, rows = F.col("value") * F.col("value"), rows.filter(F.col("value").isNotNull())
    at = blocked(rows.select("sensor_id", "sample_no", "value"), "sensor_id", "sample_no", long - 1)
    at = sliding(sliding(at, "sensor_id", "sample_no", long, lta=("sum", x2)).drop("_place"), "sensor_id", "sample_no", short, sta=("sum", x2))
    r = (F.col("sta") / short) / (F.col("lta") / long + F.lit(1e-10))
    return at.filter(F.col("own") & (F.col("_place") >= long - 1) & (r >= ratio)).select("sensor_id", "sample_no", geo.rounded(r, 3).alias("ratio"))


STA = f"""{ctes("waveform_samples")}, w AS (SELECT sensor_id, sample_no, avg(value * value) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 99 PRECEDING) AS sta, avg(value * value) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 2999 PRECEDING) + 1e-10 AS lta,
 count(*) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 2999 PRECEDING) AS n FROM waveform_samples) SELECT sensor_id, sample_no, {R("sta / lta", 3)} AS ratio FROM w WHERE n = 3000 AND sta / lta >= 3.5"""


def spaced(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Greedy cooldown over whole numbers: keeps a row, then drops until gap after the last kept one. A fold by blocks; equal numbers of a key count once."""
    timed = ordered.ranked(rows.select(key, at).distinct(), key, at)
    kept = ordered.folded(ordered.apart(timed, key, at, gap), key).select(F.col(key).alias("_key"), F.col("rank").alias("_rank"))
    return timed.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank"))).select(key, at)


def infrasound_class(seconds: Column, peak: Column) -> Column:
    return F.when((seconds < 60) & (peak > 0.5), F.struct(F.lit("explosion").alias("kind"), F.lit(0.85).alias("confidence"))).when(seconds > 300, F.struct(F.lit("venting").alias("kind"), F.lit(0.75).alias("confidence"))).when(peak < 0.1, F.struct(F.lit("wind").alias("kind"), F.lit(0.60).alias("confidence"))).otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(0.40).alias("confidence")))


def infrasound_events(rows: DataFrame, rate: int = 100, cooldown_s: int = 30, long: int = 3000) -> DataFrame:
    """Triggers after the cooldown, classified by their length, which is the window's, and their peak."""
    kept = spaced(sta_lta(rows, long=long), "sensor_id", "sample_no", cooldown_s * rate)
    at = blocked(rows.filter(F.col("value").isNotNull()).select("sensor_id", "sample_no", "value"), "sensor_id", "sample_no", long - 1)
    peaks = sliding(at, "sensor_id", "sample_no", long, peak=("max", F.abs("value"))).filter("own").select("sensor_id", "sample_no", "peak")
    kind = infrasound_class(F.lit(long / rate), F.col("peak"))
    return kept.join(peaks, ["sensor_id", "sample_no"]).select("sensor_id", "sample_no", geo.rounded(F.col("peak"), 4).alias("peak"), kind["kind"].alias("kind"), kind["confidence"].alias("confidence"))


INFRA = f"""{ctes("waveform_samples").replace("WITH ", "WITH RECURSIVE ", 1)}, w AS (SELECT sensor_id, sample_no, avg(value * value) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 99 PRECEDING) AS sta, avg(value * value) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 2999 PRECEDING) + 1e-10 AS lta,
 count(*) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 2999 PRECEDING) AS n, max(abs(value)) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 2999 PRECEDING) AS peak FROM waveform_samples), t AS (SELECT * FROM w WHERE n = 3000 AND sta / lta >= 3.5),
k AS (SELECT sensor_id, min(sample_no) AS sample_no FROM t GROUP BY sensor_id UNION ALL SELECT k.sensor_id, (SELECT min(t.sample_no) FROM t WHERE t.sensor_id = k.sensor_id AND t.sample_no >= k.sample_no + 3000) FROM k WHERE k.sample_no IS NOT NULL)
SELECT sensor_id, sample_no, {R("peak", 4)} AS peak, CASE WHEN peak > 0.5 THEN 'explosion' WHEN peak < 0.1 THEN 'wind' ELSE 'unknown' END AS kind, CASE WHEN peak > 0.5 THEN 0.85e0 WHEN peak < 0.1 THEN 0.6e0 ELSE 0.4e0 END AS confidence FROM k JOIN t USING (sensor_id, sample_no)"""


def seismic_ratio(rows: DataFrame, half: int = 500, least: float = 0.005, stride: int = 1) -> DataFrame:
    """Energy of the first half of a window against the second."""
    x2 = F.col("value") * F.col("value")
    at = blocked(rows.filter(F.col("value").isNotNull()).select("sensor_id", "sample_no", "value"), "sensor_id", "sample_no", 2 * half - 1)
    at = sliding(sliding(at, "sensor_id", "sample_no", half, s=("sum", x2)).drop("_place"), "sensor_id", "sample_no", 2 * half, peak=("max", F.abs("value")))
    before = F.lag("s", half).over(Window.partitionBy("sensor_id", "block").orderBy("sample_no"))
    at = at.withColumn("r", before / (F.col("s") + F.lit(1e-10))).filter(F.col("own") & (F.col("_place") >= 2 * half - 1) & (F.col("peak") >= least) & (F.col("sample_no") % stride == 0))
    kind = F.when(F.col("r") > 10, "tectonic").when(F.col("r").between(3, 8), "explosion").otherwise("noise")
    sure = F.when(F.col("r") > 10, F.least(F.lit(0.90), 0.5 + 0.02 * F.col("r"))).when(F.col("r").between(3, 8), F.least(F.lit(0.85), 0.4 + 0.05 * F.col("r"))).otherwise(0.10)
    return at.select("sensor_id", "sample_no", kind.alias("kind"), geo.rounded(sure, 3).alias("confidence"))


SEISMIC = f"""{ctes("waveform_samples")}, w AS (SELECT sensor_id, sample_no, sum(value * value) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS BETWEEN 999 PRECEDING AND 500 PRECEDING) / (sum(value * value) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 499 PRECEDING) + 1e-10) AS r,
 max(abs(value)) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 999 PRECEDING) AS peak, count(*) OVER (PARTITION BY sensor_id ORDER BY sample_no ROWS 999 PRECEDING) AS n FROM waveform_samples)
SELECT sensor_id, sample_no, CASE WHEN r > 10 THEN 'tectonic' WHEN r BETWEEN 3 AND 8 THEN 'explosion' ELSE 'noise' END AS kind, {R("CASE WHEN r > 10 THEN least(0.9e0, 0.5e0 + 0.02e0 * r) WHEN r BETWEEN 3 AND 8 THEN least(0.85e0, 0.4e0 + 0.05e0 * r) ELSE 0.1e0 END", 3)} AS confidence FROM w WHERE n = 1000 AND peak >= 0.005"""


def tec_anomalies(rows: DataFrame, history: int = 864, key: str = "station") -> DataFrame:
    """z of a value against up to history - 1 before it, at least ten; a large one in calm conditions is a candidate."""
    rows = rows if key in rows.columns else rows.withColumn(key, F.lit("tec"))
    block = Window.partitionBy(key, "block")
    at = blocked(rows.filter(F.col("vtec").isNotNull()).select(key, "seq", "vtec", "kp"), key, "seq", history - 1).withColumn("off", F.col("vtec") - F.avg("vtec").over(block))  # from the block's mean, so that squares stay small
    at = sliding(at, key, "seq", history - 1, one=("sum", F.col("off")), two=("sum", F.col("off") * F.col("off")))
    n, earlier = F.least(F.col("_place"), F.lit(history - 1)), block.orderBy("seq")
    at = at.withColumn("n", n).withColumns({c: F.lag(c).over(earlier) for c in ("one", "two")}).filter("own AND n >= 10")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("two") - F.col("one") * F.col("one") / F.col("n")) / (F.col("n") - 1))
    z = at.withColumn("z", (F.col("off") - F.col("one") / F.col("n")) / (spread + 0.1)).filter(F.abs("z") > 2.5)
    sure = F.least(F.lit(0.90), 0.5 + F.abs("z") / 10)
    calm = (F.abs("z") > 4) & (F.col("kp") < 3)
    return z.select("seq", F.when(calm, "ballistic_candidate").otherwise("perturbation").alias("kind"), geo.rounded(F.col("z"), 3).alias("z"), geo.rounded(F.when(calm, F.least(F.lit(0.88), sure + 0.1)).otherwise(sure), 3).alias("confidence"))


TEC = f"""{ctes("tec_series")}, w AS (SELECT *, count(*) OVER f AS n, (vtec - avg(vtec) OVER f) / (stddev_samp(vtec) OVER f + 0.1e0) AS z FROM tec_series WINDOW f AS (ORDER BY seq ROWS BETWEEN 863 PRECEDING AND 1 PRECEDING)), c AS (SELECT *, abs(z) > 4 AND kp < 3 AS calm, least(0.9e0, 0.5e0 + abs(z) / 10) AS sure FROM w WHERE n >= 10 AND abs(z) > 2.5)
SELECT seq, CASE WHEN calm THEN 'ballistic_candidate' ELSE 'perturbation' END AS kind, {R("z", 3)} AS z, {R("CASE WHEN calm THEN least(0.88e0, sure + 0.1e0) ELSE sure END", 3)} AS confidence FROM c"""


def rf_bursts(rows: DataFrame, keep: float = 0.99, block: int = 512, least: float = 10.0) -> DataFrame:
    """Excess over each band's exponential mean before the sample; the mean starts at the band's first sample. Samples without a power are left out.

    A block of samples turns the mean before it into keep ** samples times that plus a sum. These maps are composed by
    doubling: after k steps a block's stands for 2 ** k blocks, until what is left of an earlier mean is below a
    double's precision. So no band is folded in one go, whatever keep is.
    """
    if not 0 < keep < 1:
        raise ValueError("keep is between 0 and 1")
    n = ordered.ranked(rows.filter(F.col("power_db").isNotNull()).select("event_id", "band_no", "seq", "power_db"), "band_no", "seq", "event_id")
    n = n.withColumn("block", F.floor(F.col("rank") / block)).withColumn("j", F.col("rank") % block)
    inner = Window.partitionBy("band_no", "block").orderBy("j")
    run = F.sum((1 - keep) * F.col("power_db") * F.pow(F.lit(keep), -1 - F.col("j"))).over(inner)
    n = n.withColumn("run", run).withColumn("after", F.col("run") * F.pow(F.lit(keep), F.col("j") + 1)).withColumn("before", F.coalesce(F.lag("run").over(inner), F.lit(0.0)) * F.pow(F.lit(keep), F.col("j")))
    maps = n.groupBy("band_no", "block").agg(F.max_by("after", "j").alias("b"), F.pow(F.lit(keep), F.max("j") + 1).alias("a"), F.min_by("power_db", "j").alias("first"))
    order = Window.partitionBy("band_no").orderBy("block")
    reach = math.ceil(50 / (block * -math.log(keep)))  # exp(-50) is less than a double's last digit
    for k in range(reach.bit_length()):
        maps = maps.withColumns({"a_": F.lag("a", 2**k).over(order), "b_": F.lag("b", 2**k).over(order)})
        maps = maps.select("band_no", "block", "first", (F.col("a") * F.coalesce("b_", F.lit(0.0)) + F.col("b")).alias("b"), (F.col("a") * F.coalesce("a_", F.lit(1.0))).alias("a"))
    started = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(F.lag("a").over(order), F.lit(1.0)) * started + F.coalesce(F.lag("b").over(order), F.lit(0.0))
    maps = maps.select(F.col("band_no").alias("_band"), F.col("block").alias("_block"), start.alias("start"))
    out = n.join(maps, F.col("band_no").eqNullSafe(F.col("_band")) & (F.col("block") == F.col("_block"))).withColumn("excess", F.col("power_db") - (F.col("start") * F.pow(F.lit(keep), F.col("j")) + F.col("before")))
    band = F.get(F.array(*[F.lit(b[2]) for b in dims.RF_BANDS]), F.col("band_no").cast("int"))
    kind = F.when(band.contains("drone_control") | band.contains("wifi_drone"), "drone_control").when(F.col("excess") > 20, "jamming").otherwise("unknown_burst")
    return out.filter(F.col("excess") >= least).select("event_id", band.alias("band"), kind.alias("kind"), geo.rounded(F.col("excess"), 4).alias("excess_db"), geo.rounded(F.least(F.lit(0.95), 0.5 + F.col("excess") / 30), 4).alias("confidence"))


RF = f"""{ctes("rf_power").replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT *, row_number() OVER (PARTITION BY band_no ORDER BY seq) AS i FROM rf_power),
e AS (SELECT band_no, i, event_id, power_db, power_db AS b FROM o WHERE i = 1 UNION ALL SELECT o.band_no, o.i, o.event_id, o.power_db, 0.99e0 * e.b + 0.01e0 * e.power_db FROM e JOIN o ON o.band_no = e.band_no AND o.i = e.i + 1),
x AS (SELECT event_id, [{", ".join(f"'{b[2]}'" for b in dims.RF_BANDS)}][band_no + 1] AS band, power_db - b AS excess FROM e)
SELECT event_id, band, CASE WHEN band LIKE '%drone_control%' OR band LIKE '%wifi_drone%' THEN 'drone_control' WHEN excess > 20 THEN 'jamming' ELSE 'unknown_burst' END AS kind, {R("excess", 4)} AS excess_db, {R("least(0.95e0, 0.5e0 + excess / 30)", 4)} AS confidence FROM x WHERE excess >= 10"""


STORM_S = 10_800  # how long a storm report holds


def gated(rows: DataFrame, kp: DataFrame | None = None, least: float = 0.50) -> DataFrame:
    """Events that count: all but ionospheric ones that are not confident or come while a storm (kp over 4 at the last report, less than three hours old) is on. kp: t_s, kp. Only ionospheric events are sorted by time, in pieces."""
    ionospheric = F.col("channel").isin("sensors:ionospheric", "ionosphere:anomalies")
    rows = rows.filter(~F.coalesce(ionospheric, F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) >= least))
    if kp is None:
        return rows
    other, asked = rows.filter(~F.coalesce(ionospheric, F.lit(False))), rows.filter(ionospheric)
    reports = kp.filter("kp IS NOT NULL AND t_s IS NOT NULL").select(F.col("t_s").alias("_t"), F.lit(0).alias("_asks"), F.col("kp").cast("double").alias("_kp"))
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    both = asked.select(F.col("t_s").alias("_t"), F.lit(1).alias("_asks"), row.alias("_row")).unionByName(reports, allowMissingColumns=True).withColumn("_all", F.lit(0))
    last = ordered.running_max(both, "_all", ("_t", "_asks", "_kp"), _last=F.when(F.col("_asks") == 0, F.struct("_t", "_kp")))
    storm = F.coalesce((F.col("_last._kp") > 4) & (F.col("_t") - F.col("_last._t") < STORM_S), F.lit(False))
    return last.filter((F.col("_asks") == 1) & ~storm).select("_row.*").unionByName(other)


def scores(rows: DataFrame, window_s: int = 120) -> DataFrame:
    """At each arrival, the weights of the distinct sensor types of its platform in the window."""
    w = Window.partitionBy("platform_id").orderBy("t_s").rangeBetween(1 - window_s, 0)
    kind = dims.looked_up(F.col("channel"), dims.SENSOR)
    typed = rows.withColumn("sensor", kind)
    total = F.lit(0)
    for name, weight in dims.WEIGHT.items():
        total = total + F.max(F.when(F.col("sensor") == name, weight).otherwise(0)).over(w)
    return typed.select("event_id", "platform_id", "t_s", "sensor", total.alias("weight"))


KIND = "CASE channel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.SENSOR.items()) + " END"
SCORES = f"""{ctes("sensor_events")}, t AS (SELECT *, {KIND} AS sensor FROM sensor_events) SELECT event_id, platform_id, t_s, sensor, CAST({" + ".join(f"max(CASE WHEN sensor = '{k}' THEN {v} ELSE 0 END) OVER w" for k, v in dims.WEIGHT.items())} AS INT) AS weight FROM t WINDOW w AS (PARTITION BY platform_id ORDER BY t_s RANGE BETWEEN 119 PRECEDING AND CURRENT ROW)"""


def threat_kind(types: Column, weight: Column) -> Column:
    has = lambda t: F.array_contains(types, t)
    return F.when(has("ionospheric") & (has("infrasound") | has("seismic")) & (weight >= dims.URGENT), "ballistic_confirmed").when(has("adsb") & has("infrasound") & (weight >= dims.ALERT), "drone_attack_candidate").when(has("ais_anomaly") & has("gnss_spoof") & (weight >= dims.ALERT), "vessel_spoofing_confirmed").otherwise("physical_threat_candidate")


def threats(rows: DataFrame, window_s: int = 120) -> DataFrame:
    """Fused events: once the weight of the sensor types in the window reaches the alert level, an event goes out and the window starts empty.

    Only the newest event of each type counts. With these by descending time, an event goes out if the last one that
    did came before the one whose weight completes the alert level: a limit on the last rank kept, so that blocks of a
    platform are folded apart (ordered.folded), however busy it is.
    """
    kinds = sorted(set(dims.SENSOR.values()))
    typed = rows.withColumn("sensor", dims.looked_up(F.col("channel"), dims.SENSOR)).select("platform_id", "event_id", "t_s", "sensor")
    at = ordered.ranked(typed, "platform_id", "t_s", "event_id", sorted_too=True)
    newest = {f"{x}_{i}": F.when(F.col("sensor") == k, F.col(c)) for i, k in enumerate(kinds) for x, c in (("r", "rank"), ("t", "t_s"))}
    last = F.array(*[F.struct(F.col(f"r_{i}").alias("rank"), F.col(f"t_{i}").alias("t"), F.lit(dims.WEIGHT.get(k, 0)).alias("weight"), F.lit(k).alias("sensor")) for i, k in enumerate(kinds)])
    held = F.filter(last, lambda x: x["t"] > F.col("t_s") - window_s)
    seen = stored(ordered.running_max(at, "platform_id", ("rank",), **newest).select("platform_id", "event_id", "t_s", "rank", F.sort_array(held, asc=False).alias("held")))
    empty = F.struct(F.lit(0).alias("weight"), F.lit(None).cast("long").alias("rank"))
    full = F.aggregate("held", empty, lambda a, x: F.when(a["weight"] >= dims.ALERT, a).otherwise(F.struct((a["weight"] + x["weight"]).alias("weight"), x["rank"].alias("rank"))))
    kept = ordered.folded(seen.withColumn("f", full).select("platform_id", "rank", F.when(F.col("f.weight") >= dims.ALERT, F.col("f.rank") - 1).alias("limit")), "platform_id")
    kept = kept.select(F.col("platform_id").alias("_key"), F.col("rank").alias("_rank"), "previous")
    out = seen.join(kept, F.col("platform_id").eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank")))
    out = out.withColumn("new", F.filter("held", lambda x: x["rank"] > F.col("previous")))
    out = out.withColumn("types", F.sort_array(F.transform("new", lambda x: x["sensor"]))).withColumn("weight", F.aggregate("new", F.lit(0), lambda a, x: a + x["weight"]))
    return out.select("platform_id", "event_id", "t_s", "weight", threat_kind(F.col("types"), F.col("weight")).alias("threat"), F.array_join("types", ",").alias("sources"), (F.col("weight") >= dims.URGENT).alias("urgent"))


WEIGH = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.WEIGHT.items()) + " ELSE 0 END"
HAS = "list_contains(types, '{}')".format
THREATS = f"""{ctes("sensor_events").replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT *, {KIND} AS sensor, row_number() OVER (PARTITION BY platform_id ORDER BY t_s, event_id) AS i FROM sensor_events),
f AS (SELECT platform_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t_s, CAST([] AS STRUCT(t BIGINT, s VARCHAR)[]) AS held, CAST([] AS VARCHAR[]) AS types, CAST(0 AS BIGINT) AS weight FROM (SELECT DISTINCT platform_id FROM o)
 UNION ALL SELECT platform_id, i, event_id, t_s, CASE WHEN weight >= {dims.ALERT} THEN [] ELSE held END, types, weight FROM (
  SELECT *, CAST(list_sum(list_transform(types, lambda s: {WEIGH})) AS BIGINT) AS weight FROM (SELECT *, list_sort(list_distinct(list_transform(held, lambda h: h.s))) AS types FROM (
   SELECT o.platform_id, o.i, o.event_id, o.t_s, list_append(list_filter(f.held, lambda h: o.t_s - h.t < 120), {{'t': o.t_s, 's': o.sensor}}) AS held FROM f JOIN o ON o.platform_id = f.platform_id AND o.i = f.i + 1))))
SELECT platform_id, event_id, t_s, CAST(weight AS INT) AS weight, array_to_string(types, ',') AS sources, weight >= {dims.URGENT} AS urgent,
 CASE WHEN {HAS("ionospheric")} AND ({HAS("infrasound")} OR {HAS("seismic")}) AND weight >= {dims.URGENT} THEN 'ballistic_confirmed' WHEN {HAS("adsb")} AND {HAS("infrasound")} THEN 'drone_attack_candidate'
  WHEN {HAS("ais_anomaly")} AND {HAS("gnss_spoof")} THEN 'vessel_spoofing_confirmed' ELSE 'physical_threat_candidate' END AS threat FROM f WHERE weight >= {dims.ALERT}"""
GATED = f"""{ctes("sensor_events", "tec_series")}, k AS (SELECT seq * 6 AS k_t, kp FROM tec_series WHERE kp IS NOT NULL)
SELECT event_id, channel FROM sensor_events ASOF LEFT JOIN k ON t_s >= k_t WHERE channel NOT IN ('sensors:ionospheric', 'ionosphere:anomalies') OR (confidence >= 0.5 AND NOT coalesce(kp > 4 AND t_s - k_t < {STORM_S}, false))"""

one = lambda name, f: lambda s, p: f(fixture(s, p, name))
QUERIES = {
    "adsb_rules": (one("aircraft", adsb_rules), ADSB),
    "traffic_conflicts": (lambda s, p: low_conflicts(fixture(s, p, "aircraft"), fixture(s, p, "conflict_events")), f"{ctes('aircraft', 'conflict_events')}, {CONFLICTS} SELECT * FROM c WHERE n <= 5"),
    "traffic_formations": (one("aircraft", formations), f"{ctes('aircraft')}, {FORMATION} SELECT * FROM p"),
    "traffic_rules": (lambda s, p: traffic_rules(fixture(s, p, "aircraft"), fixture(s, p, "conflict_events")), TRAFFIC),
    "aircraft_disappeared": (one("aircraft", disappeared), f"{ctes('aircraft')}, l AS (SELECT icao, max(poll_no) AS poll_no, arg_max(lat, poll_no * 10000000000 + rec_id) AS lat, arg_max(lon, poll_no * 10000000000 + rec_id) AS lon FROM aircraft GROUP BY icao) SELECT icao, 'disappeared' AS anomaly_type, 0.65e0 AS confidence FROM l WHERE ((SELECT max(poll_no) FROM aircraft) - poll_no) * 60 > 120 AND lat <> 0 AND NOT ({AIRPORT})"),
    "weather_rules": (one("weather_obs", weather_rules), f"{ctes('weather_obs')} SELECT obs_id, CASE WHEN wind_ms * 1.944e0 > 40 THEN 'STORM' ELSE 'SAR' END AS anomaly_type, 0.9e0 AS confidence FROM weather_obs WHERE wind_ms * 1.944e0 > 40 OR (wind_ms * 1.944e0 > 25 AND wave_m > 2.5) UNION ALL SELECT obs_id, 'LOW_VISIBILITY', 0.9e0 FROM weather_obs WHERE visibility_m < 500"),
    "weather_derived": (one("weather_obs", weather_derived), DERIVED),
    "weather_grid": (lambda s, p: weather_grid(s, 30.0, 6.0, 44.0, 36.0, 8), f"SELECT i, j, {R('30e0 + 14e0 * i / 7', 3)} AS lat, {R('6e0 + 30e0 * j / 7', 3)} AS lon FROM range(8) a(i), range(8) b(j)"),
    "waveform_sta_lta": (one("waveform_samples", sta_lta), STA),
    "infrasound_events": (one("waveform_samples", infrasound_events), INFRA),
    "seismic_ratio": (one("waveform_samples", seismic_ratio), SEISMIC),
    "tec_anomalies": (one("tec_series", tec_anomalies), TEC),
    "kp_storms": (one("tec_series", lambda r: r.filter("kp > 4").select("seq", geo.rounded(F.least(F.lit(0.95), (F.col("kp") - 4) / 5 + 0.6), 4).alias("confidence"))), f"{ctes('tec_series')} SELECT seq, {R('least(0.95e0, (kp - 4) / 5 + 0.6e0)', 4)} AS confidence FROM tec_series WHERE kp > 4"),
    "rf_bursts": (one("rf_power", rf_bursts), RF),
    "correlation_scores": (one("sensor_events", scores), SCORES),
    "correlation_threats": (one("sensor_events", threats), THREATS),
    "correlation_gated": (lambda s, p: gated(fixture(s, p, "sensor_events"), fixture(s, p, "tec_series").select((F.col("seq") * 6).alias("t_s"), "kp")).select("event_id", "channel"), GATED),
}
