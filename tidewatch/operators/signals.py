"""Distress signals from messages of several channels, and navigation sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions import messages as m
from tidewatch.operators import ordered
from tidewatch.operators.tracks import R
from tidewatch.sources.dims import LANDMARKS
from tidewatch.sources.fixtures import ctes, fixture

FIELDS = ("persons", "vessel_type", "vessel_condition", "medical_emergency", "children_aboard")


def extracted(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with what the body says: c (position), and the fields. A null body says nothing."""
    t = F.coalesce(F.col(body), F.lit(""))
    return rows.withColumns({"c": m.coordinates(t), "persons": m.persons(t), "vessel_type": m.keyword(t, m.VESSELS), "vessel_condition": m.keyword(t, m.CONDITIONS), "medical_emergency": m.says(t, m.MEDICAL), "children_aboard": m.says(t, m.CHILDREN)})


def signal(rows: DataFrame, lat: Column, lon: Column, sure: Column, method: Column, persons: Column | None = None, vessel: Column | None = None, *keep: str) -> DataFrame:
    return rows.select(
        "doc_id", "channel", geo.rounded(lat, 5).alias("lat"), geo.rounded(lon, 5).alias("lon"), geo.rounded(sure, 4).alias("confidence"), method.alias("method"), (F.col("persons") if persons is None else persons).alias("persons"),
        (F.col("vessel_type") if vessel is None else vessel).alias("vessel_type"), "vessel_condition", "medical_emergency", "children_aboard", (geo.rounded(sure, 4) < 0.70).alias("review"), *keep,
    )


def from_chat(rows: DataFrame) -> DataFrame:
    """A little surer when persons and vessel are both named; a shared position (share_lat, share_lon) goes first."""
    e = extracted(rows)
    sure = F.when((F.coalesce("persons", F.lit(0)) > 0) & F.col("vessel_type").isNotNull(), F.least(F.lit(1.0), F.col("c.confidence") + 0.05)).otherwise(F.col("c.confidence"))
    if "share_lat" not in rows.columns:
        return signal(e, F.col("c.lat"), F.col("c.lon"), sure, F.col("c.method"))
    shared = F.col("share_lat").isNotNull() & F.col("share_lon").isNotNull()
    pick = lambda a, b: F.when(shared, a).otherwise(b)
    return signal(e, pick(F.col("share_lat"), F.col("c.lat")), pick(F.col("share_lon"), F.col("c.lon")), pick(F.lit(0.98), sure), pick(F.lit("shared_location"), F.col("c.method")))


def from_sms(rows: DataFrame, signed: bool = False) -> DataFrame:
    """The satellite template first, by default without its hemispheres; transcripts are a little less sure."""
    e, t, p = extracted(rows), F.coalesce("body", F.lit("")), m.ANY + m.SATELLITE
    template = t.rlike(p)
    sign = lambda g, pattern, minus: m.side(t, m.ANY + pattern, g, minus) if signed else F.lit(1.0)
    hemi = m.SATELLITE.replace("[NS]?", "([NS]?)").replace("[EW]?", "([EW]?)")
    lat, lon = m.number(t, p, 1) * sign(2, hemi, "S"), m.number(t, p, 2) * sign(4, hemi, "W")
    code, vessel = F.upper(F.regexp_extract(t, p, 4)), F.lit(None).cast("string")
    for k, v in m.SATELLITE_TYPES.items():
        vessel = F.when(code == k, v).otherwise(vessel)
    pick = lambda a, b: F.when(template, a).otherwise(b)
    sure = F.greatest(F.lit(0.0), F.col("c.confidence") - F.when(t.rlike(r"(?i)^\[TRANSCRIPT\]"), 0.10).otherwise(0.0))
    return signal(e, pick(lat, F.col("c.lat")), pick(lon, F.col("c.lon")), pick(F.lit(0.97), sure), pick(F.lit("iridium"), F.col("c.method")), pick(F.regexp_extract(t, p, 3).try_cast("int"), F.col("persons")), pick(vessel, F.col("vessel_type")))


def from_bot(rows: DataFrame) -> DataFrame:
    """As the text says, or a shared position (share_lat, share_lon); forwarded from a trusted channel (column forwarded, its name or title), a little surer."""
    e = extracted(rows)
    trusted = F.lit(False)
    if "forwarded" in rows.columns:
        for name in m.TRUSTED_ACCOUNTS:
            trusted = trusted | F.coalesce(F.lower("forwarded").contains(name), F.lit(False))
    lat, lon, sure, method = F.col("c.lat"), F.col("c.lon"), F.col("c.confidence"), F.col("c.method")
    if "share_lat" in rows.columns:
        shared = F.col("share_lat").isNotNull() & F.col("share_lon").isNotNull()
        lat, lon, sure, method = (F.when(shared, x).otherwise(y) for x, y in ((F.col("share_lat"), lat), (F.col("share_lon"), lon), (F.lit(0.98), sure), (F.lit("shared_location"), method)))
    return signal(e, lat, lon, F.least(F.lit(1.0), sure + F.when(trusted, 0.05).otherwise(0.0)), method)


def from_microblog(rows: DataFrame) -> DataFrame:
    """At most 0.80; a repost counts only from or by a trusted author; trusted hashtags add 0.05 each, three at most."""
    e, t = extracted(rows), F.coalesce("body", F.lit(""))
    trusted = F.lower(F.coalesce("author", F.lit(""))).isin(*m.TRUSTED_ACCOUNTS)
    of = F.lower(F.regexp_extract(t, "^RT @([A-Za-z0-9_]+)", 1)).isin(*m.TRUSTED_ACCOUNTS)
    void = t.startswith("RT @") & ~of & ~trusted
    tags = F.size(F.array_intersect(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("#([A-Za-z0-9_]+)"), 1), F.lower)), F.array(*map(F.lit, m.TRUSTED_HASHTAGS))))
    sure = F.least(F.lit(0.80), F.col("c.confidence") + F.when(trusted, 0.10).otherwise(0.0) + F.least(F.lit(0.15), tags * 0.05))
    keep = lambda c: F.when(~void, c)
    e = e.withColumns({f: keep(F.col(f)) for f in FIELDS[:3]} | {f: F.coalesce(keep(F.col(f)), F.lit(False)) for f in FIELDS[3:]})
    return signal(e, keep(F.col("c.lat")), keep(F.col("c.lon")), F.when(void, 0.0).otherwise(sure), F.when(void, "none").otherwise(F.col("c.method")))


def from_webhook(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Signals of JSON payloads (doc_id, channel, payload, received_at): the position as lat and lon, in an object named position, or as the text says.

    Numbers may be strings. A position that is given but is none falls back to the text. Fields that are given go before
    what the text says; medical_emergency and children_aboard hold if either says so. A time without a zone is UTC; one
    that does not parse gives way to received_at.
    """
    j = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names])
    here, text = F.col(payload).isNotNull(), F.coalesce(j("text", "message", "body", "raw_text"), F.lit(""))
    flat = F.coalesce(F.array_contains(F.json_object_keys(payload), "lat") & F.array_contains(F.json_object_keys(payload), "lon"), F.lit(False))
    number = lambda a, *b: F.when(flat, j(a).try_cast("double")).otherwise(j(*b).try_cast("double"))
    lat, lon = number("lat", "position.latitude", "position.lat"), number("lon", "position.longitude", "position.lon")
    given = here & lat.isNotNull() & lon.isNotNull()
    iso = j("timestamp_utc", "timestamp")
    at = F.coalesce(F.try_to_timestamp(F.when(iso.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))), F.col("received_at"))
    true = lambda name: ~F.coalesce(j(name), F.lit("false")).isin("false", "0", "0.0", "[]", "{}")
    e = extracted(rows.withColumns({"body": text, "channel": F.coalesce(j("source_channel", "source"), F.lit("webhook")), "at": at}))
    e = e.withColumns({"vessel_condition": F.coalesce(j("vessel_condition"), "vessel_condition"), "medical_emergency": true("medical_emergency") | F.col("medical_emergency"), "children_aboard": true("children_aboard") | F.col("children_aboard")})
    pick = lambda a, b: F.when(given, a).otherwise(b)
    return signal(e, pick(lat, F.col("c.lat")), pick(lon, F.col("c.lon")), pick(F.lit(0.95), F.col("c.confidence")), pick(F.lit("webhook_explicit"), F.col("c.method")), F.coalesce(j("persons").try_cast("double").cast("int"), "persons"), F.coalesce(j("vessel_type"), "vessel_type"), "at")


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


kw_sql = lambda table: "CASE " + " ".join(f"WHEN regexp_matches(body, {q('(?i)' + p)}) THEN '{k}'" for k, p in table) + " END"
says_sql = lambda p: f"regexp_matches(body, {q('(?i)' + p)})"


def _extracted_sql(rows: str) -> str:
    """c: what the bodies of rows (doc_id, channel, body and further columns) say, columns ending in 0."""
    ex = lambda p, g: f"try_cast(nullif(regexp_extract(body, {q(p)}, {g}), '') AS DOUBLE)"
    tries = [(ex(("(?i)" if f else "") + p, 1), ex(("(?i)" if f else "") + p, 2), s, h) for p, f, s, h in m.PAIRS]
    sg = lambda p, g, x: f"CASE WHEN upper(regexp_extract(body, {q('(?i)' + p)}, {g})) = '{x}' THEN -1 ELSE 1 END"
    tries.append((f"{ex('(?i)' + m.SIGNED, 1)} * {sg(m.SIGNED, 2, 'S')}", f"{ex('(?i)' + m.SIGNED, 3)} * {sg(m.SIGNED, 4, 'W')}", 0.95, "decimal_explicit"))
    tries.append((ex(m.PLAIN, 1), ex(m.PLAIN, 2), 0.95, "decimal_plain"))
    dm = lambda g, x: f"({ex('(?i)' + m.MINUTES, g)} + {ex('(?i)' + m.MINUTES, g + 1)} / 60) * {sg(m.MINUTES, g + 2, x)}"
    tries.append((dm(1, "S"), dm(4, "W"), 0.90, "degrees_minutes"))
    cols = ", ".join(f"{a} AS a{i}, {b} AS b{i}" for i, (a, b, _, _) in enumerate(tries))
    ok = lambda i: f"(a{i} BETWEEN -90 AND 90 AND b{i} BETWEEN -180 AND 180)"
    marks = " ".join(f"WHEN lower(body) LIKE '%{n}%' THEN {k}" for k, (n, _, _) in enumerate(LANDMARKS))
    land = f"""LEFT JOIN (VALUES {", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (_, a, b) in enumerate(LANDMARKS))}) AS l(k, la, lo) ON l.k = mark"""
    angle = f"radians(CASE regexp_extract(lower(body), {q(m.TOWARDS)}, 1) " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in m.COURSE.items()) + " ELSE 0e0 END)"
    off = f"(try_cast(nullif(regexp_extract(lower(body), {q(m.DISTANCE)}, 1), '') AS DOUBLE) * 1.852e0 / 111.32e0)"
    pos = lambda f, last: "CASE " + " ".join(f"WHEN {ok(i)} THEN {f(i)}" for i in range(len(tries))) + f" {last} END"
    persons = f"try_cast(nullif(translate(regexp_extract(body, {q('(?i)' + m.PERSONS)}, 1), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '') AS INT)"
    kw, says = kw_sql, says_sql
    return f"""t AS (SELECT *, {cols}, CASE {marks} END AS mark, {angle} AS th, {off} AS far FROM {rows}),
c AS (SELECT *, {pos(lambda i: f"a{i}", "WHEN mark IS NOT NULL THEN la + coalesce(far * cos(th), 0)")} AS lat0, {pos(lambda i: f"b{i}", "WHEN mark IS NOT NULL THEN lo + coalesce(far * sin(th) / cos(radians(la)), 0)")} AS lon0,
 {pos(lambda i: f"{tries[i][2]}e0", "WHEN mark IS NOT NULL THEN CASE WHEN far IS NULL THEN 0.55e0 ELSE 0.6e0 END ELSE 0e0")} AS sure0, {pos(lambda i: f"'{tries[i][3]}'", "WHEN mark IS NOT NULL THEN 'natural_language' ELSE 'none'")} AS method0, {persons} AS persons0, {kw(m.VESSELS)} AS vessel0,
 {kw(m.CONDITIONS)} AS condition0, {says(m.MEDICAL)} AS medical0, {says(m.CHILDREN)} AS children0, channel = 'sms' AND {says(m.SATELLITE)} AS sat FROM t {land})"""


def _oracle() -> str:
    sat = lambda g: f"regexp_extract(body, {q('(?i)' + m.SATELLITE)}, {g})"
    return f"""{ctes("distress_messages")}, {_extracted_sql("distress_messages")},
f AS (SELECT *, CASE WHEN sat THEN 0.97e0 WHEN channel = 'sms' THEN greatest(0e0, sure0 - CASE WHEN regexp_matches(body, '(?i)^\\[TRANSCRIPT\\]') THEN 0.1e0 ELSE 0e0 END) WHEN channel = 'whatsapp' AND persons0 > 0 AND vessel0 IS NOT NULL THEN least(1e0, sure0 + 0.05e0) ELSE sure0 END AS sure FROM c)
SELECT doc_id, channel, {R(f"CASE WHEN sat THEN CAST({sat(1)} AS DOUBLE) ELSE lat0 END", 5)} AS lat, {R(f"CASE WHEN sat THEN CAST({sat(2)} AS DOUBLE) ELSE lon0 END", 5)} AS lon, {R("sure", 4)} AS confidence, CASE WHEN sat THEN 'iridium' ELSE method0 END AS method,
 CASE WHEN sat THEN try_cast(nullif({sat(3)}, '') AS INT) ELSE persons0 END AS persons, CASE WHEN sat THEN CASE upper({sat(4)}) WHEN 'RB' THEN 'rubber_boat' WHEN 'WB' THEN 'wooden_boat' WHEN 'SB' THEN 'sailboat' END ELSE vessel0 END AS vessel_type,
 condition0 AS vessel_condition, medical0 AS medical_emergency, children0 AS children_aboard, {R("sure", 4)} < 0.7 AS review FROM f"""


BLOG = {"body": "CASE WHEN doc_id % 15 = 0 THEN 'RT @Alarm_Phone ' || body WHEN doc_id % 5 = 0 THEN 'RT @someone ' || body ELSE body || ' #MedRescue #boatpeople #x #medrescue' END", "author": "CASE WHEN doc_id % 4 = 0 THEN 'alarm_phone' WHEN doc_id % 7 = 0 THEN NULL ELSE 'someone' END"}


def blog(s, p: str) -> DataFrame:
    """The messages as posts: reposts of trusted and other authors, hashtags, own authors."""
    return fixture(s, p, "distress_messages").withColumns({c: F.expr(x) for c, x in BLOG.items()})


def _microblog_oracle() -> str:
    names = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    keep = lambda c: f"CASE WHEN NOT void THEN {c} END"
    return f"""{ctes("distress_messages")}, b AS (SELECT doc_id, channel, {BLOG["body"]} AS body, {BLOG["author"]} AS author FROM distress_messages), {_extracted_sql("b")},
w AS (SELECT *, list_contains({names(m.TRUSTED_ACCOUNTS)}, lower(coalesce(author, ''))) AS trusted, list_contains({names(m.TRUSTED_ACCOUNTS)}, lower(regexp_extract(body, '^RT @([A-Za-z0-9_]+)', 1))) AS of_trusted,
 len(list_intersect(list_distinct(list_transform(regexp_extract_all(body, '#([A-Za-z0-9_]+)', 1), lambda x: lower(x))), {names(m.TRUSTED_HASHTAGS)})) AS tags FROM c),
v AS (SELECT *, body LIKE 'RT @%' AND NOT of_trusted AND NOT trusted AS void, least(0.8e0, sure0 + CASE WHEN trusted THEN 0.1e0 ELSE 0e0 END + least(0.15e0, tags * 0.05e0)) AS sure1 FROM w),
s AS (SELECT *, CASE WHEN void THEN 0e0 ELSE sure1 END AS sure FROM v)
SELECT doc_id, channel, {R(keep("lat0"), 5)} AS lat, {R(keep("lon0"), 5)} AS lon, {R("sure", 4)} AS confidence, CASE WHEN void THEN 'none' ELSE method0 END AS method, {keep("persons0")} AS persons, {keep("vessel0")} AS vessel_type, {keep("condition0")} AS vessel_condition,
 NOT void AND medical0 AS medical_emergency, NOT void AND children0 AS children_aboard, {R("sure", 4)} < 0.7 AS review FROM s"""


SHARED = {"share_lat": "CASE WHEN doc_id % 4 = 1 THEN 35.125D END", "share_lon": "CASE WHEN doc_id % 8 IN (1, 3) THEN 14.25D END", "forwarded": "CASE doc_id % 5 WHEN 0 THEN 'Alarm_Phone updates' WHEN 1 THEN 'somebody' END"}


def signals_shared(s, p: str) -> DataFrame:
    """Chat and bot messages with shared positions and channels they were forwarded from."""
    rows = fixture(s, p, "distress_messages").withColumns({c: F.expr(x) for c, x in SHARED.items()})
    return from_chat(rows.filter("channel = 'whatsapp'")).unionByName(from_bot(rows.filter("channel = 'telegram'")))


def _shared_oracle() -> str:
    columns = ", ".join(f"{x.replace('D END', 'e0 END')} AS {c}" for c, x in SHARED.items())
    trusted = " OR ".join(f"coalesce(lower(forwarded) LIKE '%{n.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}', false)" for n in m.TRUSTED_ACCOUNTS)
    return f"""{ctes("distress_messages")}, b AS (SELECT *, {columns} FROM distress_messages WHERE channel <> 'sms'), {_extracted_sql("b")},
g AS (SELECT *, share_lat IS NOT NULL AND share_lon IS NOT NULL AS shared FROM c),
f AS (SELECT *, CASE WHEN channel = 'telegram' THEN least(1e0, CASE WHEN shared THEN 0.98e0 ELSE sure0 END + CASE WHEN {trusted} THEN 0.05e0 ELSE 0e0 END) WHEN shared THEN 0.98e0 WHEN persons0 > 0 AND vessel0 IS NOT NULL THEN least(1e0, sure0 + 0.05e0) ELSE sure0 END AS sure FROM g)
SELECT doc_id, channel, {R("CASE WHEN shared THEN share_lat ELSE lat0 END", 5)} AS lat, {R("CASE WHEN shared THEN share_lon ELSE lon0 END", 5)} AS lon, {R("sure", 4)} AS confidence, CASE WHEN shared THEN 'shared_location' ELSE method0 END AS method,
 persons0 AS persons, vessel0 AS vessel_type, condition0 AS vessel_condition, medical0 AS medical_emergency, children0 AS children_aboard, {R("sure", 4)} < 0.7 AS review FROM f"""


def posted(s, p: str) -> DataFrame:
    """The messages as payloads of a webhook, in the shapes that it takes and with fields that are none."""
    rows, kind = fixture(s, p, "distress_messages"), F.col("doc_id") % 5
    body = F.col("body")
    flat = F.struct(F.lit(35.5).alias("lat"), F.lit("12.5").alias("lon"), body.alias("text"), F.lit("ngocall").alias("source"), F.lit("2024-01-01T10:00:00").alias("timestamp"))
    nested = F.struct(F.struct(F.lit("36.25").alias("latitude"), F.lit(13.75).alias("longitude")).alias("position"), body.alias("message"), F.lit(True).alias("medical_emergency"), F.lit("2024-01-01T10:00:00+02:00").alias("timestamp_utc"))
    free = F.struct(F.lit("").alias("text"), body.alias("body"), F.lit("7").alias("persons"), F.lit("yacht").alias("vessel_type"), F.lit("sinking").alias("vessel_condition"), F.lit(False).alias("children_aboard"))
    odd = F.struct(F.lit("north").alias("lat"), F.lit(12).alias("lon"), body.alias("raw_text"), F.lit("soon").alias("timestamp"))
    payload = F.when(kind == 0, F.to_json(flat)).when(kind == 1, F.to_json(nested)).when(kind == 2, F.to_json(free)).when(kind == 3, F.to_json(odd))
    return rows.select("doc_id", "channel", payload.alias("payload"), F.expr("timestamp'2024-02-02 00:00:00Z'").alias("received_at"))


def _webhook_oracle() -> str:
    given = "k IN (0, 1)"
    return f"""{ctes("distress_messages")}, b AS (SELECT doc_id, 'webhook' AS channel, CASE WHEN doc_id % 5 = 4 THEN '' ELSE body END AS body, doc_id % 5 AS k FROM distress_messages), {_extracted_sql("b")},
v AS (SELECT *, CASE WHEN {given} THEN 0.95e0 ELSE sure0 END AS sure FROM c)
SELECT doc_id, CASE WHEN k = 0 THEN 'ngocall' ELSE 'webhook' END AS channel, {R("CASE k WHEN 0 THEN 35.5e0 WHEN 1 THEN 36.25e0 ELSE lat0 END", 5)} AS lat, {R("CASE k WHEN 0 THEN 12.5e0 WHEN 1 THEN 13.75e0 ELSE lon0 END", 5)} AS lon, {R("sure", 4)} AS confidence,
 CASE WHEN {given} THEN 'webhook_explicit' ELSE method0 END AS method, CASE WHEN k = 2 THEN 7 ELSE persons0 END AS persons, CASE WHEN k = 2 THEN 'yacht' ELSE vessel0 END AS vessel_type, CASE WHEN k = 2 THEN 'sinking' ELSE condition0 END AS vessel_condition,
 medical0 OR k = 1 AS medical_emergency, children0 AS children_aboard, {R("sure", 4)} < 0.7 AS review, CASE k WHEN 0 THEN 1704103200 WHEN 1 THEN 1704096000 ELSE 1706832000 END AS at_s FROM v"""


def signals(rows: DataFrame) -> DataFrame:
    """Each message by its channel."""
    by = lambda c: rows.filter(F.col("channel") == c)
    return from_chat(by("whatsapp")).unionByName(from_sms(by("sms"))).unionByName(from_bot(by("telegram")))


def degrees(value: Column, hemisphere: Column) -> Column:
    """ddmm.m or dddmm.m by hemisphere; null when blank."""
    cut = F.when(hemisphere.isin("N", "S"), 2).otherwise(3)
    d, mi = F.substr(value, F.lit(1), cut).try_cast("double"), F.substr(value, cut + 1).try_cast("double")
    return F.when((value != "") & (hemisphere != ""), (d + mi / 60) * F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0))


def nmea_events(rows: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Position fixes of RMC and GGA sentences and raw tracks of AIS sentences; anything else gives no row."""
    s = F.trim(F.coalesce(F.col(sentence), F.lit("")))
    rows = rows.withColumn("f", F.split(s, ",")).withColumn("kind", F.right(F.get("f", F.lit(0)), F.lit(3)))
    f = lambda i: F.get("f", F.lit(i))
    num = lambda i: F.when(f(i) != "", f(i).try_cast("double"))
    rmc = s.startswith("$") & (F.col("kind") == "RMC") & (F.size("f") >= 9) & (f(2) == "A")
    gga = s.startswith("$") & (F.col("kind") == "GGA") & (F.size("f") >= 10) & ~f(6).isin("", "0")
    raw = (s.startswith("!AIVDM") | s.startswith("!AIVDO")) & (F.size("f") >= 6)
    at = lambda a, b: F.when(rmc, degrees(f(a), f(a + 1))).when(gga, degrees(f(b), f(b + 1)))
    clock = F.when(F.length(f(1)) >= 6, F.substring(f(1), 1, 2).try_cast("int") * 3600 + F.substring(f(1), 3, 2).try_cast("int") * 60 + F.floor(F.substr(f(1), F.lit(5)).try_cast("double")).cast("int"))
    return rows.filter(rmc | gga | raw).select(
        "seq", F.when(raw, "vessel_track").otherwise("position_fix").alias("event_type"), F.when(raw, "raw_ais_received").when(rmc, "valid").otherwise("fix").alias("status"), F.when(~raw, clock).alias("second_of_day"),
        geo.rounded(at(3, 2), 6).alias("lat"), geo.rounded(at(5, 4), 6).alias("lon"), F.when(rmc, num(7)).alias("speed"), F.when(rmc, num(8)).alias("course"), F.when(gga, num(9)).alias("altitude"), F.when(raw, f(4)).alias("channel"), F.when(raw, f(5)).alias("payload"),
    )


F_ = lambda i: f"f[{i + 1}]"
deg_sql = lambda v, h: f"(CAST(substring({v}, 1, CASE WHEN {h} IN ('N', 'S') THEN 2 ELSE 3 END) AS DOUBLE) + CAST(substring({v}, CASE WHEN {h} IN ('N', 'S') THEN 3 ELSE 4 END) AS DOUBLE) / 60) * CASE WHEN {h} IN ('S', 'W') THEN -1 ELSE 1 END"
NMEA = f"""{ctes("nmea_lines")}, s AS (SELECT seq, sentence, string_split(sentence, ',') AS f FROM nmea_lines),
k AS (SELECT *, f[1] LIKE '$%RMC' AND len(f) >= 9 AND f[3] = 'A' AS rmc, f[1] LIKE '$%GGA' AND len(f) >= 10 AND f[7] NOT IN ('', '0') AS gga, sentence LIKE '!AIVD%' AND len(f) >= 6 AS raw FROM s)
SELECT seq, CASE WHEN raw THEN 'vessel_track' ELSE 'position_fix' END AS event_type, CASE WHEN raw THEN 'raw_ais_received' WHEN rmc THEN 'valid' ELSE 'fix' END AS status,
 CASE WHEN NOT raw THEN CAST(substring(f[2], 1, 2) AS INT) * 3600 + CAST(substring(f[2], 3, 2) AS INT) * 60 + CAST(substring(f[2], 5, 2) AS INT) END AS second_of_day,
 {R(f"CASE WHEN rmc THEN {deg_sql(F_(3), F_(4))} WHEN gga THEN {deg_sql(F_(2), F_(3))} END", 6)} AS lat, {R(f"CASE WHEN rmc THEN {deg_sql(F_(5), F_(6))} WHEN gga THEN {deg_sql(F_(4), F_(5))} END", 6)} AS lon,
 CASE WHEN rmc THEN try_cast(f[8] AS DOUBLE) END AS speed, CASE WHEN rmc THEN try_cast(f[9] AS DOUBLE) END AS course, CASE WHEN gga THEN try_cast(f[10] AS DOUBLE) END AS altitude, CASE WHEN raw THEN f[5] END AS channel, CASE WHEN raw THEN f[6] END AS payload
FROM k WHERE rmc OR gga OR raw"""


def nmea_state(rows: DataFrame, span: int = 1000) -> DataFrame:
    """The newest value of each field after every span sentences of a feed: heading and speed by VTG, HDT, HDG and VHW."""
    f = F.split("sentence", ",")
    kind, at = F.substr(F.get(f, F.lit(0)), F.lit(4)), lambda i: F.when(F.get(f, F.lit(i)) != "", F.get(f, F.lit(i)).try_cast("double"))
    heading = F.when(kind.isin("VTG", "HDT", "HDG"), at(1))
    speed = F.when(kind == "VTG", at(7) / 1.852).when(kind == "VHW", at(5))
    r = rows.filter(F.col("sentence").startswith("$")).select("seq", heading.alias("heading"), speed.alias("speed"), F.floor(F.col("seq") / span).alias("span"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    ends = r.groupBy("span").agg(last("heading").alias("heading"), last("speed").alias("speed"))
    newest = {c: F.when(F.col(c).isNotNull(), F.struct("span", c)) for c in ("heading", "speed")}
    held = ordered.running_max(ends.withColumn("feed", F.lit(0)), "feed", ("span",), last_heading=newest["heading"], last_speed=newest["speed"])
    return held.select("span", F.col("last_heading.heading").alias("heading"), geo.rounded(F.col("last_speed.speed"), 4).alias("speed_kn"))


STATE = f"""{ctes("nmea_lines")}, r AS (SELECT seq, seq // 1000 AS span, CASE WHEN sentence LIKE '$GPVTG%' THEN try_cast(split_part(sentence, ',', 2) AS DOUBLE) END AS heading, CASE WHEN sentence LIKE '$GPVTG%' THEN try_cast(split_part(sentence, ',', 8) AS DOUBLE) / 1.852e0 END AS speed FROM nmea_lines WHERE sentence LIKE '$%')
SELECT span, arg_max(heading, seq) AS heading, {R("arg_max(speed, seq)", 4)} AS speed_kn FROM r GROUP BY span"""


def tail(rows: DataFrame, n: int = 50, newest_first: bool = True, most: int = 500) -> DataFrame:
    """The last n rows of a log by seq."""
    last = rows.orderBy(F.desc("seq")).limit(max(1, min(n, most)))
    return last if newest_first else last.orderBy("seq")


QUERIES = {
    "signals": (lambda s, p: signals(fixture(s, p, "distress_messages")), _oracle()),
    "signals_shared": (signals_shared, _shared_oracle()),
    "signals_microblog": (lambda s, p: from_microblog(blog(s, p)), _microblog_oracle()),
    "signals_webhook": (lambda s, p: from_webhook(posted(s, p)).withColumn("at_s", F.unix_seconds("at")).drop("at"), _webhook_oracle()),
    "nmea_events": (lambda s, p: nmea_events(fixture(s, p, "nmea_lines")), NMEA),
    "nmea_state": (lambda s, p: nmea_state(fixture(s, p, "nmea_lines")), STATE),
    "log_tail": (lambda s, p: tail(fixture(s, p, "vessel_events"), 50).select("seq", "vessel_id", "event_kind"), f"{ctes('vessel_events')} SELECT seq, vessel_id, event_kind FROM vessel_events ORDER BY seq DESC LIMIT 50"),
}
