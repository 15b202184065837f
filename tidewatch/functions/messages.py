"""What a distress message says, as column expressions. Patterns are plain classes, so other engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.geo import valid
from tidewatch.sources.dims import LANDMARKS

N = r"(-?[0-9]+\.?[0-9]*)"
D = r"(-?[0-9]{1,3}\.?[0-9]*)"
# Patterns and keywords whose matches must be the published ones. (pattern, any case, confidence, method)
PAIRS = (
    (rf"maps\.google\.com/\?q={N},{N}", False, 0.98, "shared_location"),
    (rf"maps\.google\.com/.*[?&]ll={N},{N}", False, 0.98, "shared_location"),
    (rf"google\.com/maps\?.*ll={N},{N}", False, 0.98, "shared_location"),
    (rf"@{N},{N}", False, 0.98, "shared_location"),
    (rf"[Pp]osition\s*[:=]\s*{N}\s*,\s*{N}", False, 0.92, "alarm_phone_format"),
    (rf"lat[itude]*\s*[:=]\s*{D}\s+lon[gitude]*\s*[:=]\s*{D}", True, 0.95, "decimal_labeled"),
)
SIGNED = rf"{D}\s*[°]?\s*([NS])\s+{D}\s*[°]?\s*([EW])"
PLAIN = r"(?:lat[:\s]*)?(-?[0-9]{1,3}\.[0-9]{3,})[,\s]+(?:lon[:\s]*)?(-?[0-9]{1,3}\.[0-9]{3,})"
MINUTES = r"([0-9]{1,3})[°\s]\s*([0-9]{1,2})['′\s]\s*([NS])\s+([0-9]{1,3})[°\s]\s*([0-9]{1,2})['′\s]\s*([EW])"
DISTANCE = r"([0-9]+)\s*(?:miglia|miles?|nm|nautical)"
TOWARDS = r"(?:verso|toward|direction)?\s*(nord|north|sud|south|est|east|ovest|west)"
COURSE = {"nord": 0.0, "north": 0.0, "est": 90.0, "east": 90.0, "sud": 180.0, "south": 180.0, "ovest": 270.0, "west": 270.0}
PERSONS = r"(?:about|more\s+than|at\s+least|circa|oltre|più\s+di|أكثر\s+من|environ)?\s*([0-9٠-٩]+)\s*(?:persons?|people|persone|شخص|أشخاص|personnes?|Personen)"
VESSELS = (
    ("rubber_boat", r"gommone|rubber\s*boat|zodiac|schlauchboot|canot\s*pneumatique|قارب\s*مطاطي|λαστιχένια"),
    ("wooden_boat", r"barca\s*legno|wooden\s*boat|barque\s*en\s*bois|قارب\s*خشبي"),
    ("sailboat", r"barca\s*a\s*vela|sailboat|voilier|شراعية"),
)
CONDITIONS = (
    ("sinking", r"affonda|sinking|يغرق|coule|βυθίζ|ist\s*am\s*sinken"),
    ("taking_water", r"acqua\s*dentro|taking\s*water|ماء\s*بالداخل|prend\s*l'eau|παίρνει\s*νερά"),
    ("engine_failure", r"motore\s*rotto|engine\s*(?:broken|failure|dead)|المحرك\s*معطل|moteur\s*en\s*panne"),
)
MEDICAL = r"medico|medical|حاجة\s*طبية|médical|urgenza|emergency|blessé|جريح"
CHILDREN = r"bambini|children|أطفال|enfants|kinder|παιδιά"
SATELLITE = rf"POSITION\s*:\s*{N}[NS]?/{N}[EW]?\s+(?:PERS\s*:\s*([0-9]+))?\s*(?:TYPE\s*:\s*([A-Za-z0-9_]+))?"
SATELLITE_TYPES = {"RB": "rubber_boat", "WB": "wooden_boat", "SB": "sailboat"}
TRUSTED_ACCOUNTS = ("alarm_phone", "seawatch_intl", "msf_sea", "sosmediterranee", "sos_humanity", "watchthemed")
TRUSTED_HASHTAGS = ("medrescue", "watchthemed", "mediterranean", "boatpeople", "refugeesatsea")

ANY = "(?iu)"  # any case, for letters of all scripts


def number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def found(lat: Column, lon: Column, sure, method: str) -> Column:
    return F.when(valid(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(sure).alias("confidence"), F.lit(method).alias("method")))


def side(text: Column, pattern: str, group: int, minus: str) -> Column:
    return F.when(F.upper(F.regexp_extract(text, pattern, group)) == minus, -1.0).otherwise(1.0)


def landmark(text: Column) -> Column:
    """At or off the first landmark of the list that the text names."""
    low = F.lower(text)
    off = F.regexp_extract(low, DISTANCE, 1).try_cast("double") * 1.852 / 111.32
    word = F.regexp_extract(low, TOWARDS, 1)
    course = F.lit(0.0)
    for name, degrees in COURSE.items():
        course = F.when(word == name, degrees).otherwise(course)
    rad, at = F.radians(course), F.lit(None)
    for name, lat, lon in reversed(LANDMARKS):
        at = F.when(low.contains(name), F.array(F.lit(lat), F.lit(lon))).otherwise(at)
    lat, lon, far = F.get(at, F.lit(0)), F.get(at, F.lit(1)), F.coalesce(off, F.lit(0.0))
    there = F.struct((lat + far * F.cos(rad)).alias("lat"), (lon + far * F.sin(rad) / F.cos(F.radians(lat))).alias("lon"), F.when(off.isNull(), 0.55).otherwise(0.60).alias("confidence"), F.lit("natural_language").alias("method"))
    return F.when(at.isNotNull(), there)


def coordinates(text: Column) -> Column:
    """struct(lat, lon, confidence, method) by the first pattern whose first match is a valid position."""
    tries = [found(number(text, (ANY if fold else "") + p, 1), number(text, (ANY if fold else "") + p, 2), sure, how) for p, fold, sure, how in PAIRS]
    signed, minutes = ANY + SIGNED, ANY + MINUTES
    tries.append(found(number(text, signed, 1) * side(text, signed, 2, "S"), number(text, signed, 3) * side(text, signed, 4, "W"), 0.95, "decimal_explicit"))
    tries.append(found(number(text, PLAIN, 1), number(text, PLAIN, 2), 0.95, "decimal_plain"))
    dm = lambda g, minus: (number(text, minutes, g) + number(text, minutes, g + 1) / 60) * side(text, minutes, g + 2, minus)
    tries.append(found(dm(1, "S"), dm(4, "W"), 0.90, "degrees_minutes"))
    none = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method"))
    return F.coalesce(*tries, landmark(text), none)


def persons(text: Column) -> Column:
    return F.translate(F.regexp_extract(text, ANY + PERSONS, 1), "٠١٢٣٤٥٦٧٨٩", "0123456789").try_cast("int")


def keyword(text: Column, table) -> Column:
    out = None
    for label, pattern in table:
        out = F.when(text.rlike(ANY + pattern), label) if out is None else out.when(text.rlike(ANY + pattern), label)
    return out


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(ANY + pattern), F.lit(False))
