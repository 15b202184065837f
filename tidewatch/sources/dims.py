"""Small lookup tables. Their values are fixed: results must share them with the published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHOKEPOINTS = (
    ("hormuz", "Strait of Hormuz", 25.5, 27.5, 55.5, 59.0),
    ("suez", "Suez Canal", 29.5, 32.5, 32.0, 33.0),
    ("bab_mandeb", "Bab el-Mandeb", 11.5, 13.5, 42.5, 44.5),
    ("gibraltar", "Strait of Gibraltar", 35.5, 36.5, -6.5, -4.5),
    ("sicily", "Sicily Channel", 36.0, 38.5, 10.5, 13.5),
    ("messina", "Strait of Messina", 37.8, 38.5, 15.2, 16.0),
)
ZONE = "id string, name string, min_lat double, max_lat double, min_lon double, max_lon double"
#: The same four numbers of each zone read as latitude first and as longitude first.
DARK_ZONES = {"as_coded": ((23.5, 28.0, 37.0, 42.0), (10.0, 16.0, 30.0, 36.0)), "swapped": ((37.0, 42.0, 23.5, 28.0), (30.0, 36.0, 10.0, 16.0))}  # min_lat, max_lat, min_lon, max_lon
MAX_SPEED, ANY_SPEED, LEAST_SPEED = {"cargo": 30.0, "tanker": 20.0, "passenger": 35.0, "fishing": 20.0, "tug": 15.0, "sailing": 18.0}, 50.0, 55.0
SENSOR = {
    "infrasound:events": "infrasound", "seismic:events": "seismic", "hydro:events": "hydrophone", "adsb:anomalies": "adsb", "ais:anomalies": "ais_anomaly",
    "sensors:ionospheric": "ionospheric", "ionosphere:anomalies": "ionospheric", "gnss:anomalies": "gnss_spoof", "traffic:anomalies": "traffic", "weather:alerts": "weather", "sdr:anomalies": "adsb",
}
WEIGHT = {"infrasound": 28, "seismic": 22, "hydrophone": 12, "adsb": 10, "ais_anomaly": 8, "ionospheric": 8, "gnss_spoof": 7, "traffic": 5}  # per cent
ALERT, URGENT = 55, 80
MILITARY = ((0x3C0000, 0x3CFFFF), (0xAE0000, 0xAEFFFF), (0x43C000, 0x43CFFF))
AIRPORTS = ((35.857, 14.477), (37.700, 12.588), (37.467, 15.066), (40.651, 14.291))
RF_BANDS = ((433.0, 434.0, "drone_control_433"), (868.0, 868.5, "drone_control_868"), (915.0, 915.5, "drone_control_915"), (2400.0, 2483.5, "wifi_drone_24ghz"), (5725.0, 5875.0, "wifi_drone_58ghz"), (1090.0, 1090.5, "adsb"), (156.0, 174.0, "vhf_marine"))
SHIP_TYPES = (
    (20, 29, "WING_IN_GROUND"), (30, 31, "FISHING"), (31, 32, "TOWING"), (33, 34, "DREDGING"), (35, 35, "DIVING"), (36, 36, "MILITARY"), (37, 37, "SAILING"), (38, 39, "PLEASURE"), (40, 49, "HSC"),
    (50, 55, "PILOT"), (56, 57, "SAR"), (58, 58, "TUG"), (59, 59, "PORT_TENDER"), (60, 69, "PASSENGER"), (70, 79, "CARGO"), (80, 89, "TANKER"), (90, 99, "OTHER"),
)
ASSETS = (("ALAN_KURDI", 35.88, 12.5, 12.0, 48.0, "vessel"), ("OCEAN_VIKING", 37.5, 14.0, 14.0, 72.0, "vessel"), ("FRONTEX_HEL_1", 35.9, 14.51, 90.0, 6.0, "helicopter"))
LEEWAY_TYPE = {"person_in_water": 26, "rubber_boat": 38, "fishing_vessel": 52, "wooden_boat": 46, "sailboat": 26}
LANDMARKS = (
    ("lampedusa", 35.507, 12.611), ("malta", 35.899, 14.514), ("sicily", 37.6, 14.0), ("sicilia", 37.6, 14.0), ("tunisia", 34.0, 9.0), ("libya", 25.0, 17.0), ("libia", 25.0, 17.0), ("tripoli", 32.9, 13.2), ("benghazi", 32.1, 20.07),
    ("crete", 35.2, 24.9), ("creta", 35.2, 24.9), ("greece", 39.0, 22.0), ("grecia", 39.0, 22.0), ("lesvos", 39.2, 26.3), ("lesbos", 39.2, 26.3), ("turkey", 39.0, 35.0), ("turchia", 39.0, 35.0),
)


def chokepoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHOKEPOINTS, ZONE)


def assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSETS, "asset_id string, a_lat double, a_lon double, speed_kn double, endurance_h double, asset_type string")


def looked_up(key, table: dict, default=None):
    """A value of a small table as an expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def values(rows, names: str) -> str:
    """A table for DuckDB."""
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") AS v({names})"
