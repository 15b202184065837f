"""Weather, sea state and survival as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.geo import modulo

# Fixed values that results must share with the published tables and labels.
BEAUFORT = (0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7)
BEAUFORT_LABELS = ("Calma", "Bava", "Brezza", "Brezza leggera", "Brezza moderata", "Brezza fresca", "Brezza forte", "Vento forte", "Burrasca moderata", "Burrasca forte", "Tempesta", "Tempesta violenta", "Uragano")
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO")
SEA_STATES = ((0.1, "Glassy"), (0.5, "Rippled"), (1.25, "Slight"), (2.5, "Moderate"), (4.0, "Rough"), (6.0, "Very rough"))
SURVIVAL = ((0.0, 0.5), (5.0, 1.0), (10.0, 2.0), (15.0, 6.0), (20.0, 12.0), (25.0, 24.0), (30.0, 40.0))  # water degrees C, hours
CONDITIONS = (("sinking", 0.40), ("taking_water", 0.65), ("engine_failure", 0.85))
URGENCY = ((0.80, "ROUTINE"), (0.50, "ELEVATED"), (0.20, "URGENT"))


def stepped(x: Column, steps, last) -> Column:
    """The label of the first step whose bound is above x."""
    out = None
    for bound, label in steps:
        out = F.when(x < bound, label) if out is None else out.when(x < bound, label)
    return out.otherwise(last)


def beaufort(ms: Column) -> Column:
    return stepped(ms, [(b, i) for i, b in enumerate(BEAUFORT)], 12)


def beaufort_label(force: Column) -> Column:
    return F.get(F.array(*map(F.lit, BEAUFORT_LABELS)), F.least(force, F.lit(12)))


def compass(degrees: Column) -> Column:
    return F.get(F.array(*map(F.lit, COMPASS)), F.pmod(F.floor((degrees + 11.25) / 22.5), F.lit(16)).cast("int"))


def sea_state(wave: Column) -> Column:
    return stepped(wave, SEA_STATES, "High")


def survival_hours(water: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(water, F.lit(30.0)))
    out = F.lit(SURVIVAL[0][1])
    for (t0, h0), (t1, h1) in zip(SURVIVAL, SURVIVAL[1:]):
        out = F.when(t >= t0, h0 + (t - t0) / (t1 - t0) * (h1 - h0)).otherwise(out)
    return out


def survival_probability(hours, water, wind, wave, condition, medical, children) -> Column:
    """exp(-hours / effective hours): the base time by waves, cooling, the vessel's condition and who is aboard."""
    cooling = 0.25 * (37 - water) * (1 + 0.03 * wind) / 10
    eff = survival_hours(water) * F.greatest(F.lit(0.5), 1 - 0.05 * wave) / F.greatest(F.lit(0.1), 1 + cooling)
    for name, factor in CONDITIONS:
        eff = eff * F.when(condition == name, factor).otherwise(1.0)
    eff = eff * F.when(medical, 0.70).otherwise(1.0) * F.when(children, 0.80).otherwise(1.0)
    return F.when(eff <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-hours / eff))))


def urgency(p: Column) -> Column:
    out = None
    for bound, label in URGENCY:
        out = F.when(p >= bound, label) if out is None else out.when(p >= bound, label)
    return out.otherwise("IMMEDIATE")


def drift(wind: Column, wind_from: Column) -> tuple[Column, Column]:
    """Speed in m/s and direction of what drifts: leeway and current, downwind and 15 degrees to the right."""
    return 0.035 * wind + 0.15, modulo(wind_from + 195, 360.0)
