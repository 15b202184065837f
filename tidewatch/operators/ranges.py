"""Joins by distance as equi joins on grid cells: the right side is dealt to its cell and the eight around it.

A crowded cell is not one task: its left rows are dealt to as many shares as it takes for each to have ROOM rows, about,
and the right rows of that cell go to every share. The pairs are found by sorting: Spark does not see that the right
side was multiplied, and would broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.storage import stored

ROOM = 8192  # left rows of a share
FEW = 100_000  # rows of a table that may be broadcast
PARTS = 8  # cells of first_within() along a distance


def cell(column: str, width: float) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def crowded(left: DataFrame, keys: list[str]) -> DataFrame | None:
    """keys and _shares of the cells with more than ROOM rows, broadcast if they are FEW at most; None if there is no such cell."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROOM).cast("int").alias("_shares")).filter("_shares > 1")
    n = sizes.limit(FEW + 1).count()
    return None if n == 0 else F.broadcast(sizes) if n <= FEW else sizes


def dealt(left: DataFrame, crowds: DataFrame, keys: list[str]) -> DataFrame:
    """left with _share, its share of a crowded cell, 0 elsewhere; crowds: keys and _shares."""
    name = {k: f"_c{k}" for k in keys}
    same = [F.col(k) == F.col(c) for k, c in name.items()]
    draw = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_shares"))
    return left.join(crowds.withColumnsRenamed(name), same, "left").withColumn("_share", F.coalesce(draw, F.lit(0))).drop("_shares", *name.values())


def near_join(left: DataFrame, right: DataFrame, lat: tuple[str, str], lon: tuple[str, str], degrees: float, exact: Column, how: str = "inner", on: tuple[str, ...] = (), planar: bool = False) -> DataFrame:
    """Pairs whose planar distance is within degrees, then exact, without comparing all with all.

    The right side is multiplied by nine, so it should be the smaller one. how: inner or left_semi; on: further columns
    that must be equal. Rows without a position meet nothing. Columns of the two sides must differ in name, but for on.
    planar: exact holds for any two points less than degrees apart; a semi join then answers a left row whose cell of
    two thirds of that width holds a right row without looking at pairs.
    """
    if planar and how == "left_semi" and not on:
        width = degrees / 1.5  # its diagonal is shorter than degrees
        held = right.select(cell(lat[1], width).alias("_fx"), cell(lon[1], width).alias("_fy")).distinct().withColumn("_held", F.lit(True))
        flagged = left.withColumn("_x", cell(lat[0], width)).withColumn("_y", cell(lon[0], width)).join(held, (F.col("_x") == F.col("_fx")) & (F.col("_y") == F.col("_fy")), "left")
        rest = flagged.filter(F.col("_held").isNull()).select(*left.columns)
        places = right.dropDuplicates([lat[1], lon[1]])
        return flagged.filter("_held").select(*left.columns).unionByName(near_join(rest, places, lat, lon, degrees, exact, how))
    keys = ["_x", "_y", *on]
    l_ = left.withColumn("_x", cell(lat[0], degrees)).withColumn("_y", cell(lon[0], degrees))
    offsets = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    r_ = right.withColumn("_dx", F.explode(offsets)).withColumn("_dy", F.explode(offsets))
    r_ = r_.withColumn("_rx", cell(lat[1], degrees) + F.col("_dx")).withColumn("_ry", cell(lon[1], degrees) + F.col("_dy")).drop("_dx", "_dy")
    r_ = r_.withColumnsRenamed({c: f"_r_{c}" for c in on})
    names = {"_x": "_rx", "_y": "_ry"} | {c: f"_r_{c}" for c in on}
    same = exact
    for k in keys:
        same = same & (F.col(k) == F.col(names[k]))
    crowds = crowded(l_, keys)
    if crowds is not None:
        l_, same = dealt(l_, crowds, keys), same & (F.col("_share") == F.col("_r_share"))
        more = crowds.withColumnsRenamed({k: f"_c{k}" for k in keys})
        each = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)).cast("long") - 1)
        r_ = r_.join(more, [F.col(names[k]) == F.col(f"_c{k}") for k in keys], "left").withColumn("_r_share", F.explode(each)).drop("_shares", *[f"_c{k}" for k in keys])
    return l_.join(r_.hint("merge"), same, how).drop("_x", "_y", "_rx", "_ry", "_share", "_r_share", *[f"_r_{c}" for c in on])


def first_within(places: DataFrame, rows: DataFrame, at: tuple[str, str], to: tuple[str, str], key: str, degrees: float, exact: Column, most: int) -> DataFrame:
    """at and key: for each place, the rows with the smallest whole numbers as key, most at most, that are near. exact says what is near and holds for any two points less than degrees apart.

    A cell that lies near whole gives its own smallest keys, and these a bound on the keys sought. Cells on the edge are
    met by levels of the key, each twice as long as the one before, up to the bound's. So what a place meets goes by how
    many keys come before its bound, not by how many rows are near.
    """
    width, keys = degrees / PARTS, ["_x", "_y"]
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    k = F.col(key).cast("long")
    level = F.when(k < 0, -F.length(F.bin(F.bitwise_not(k)))).otherwise(F.length(F.bin(k)))
    r = stored(rows.filter(there(to[0]) & there(to[1]) & k.isNotNull()).select(*to, key, cell(to[0], width).alias("_x"), cell(to[1], width).alias("_y"), level.alias("_level")))
    reach = F.sequence(F.lit(-PARTS - 1).cast("long"), F.lit(PARTS + 1).cast("long"))
    x, y = (F.col(c) / F.lit(width) for c in at)
    p = places.select(*at).distinct().filter(there(at[0]) & there(at[1])).withColumn("_x", F.explode(reach)).withColumn("_y", F.explode(reach))
    p = p.withColumns({"_x": F.floor(x).cast("long") + F.col("_x"), "_y": F.floor(y).cast("long") + F.col("_y")})
    near = F.hypot(*[F.greatest(F.lit(0.0), F.col(c) - v, v - F.col(c) - 1) for c, v in (("_x", x), ("_y", y))])
    far = F.hypot(*[F.greatest(F.abs(v - F.col(c)), F.abs(v - F.col(c) - 1)) for c, v in (("_x", x), ("_y", y))])
    p = stored(p.filter(near < PARTS + 1e-6).withColumn("_whole", far < PARTS - 1e-6))
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(key))).filter(F.col("_n") <= most)
    inner = stored(first(p.filter("_whole").join(first(r, *keys).drop("_n").hint("merge"), keys).filter(exact), *at).select(*at, key, "_n", "_level"))
    bound = inner.filter(F.col("_n") == most).select(F.col(at[0]).alias("_a"), F.col(at[1]).alias("_b"), F.col("_level").alias("_most"))
    edge = p.filter("NOT _whole").join(bound.hint("merge"), (F.col(at[0]) == F.col("_a")) & (F.col(at[1]) == F.col("_b")), "left").select(*at, *keys, F.coalesce("_most", F.lit(64)).alias("_most"))
    asks = edge.join(r.select(*keys, "_level").distinct().hint("merge"), keys).filter("_level <= _most").select(*at, *keys, "_level")
    outer = asks.join(r.hint("merge"), [*keys, "_level"]).filter(exact).select(*at, key)
    return first(inner.select(*at, key).unionByName(outer), *at).drop("_n")
