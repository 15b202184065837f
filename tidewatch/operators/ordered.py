"""Series too long for one task: ranks, running maxima and greedy folds of the rows of a key in order.

Rows are sorted once over all keys by ranges, so that a key of any length is spread over as many tasks as it needs. A
piece is what one sorted partition holds of a key. Within a piece windows do the work; what goes from piece to piece is
a row each, carried on by a window over these few rows.

A greedy fold keeps a row if the last row kept is far enough back: rank by rank, a row is kept if that one's rank is at
most its own limit. What a block of rows makes of the last rank before it is a step function with few steps. Blocks are
composed into blocks of blocks until one is left for each key; then the last rank kept is handed down again, and every
block is folded apart from all others.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.storage import ship, stored

BLOCK, FAN = 32768, 256  # rows of a block; blocks of a block of blocks
AT_ONCE = 32  # blocks that Python is given at a time
NONE = -1  # no row was kept yet


def pieces(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows, sorted and stored, with _at, increasing in order of key and order, and _piece, the sorted partition it is in."""
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", at)
    return stored(dealt.withColumn("_piece", F.shiftright("_at", 33)))


def joined_by_piece(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, a row for each key and piece; a null key is a key."""
    facts = facts.withColumnsRenamed({key: "_key", "_piece": "_its"})
    return rows.join(facts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_its"))).drop("_key", "_its")


def ranked(rows: DataFrame, key: str, *order: str, sorted_too: bool = False) -> DataFrame:
    """rows with rank, from 0, in each key's order; ties must be broken by order. sorted_too keeps _at and _piece, so that running_max() need not sort again."""
    rows = pieces(rows, key, *order)
    sizes = rows.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_piece")) - F.col("_n")
    out = joined_by_piece(rows, sizes.select(key, "_piece", (before - F.col("_first")).alias("_shift")), key)
    return out.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_shift", *([] if sorted_too else ["_at", "_piece"]))


def running_max(rows: DataFrame, key: str, order: tuple[str, ...], **values: Column) -> DataFrame:
    """rows with the greatest of each value so far, the row's own included; null as long as there is none. Rows that ranked() has sorted by this order are taken as they are."""
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    rows = rows if {"_at", "_piece"} <= set(rows.columns) else pieces(rows, key, *order)
    inner = Window.partitionBy(key, "_piece").orderBy("_at")
    ends = rows.groupBy(key, "_piece").agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in values])
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    facts = ends.select(key, "_piece", *[F.max(f"_m_{n}").over(earlier).alias(f"_b_{n}") for n in values])
    here = rows.withColumns({n: F.max(f"_v_{n}").over(inner) for n in values})
    out = joined_by_piece(here, facts, key).withColumns({n: F.greatest(F.col(n), F.col(f"_b_{n}")) for n in values})
    return out.drop("_at", "_piece", *[f"_{x}_{n}" for n in values for x in "vb"])


def apart(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """key, rank and limit of ranked rows: the last rank that lies gap or more, by the whole number at, before a row; -1 if none does."""
    own = rows.select(key, (F.col(at) + 0).alias("_t"), F.lit(1).alias("_asks"), "rank")
    seen = rows.select(key, (F.col(at) + gap).alias("_t"), F.lit(0).alias("_asks"), "rank")
    out = running_max(own.unionByName(seen), key, ("_t", "_asks", "rank"), limit=F.when(F.col("_asks") == 0, F.col("rank")))
    return out.filter("_asks = 1").select(key, "rank", F.coalesce("limit", F.lit(NONE)).alias("limit"))


def last_kept(start: int, limits: np.ndarray) -> list[int]:
    """For each row of a block: the last row kept in it if this one is. Row i is followed by the first later one whose limit is start + i or more."""
    n, out = len(limits), list(range(len(limits)))
    low, place = [], []  # later rows that no nearer one beats, farthest first, and their limits negated
    for i in range(n - 1, -1, -1):
        k = bisect_right(low, -(start + i)) - 1
        if k >= 0:
            out[i] = out[place[k]]
        own = -int(limits[i])
        while low and low[-1] >= own:
            low.pop()
            place.pop()
        low.append(own)
        place.append(i)
    return out


def steps(start: int, limits: np.ndarray) -> tuple[list[int], list[int]]:
    """What a block makes of the last rank kept before it: up to at[i], out[i]; beyond the last, that rank itself."""
    ends, at, out, best = last_kept(start, limits), [], [], NONE - 1
    for i, limit in enumerate(limits.tolist()):
        if limit > best:
            best = limit
            if out and out[-1] == start + ends[i]:
                at[-1] = best
            else:
                at.append(best)
                out.append(start + ends[i])
            if best >= start - 1:  # no rank before the block is larger
                break
    return at, out


def follow(at, out, kept: int) -> int:  # noqa: ANN001
    k = bisect_left(at, kept)
    return int(out[k]) if k < len(at) else kept


def composed(start: int, ats: list, outs: list) -> tuple[list[int], list[int]]:
    """The steps of neighbouring blocks as one block's."""
    at, out, best = [], [], NONE - 1
    for c, (a, o) in enumerate(zip(ats, outs)):
        for limit, kept in zip(a, o):
            if limit > best:
                best, kept = int(limit), int(kept)
                for x, y in zip(ats[c + 1 :], outs[c + 1 :]):
                    kept = follow(x, y, kept)
                if out and out[-1] == kept:
                    at[-1] = best
                else:
                    at.append(best)
                    out.append(kept)
                if best >= start - 1:
                    return at, out
    return at, out


STEPS = "at array<long>, out array<long>"


def folded(rows: DataFrame, key: str, block: int = 0) -> DataFrame:
    """key, rank and previous (the rank kept before, -1 for none) of the rows that a greedy fold keeps, of rows (key, rank, limit).

    Row by row in order of rank, one is kept if the last rank kept, at first -1, is its limit or less; a null limit
    keeps none. No task holds more than a block of rows or the steps of FAN blocks, however long a key is. What comes
    out can be as many rows as went in, and is never broadcast: its ranks pack so well that Spark takes it for small.
    """
    size = block or BLOCK
    ship(rows.sparkSession)

    @F.pandas_udf(STEPS)
    def first_steps(number: pd.Series, limits: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([steps(int(b) * size, x) for b, x in zip(number, limits)], columns=["at", "out"])

    @F.pandas_udf(STEPS)
    def next_steps(start: pd.Series, ats: pd.Series, outs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([composed(int(s), list(a), list(o)) for s, a, o in zip(start, ats, outs)], columns=["at", "out"])

    @F.pandas_udf("array<long>")
    def handed(kept: pd.Series, ats: pd.Series, outs: pd.Series) -> pd.Series:
        """The last rank kept before each block of a block of blocks."""
        found = []
        for k, a, o in zip(kept, ats, outs):
            each = [int(k)]
            for x, y in zip(a[:-1], o[:-1]):
                each.append(follow(x, y, each[-1]))
            found.append(each)
        return pd.Series(found)

    @F.pandas_udf("array<long>")
    def kept_in(number: pd.Series, limits: pd.Series, kept: pd.Series) -> pd.Series:
        """The ranks kept in each block."""
        found = []
        for b, x, k in zip(number, limits, kept):
            each, last = array("q"), int(k)
            for rank, limit in enumerate(x, int(b) * size):
                if last <= limit:
                    each.append(rank)
                    last = rank
            found.append(np.frombuffer(each, np.int64))
        return pd.Series(found, dtype=object)

    name = F.col(key).alias("_key")
    lists = rows.select(name, F.floor(F.col("rank") / size).alias("_block"), F.struct("rank", F.coalesce("limit", F.lit(NONE - 1)).alias("limit")).alias("_r"))
    blocks = stored(lists.groupBy("_key", "_block").agg(F.array_sort(F.collect_list("_r")).alias("_l")).select("_key", "_block", F.transform("_l", lambda r: r["limit"]).alias("_limits")))
    start = blocks.withColumn("_kept", F.lit(NONE))
    if top := blocks.agg(F.max("_block")).first()[0]:
        many = blocks.select("_key", "_block").filter("_block > 0").select("_key").distinct()
        long = blocks.join(many, blocks["_key"].eqNullSafe(many["_key"]), "left_semi")
        s = first_steps("_block", "_limits")
        levels = [slim(long.select("_key", "_block", s["at"].alias("at"), s["out"].alias("out")))]
        span = size
        while top:
            top, span = top // FAN, span * FAN
            group = levels[-1].groupBy("_key", F.floor(F.col("_block") / FAN).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_block", "at", "out"))).alias("_c"))
            group = group.select("_key", F.col("_up").alias("_block"), F.transform("_c", lambda c: c["_block"]).alias("_of"), F.transform("_c", lambda c: c["at"]).alias("ats"), F.transform("_c", lambda c: c["out"]).alias("outs"))
            s = next_steps(F.col("_block") * span, "ats", "outs")
            levels.append(slim(group.select("*", s["at"].alias("at"), s["out"].alias("out"))))
        known = levels[-1].select("_key", "_block", F.lit(NONE).cast("long").alias("_kept"))
        for level in reversed(levels[1:]):
            down = level.join(known.withColumnsRenamed({"_key": "_k", "_block": "_b"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
            given = down.select("_key", "_of", handed("_kept", "ats", "outs").alias("_given"))
            known = slim(given.select("_key", F.explode(F.arrays_zip("_of", "_given")).alias("z")).select("_key", F.col("z._of").alias("_block"), F.col("z._given").alias("_kept")))
        of = known.withColumnsRenamed({"_key": "_k", "_block": "_b"})
        start = blocks.join(of, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left").select("_key", "_block", "_limits", F.coalesce("_kept", F.lit(NONE)).alias("_kept"))
    ranks = slim(start.select("_key", "_kept", kept_in("_block", "_limits", "_kept").alias("_ranks")))
    each = ranks.select("_key", "_kept", "_ranks", F.posexplode("_ranks").alias("_i", "rank"))
    return each.select(F.col("_key").alias(key), "rank", F.coalesce(F.get("_ranks", F.col("_i") - 1), "_kept").alias("previous")).hint("merge")


def slim(rows: DataFrame) -> DataFrame:
    """rows, stored, their Python given a few rows at a time: one of these is as long as a block."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(AT_ONCE))
    try:
        return stored(rows)
    finally:
        conf.set(name, before)
