"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Rows of a source are dealt by hash into shards of about ROWS rows, and each shard's words form a stream in seeded
order that is cut into blocks of BLOCK words. Blocks go to sources by the highest quotients target / (2s - 1), then
within a source to its shards by their sizes in the same way: integer quotas. A shard takes its quota of blocks in
seeded order, every block once before any twice.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import documents, near, stored, text_of, words_of

WEIGHTS, SHARE, CAP, BLOCK, ROWS, SEED = (3, 1, 2), 1.5, 2.0, 64, 1000, 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to a row per source (source, source_size).

    Sources in code-point order, null last, weigh weights, repeating, and share share * all sizes; a target stops at
    cap * source_size, and the excess is shared again by weight until none is above. In closed form: sources sorted by
    cap * size / weight stop one after another until the level of the rest is below their own.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("at", F.col("most") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    rest_w = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = total - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = w.withColumn("level", rest / rest_w).withColumn("stops", F.col("at") < F.col("level"))
    # the level that holds for the rest is the one at the first source that does not stop, the highest of those that tie
    first = F.min(F.struct(F.col("stops"), F.col("at"), (-F.col("level")).alias("below"))).over(Window.partitionBy())
    return w.withColumn("target", F.when(first["stops"], F.col("most")).otherwise(F.least("most", F.col("weight") * -first["below"]))).select("source", "source_size", "target")


def apportioned(units: DataFrame, by: list[str], order: list[str], seats: Column) -> DataFrame:
    """Adds quota by Sainte-Laguë to units (votes double and, the same throughout each by, seats).

    With V votes and n units, dividing by V / (seats - n/2) gives each unit no more than it gets in the end and by
    V / (seats + n/2) no less; only the few quotients between are ranked. Ties go by order.
    """
    w = Window.partitionBy(*by)
    u = units.withColumn("seats", seats).withColumn("_v", F.sum("votes").over(w)).withColumn("_n", F.sum(F.when(F.col("votes") > 0, 1).otherwise(0)).over(w))
    rounded = lambda s: F.when(F.col("_v") > 0, F.floor(F.col("votes") / F.col("_v") * F.greatest(s, F.lit(0.0)) + 0.5)).otherwise(0).cast("long")
    u = u.withColumn("_low", F.greatest(rounded(F.col("seats") - F.col("_n") / 2) - 1, F.lit(0))).withColumn("_high", rounded(F.col("seats") + F.col("_n") / 2) + 1)
    u = u.withColumn("_open", F.col("seats") - F.sum("_low").over(w))
    quotients = u.filter("votes > 0").select(*by, *order, "votes", "_open", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_s"))
    won = quotients.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("votes") / (2 * F.col("_s") - 1)), *order, "_s"))).filter("_rank <= _open")
    keys = [*by, *order]
    gained = won.groupBy(*[F.col(k).alias(f"_won_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_won"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_won_{k}")) for k in keys])
    return u.join(gained, same, "left").select(*units.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def drawn(doc_id: str, text: str, seed: int) -> Column:
    """A row's place in seeded order: by its id and its whole text."""
    return F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), text_of(text))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, rows_per_shard: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, in_mix (whether any word is taken) and row.

    Null texts have no words; a null source is a source; null doc_ids and repeated rows are rows like any other and
    tie in seeded order by text. Sources without words have target 0; an empty table gives no rows.
    No document is taken above cap * size, as no block is taken more than cap times. Blocks of a shard are equal but
    for the last. Other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.size(words_of(text_of(text))).cast("long").alias("size"), drawn(doc_id, text, seed).alias("draw"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sizes, weights, share, cap).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    plan = stored(apportioned(plan.withColumn("votes", F.col("target")).withColumn("all", F.lit(1)), ["all"], ["source"], seats).select("source", "source_size", "target", "n", F.col("quota").alias("blocks")))
    # a source's number of shards follows its rows, so no window below holds more than a few times rows_per_shard
    known = rows.alias("r").join(near(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "source_size", "target", "blocks", "n")
    known = known.withColumn("shard", F.pmod(F.col("draw"), F.ceil(F.col("n") / rows_per_shard)).cast("long"))
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "draw"), "doc_id", "row")
    known = known.withColumn("start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    shards = rows.alias("r").join(near(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    shards = shards.groupBy(F.col("r.source").alias("source"), F.pmod(F.col("draw"), F.ceil(F.col("n") / rows_per_shard)).cast("long").alias("shard")).agg(F.sum("size").alias("votes"), F.first("blocks").alias("blocks"))
    shards = apportioned(shards.withColumn("votes", F.col("votes").cast("double")), ["source"], ["shard"], F.col("blocks")).withColumn("n_blocks", F.ceil(F.col("votes") / block))
    shards = shards.withColumn("quota", F.least("quota", (F.col("n_blocks") * F.lit(float(cap))).cast("long")))
    # a few rows become all blocks of the mix: dealt out first, by a number that is not merged again
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = shards.filter("n_blocks > 0").repartition(spread, "source", "shard").select("source", "shard", "quota", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    turn = F.row_number().over(Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block")) - 1
    blocks = blocks.withColumn("times", F.floor((F.col("quota") - turn + F.col("n_blocks") - 1) / F.col("n_blocks"))).filter("times > 0").select("source", "shard", "block", "times")
    parts = known.filter("size > 0").select("row", "source", "shard", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    words = F.least(F.col("a.start") + F.col("a.size"), (F.col("a.block") + 1) * block) - F.greatest(F.col("a.start"), F.col("a.block") * block)
    # the estimate of blocks is that of its shards, so Spark would broadcast them
    taken = parts.alias("a").join(blocks.hint("merge").alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.shard") == F.col("b.shard")) & (F.col("a.block") == F.col("b.block")))
    taken = taken.groupBy(F.col("a.row").alias("row_taken")).agg(F.sum(words * F.col("times")).alias("taken"))
    return known.join(taken, F.col("row") == F.col("row_taken"), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), (F.coalesce("taken", F.lit(0)) > 0).alias("in_mix"), "draw")


def in_proportion(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, **how) -> DataFrame:
    """Each row of docs as often as the mix takes it: taken / size times, rounded up or down by a seeded draw. Rows that are the same in doc_id and text share what is taken of them; rows without words are not in the mix. Columns stay as they are, whatever their names; an empty table gives no rows."""
    rate = mixed(docs, doc_id, text, seed=seed, **how).filter("size > 0").groupBy("draw").agg((F.sum("taken") / F.sum("size")).alias("rate"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, drawn(doc_id, text, seed).alias("draw")).join(rate, "draw")
    chance = F.pmod(F.xxhash64(F.lit(seed + 3), "draw"), F.lit(1 << 30)) / (1 << 30)
    times = F.floor(F.coalesce("rate", F.lit(0.0)) + chance).cast("int")
    again = rows.select("row", times.alias("times")).filter("times > 0")
    return again.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).drop("in_mix", "draw")
