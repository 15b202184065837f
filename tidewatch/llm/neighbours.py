"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every block of vectors is projected on LINES random directions, and each projection is kept as one sorted array. A
query opens a window around its own projection on every array and widens all of them step by step (virtual rehashing:
the window stands for a bucket of a growing radius around the query). Each entry that a window newly covers is a
collision; a vector with at least LEAST of them is verified by its distance. A query is done with a block once k
verified vectors lie within the radius, or the radius has reached a distance within which k vectors are known to lie,
from a bounded sample or from blocks met before. No number of candidates is capped.

A vector at the radius collides on one line with probability 0.826 and passes LEAST of LINES with 0.98, a closer one
more surely; that is the recall to expect at the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import ship, stored, usable

K, EVERY, SEED = 10, 100, 7
LINES, LEAST, HALF = 64, 47, 1.36  # directions; collisions of a candidate; half a window's width, in radii
GROWTH, STEPS = 1.2, 3  # of the radius; the last step's radius is the known distance
BLOCK, PILOT, PAIR = 8192, 4096, 2  # vectors of a block (16-bit places) and of the sample; blocks that meet queries together, on average
SLACK = 1e-5  # of a projection, for rounding to 32 bits


def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, LINES))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if set(column.value_lengths().unique().to_pylist()) - {dims}:
        raise ValueError("vectors must all have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = rows.astype(np.float64) - q
    return np.sqrt((d * d).sum(-1))


def indexed(rows: DataFrame, dims: int, wide: str) -> DataFrame:
    """A row for each block of rows (id, v): its number, ids, vectors, sorted projections and their places. wide is numpy's type of a component."""
    lines = directions(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                x = matrix(piece.column(1), dims).astype(wide)
                with np.errstate(over="ignore"):
                    on = (x.astype(np.float64) @ lines).T.astype(np.float32)
                order = np.argsort(on, axis=1, kind="stable")
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), piece.column(0))
                payload = [pa.array([a.tobytes()], pa.binary()) for a in (x, np.take_along_axis(on, order, 1), order.astype(np.uint16))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *payload], ["block", "ids", "vectors", "sorted", "places"])
                number += 1

    return rows.mapInArrow(run, "block long, ids array<long>, vectors binary, sorted binary, places binary")


def asked(index: DataFrame, pilot: pa.Table, dims: int, wide: str, every: int, k: int) -> DataFrame:
    """The queries of an index with the distance within which k other vectors of the sample lie, infinite if there are not so many."""
    known, names = matrix(pilot.column("v").combine_chunks(), dims).astype(np.float64), pilot.column("id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, vectors in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids, x = ids.values.to_numpy(zero_copy_only=False), np.frombuffer(vectors.as_py(), wide).reshape(-1, dims)
                at = np.flatnonzero(ids % every == 0)  # a null id is NaN here
                bound = np.full(len(at), np.inf)
                for i, place in enumerate(at):
                    d = distances(known, x[place].astype(np.float64))[names != ids[place]]
                    if len(d) >= k:
                        bound[i] = np.partition(d, k - 1)[k - 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number.as_py())), pa.array(at.astype(np.int32)), pa.array(ids[at].astype(np.int64)), pa.array([x[p].tobytes() for p in at], pa.binary()), pa.array(bound)], ["q_block", "q_place", "query_id", "q", "bound"])

    return index.select("block", "ids", "vectors").mapInArrow(run, "q_block long, q_place int, query_id long, q binary, bound double")


class Block:
    """One block of an index in a task."""

    def __init__(self, number: int, ids: pa.Array, vectors: bytes, values: bytes, places: bytes, wide: str) -> None:
        self.number, self.ids = number, ids
        self.vectors = np.frombuffer(vectors, wide).reshape(len(ids), -1)
        self.values = np.frombuffer(values, np.float32).reshape(LINES, len(ids))
        self.places = np.frombuffer(places, np.uint16).reshape(LINES, len(ids))

    def windows(self, on: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last place of each query's window on each line."""
        low, high = np.empty(on.shape, np.int64), np.empty(on.shape, np.int64)
        reach = half[:, None] + SLACK * np.abs(on)
        for i in range(LINES):
            low[:, i] = np.searchsorted(self.values[i], (on[:, i] - reach[:, i]).astype(np.float32), "left")
            high[:, i] = np.searchsorted(self.values[i], (on[:, i] + reach[:, i]).astype(np.float32), "right")
        return low, high

    def near(self, q: np.ndarray, opened: list[tuple[np.ndarray, np.ndarray]], radii: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the vectors that a query verifies here; own is its own place or -1."""
        n = len(self.ids)
        hits, found, score = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, np.inf)
        left = right = None
        for (low, high), radius in zip(opened, radii):
            if left is None:
                new = [self.places[i, low[i] : high[i]] for i in range(LINES)]
            else:
                new = [self.places[i, a:b] for i in range(LINES) for a, b in ((low[i], left[i]), (right[i], high[i])) if a < b]
            if new:
                hits += np.bincount(np.concatenate(new), minlength=n)
            left, right = low, high
            fresh = np.flatnonzero((hits >= LEAST) & ~found)
            fresh = fresh[fresh != own]
            found[fresh] = True
            score[fresh] = distances(self.vectors[fresh], q)
            if (score <= radius).sum() >= k:
                break
        at = np.flatnonzero(found)
        return at, score[at]


def best(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k nearest, ties to the smaller id, null last."""
    if len(scores) > k:
        close = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        ids, scores = ids.take(pa.array(close)), scores[close]
    none = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.fill_null(0).to_numpy(), none, scores))[:k]
    return ids.take(pa.array(order)), scores[order]


def met(blocks: list[Block], batch: pa.RecordBatch, lines: np.ndarray, wide: str, k: int) -> Iterator[pa.RecordBatch]:
    """What each query of a batch finds in blocks; a block's finds bound the radius in the next."""
    source, place = batch.column("q_block").to_numpy(), batch.column("q_place").to_numpy()
    q = np.frombuffer(b"".join(batch.column("q").to_pylist()), wide).reshape(batch.num_rows, -1).astype(np.float64)
    bound, on = batch.column("bound").to_numpy().copy(), q @ lines
    held: list[tuple[pa.Array, np.ndarray]] = [(pa.array([], pa.int64()), np.zeros(0))] * len(q)
    for block in blocks:
        radii = bound[:, None] * GROWTH ** np.arange(1 - STEPS, 1)
        opened = [block.windows(on, HALF * radii[:, s]) for s in range(STEPS)]
        for j in range(len(q)):
            own = int(place[j]) if source[j] == block.number else -1
            at, score = block.near(q[j], [(low[j], high[j]) for low, high in opened], radii[j], own, k)
            ids, scores = held[j]
            held[j] = ids, scores = best(pa.concat_arrays([ids, block.ids.take(pa.array(at))]), np.concatenate([scores, score]), k)
            if len(scores) == k:
                bound[j] = min(bound[j], scores[-1])
    sizes = [len(s) for _, s in held]
    again = pa.array(np.repeat(np.arange(len(q)), sizes))
    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(again) for c in ("q_block", "q_place", "query_id")), pa.concat_arrays([i for i, _ in held]), pa.array(np.concatenate([s for _, s in held]))], ["q_block", "q_place", "query_id", "vec_id", "score"])


def nearest(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found of each query; queries are the rows whose id every divides, candidates all rows but the query's own.

    Vectors that are null, zero or hold null or non-finite components take no part; the rest must have one length, else
    ValueError. With k candidates or fewer, all are found. Ties go to the smaller id, null last; a null id is no query.
    Rows that share an id are rows of their own: each is a query and a candidate of the other. Other columns are
    ignored; an empty table gives no rows.

    Blocks are dealt to groups and queries to every group, so a task holds a few blocks while queries stream by.
    """
    spark, v = df.sparkSession, F.col(f"`{vector}`")
    ship(spark)
    df = usable(df, vector).filter(F.exists(v.cast("array<double>"), lambda x: x != 0))
    wide = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.cast(f"array<{'float' if wide == '<f4' else 'double'}>").alias("v"))
    pilot = rows.withColumn("_draw", F.xxhash64("id", "v")).orderBy("_draw").limit(PILOT).select("id", "v").toArrow()
    if not pilot.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = len(pilot.column("v")[0])
    lines = directions(dims)
    index = stored(indexed(rows, dims, wide))
    groups = -(-index.count() // PAIR)
    queries = asked(index, pilot, dims, wide, every, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks = None, []
        for batch in batches:
            g, asks = batch.column("g").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (asks[1:] != asks[:-1])) + 1), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                if g[a] != group:
                    group, blocks = g[a], []
                if asks[a]:
                    yield from met(blocks, piece, lines, wide, k)
                else:
                    blocks += [Block(r["block"].as_py(), r["ids"].values, r["vectors"].as_py(), r["sorted"].as_py(), r["places"].as_py(), wide) for r in ({c: piece.column(c)[i] for c in ("block", "ids", "vectors", "sorted", "places")} for i in range(b - a))]

    held = index.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("asks", F.lit(False))
    asks = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(True))
    dealt = held.unionByName(asks, allowMissingColumns=True).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "asks")
    found = dealt.mapInArrow(run, "q_block long, q_place int, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_place").orderBy("score", F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
