"""Vector codes by product quantisation whose codebooks are refined by the filtering form of Lloyd's algorithm.

Vectors become whole numbers and are cut into equal parts, each with a codebook of its own. Every partition builds, for
each block of its vectors and each part, a kd-tree that caches the bounding box, the sum and the count of every node;
the trees are stored once. In a round all entries go down each tree together: an entry that is farther than the one
nearest to a box's centre from every point of the box is dropped, and a box that is left with one entry is assigned as
a whole by its cached sum and count. Only leaves with several entries look at points. Sums are whole numbers, so the
result does not depend on how vectors are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import near, ship, stored, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK, LEAF, SALTS = 4096, 16, 16  # vectors of a tree; of a leaf, about; copies of a label's sum
FAR = np.iinfo(np.int64).max


def depth_of(n: int) -> int:
    """Levels below the root, so that leaves hold LEAF points or a little more."""
    return max(0, (n // LEAF).bit_length() - 1)


def starts_of(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin in tree order, and n; node i's children are 2 i and 2 i + 1."""
    levels = [np.array([0, n])]
    for _ in range(depth_of(n)):
        s = levels[-1]
        levels.append(np.sort(np.concatenate([s, (s[:-1] + s[1:]) // 2])))
    return levels


def grown(points: np.ndarray) -> bytes:
    """A kd-tree over points (n, width): the order of points in it, the points in that order, then boxes and sums of each level."""
    n = len(points)
    order, boxes = np.arange(n), []
    for starts in starts_of(n):
        at, size = points[order], np.diff(starts)
        low, high = np.minimum.reduceat(at, starts[:-1]), np.maximum.reduceat(at, starts[:-1])
        boxes += [low, high, np.add.reduceat(at, starts[:-1])]
        node = np.repeat(np.arange(len(size)), size)
        wide = np.argmax(high - low, axis=1)
        order = order[np.lexsort((at[np.arange(n), wide[node]], node))]  # within a node, by its widest side
    return np.concatenate([x.ravel() for x in (order, points[order], *boxes)]).astype("<i8").tobytes()


def opened(tree: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Order, points, and (starts, low, high, sums) of each level of a grown() tree."""
    data = np.frombuffer(tree, "<i8")
    order, points, at, levels = data[:n], data[n : n + n * width].reshape(n, width), n + n * width, []
    for starts in starts_of(n):
        k = (len(starts) - 1) * width
        levels.append((starts, *(data[at + i * k : at + (i + 1) * k].reshape(-1, width) for i in range(3))))
        at += 3 * k
    return order, points, levels


def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def descended(points: np.ndarray, levels: list, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, entry, sum) of pieces in tree order whose points all are nearest to one entry of book, ties to the lower index; they make up the whole tree."""
    each = np.arange(len(book))
    node, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    for starts, low, high, sums in levels:
        lo, hi = low[node], high[node]
        best = np.where(alive, square(2 * book[None], (lo + hi)[:, None]), FAR).argmin(1)
        toward = book[None] > book[best][:, None]
        corner = np.where(toward, hi[:, None], lo[:, None])  # the point of the box that most favours an entry against the best
        own, rival = square(book[None], corner), square(book[best][:, None], corner)
        alive = alive & ((own < rival) | (own == rival) & (each <= best[:, None]))
        single = alive.sum(1) == 1
        whole = node[single]
        yield starts[whole], starts[whole + 1], best[single], sums[whole]
        node, alive, last = node[~single], alive[~single], (starts, node[~single], alive[~single])
        node, alive = (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(alive, 2, axis=0)
    starts, node, alive = last
    size = starts[node + 1] - starts[node]
    at = np.repeat(starts[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
    found = np.where(np.repeat(alive, size, axis=0), square(points[at][:, None], book[None]), FAR).argmin(1)
    yield at, at + 1, found, points[at]


def whole_numbers(column: pa.Array, parts: int, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of the vectors in a list column; refuses what a long cannot hold exactly."""
    if set(column.value_lengths().unique().to_pylist()) - {dims}:
        raise ValueError("vectors must all have one length")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
    if 16.0 * float(np.abs(x).max(initial=0)) ** 2 * dims >= 2.0**63:
        raise ValueError("components are too large for squared distances in a long")
    return x.astype(np.int64)


def trees(df: DataFrame, dims: int, vec_id: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """A row for each block of usable vectors: ids, labels, and a tree for each part. Vectors stay where they are."""
    kind = df.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                x = whole_numbers(piece.column(2), parts, scale, dims)
                grew = [grown(p) for p in np.split(x, parts, axis=1)]
                row = [pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*row, pa.array([grew], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    ship(df.sparkSession)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"ids array<long>, labels array<{kind}>, trees array<binary>")


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books (part, entry, place) after one round: each entry the floored mean of what is nearest to it; unused ones stay. What comes back to the driver has the size of the books."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for n, grew in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in range(parts):
                    _, points, levels = opened(grew[part].as_py(), n, width)
                    for begin, end, entry, total in descended(points, levels, books[part]):
                        np.add.at(sums[part], entry, total)
                        np.add.at(counts[part], entry, end - begin)
        used = np.flatnonzero(counts.ravel())
        flat = sums.reshape(-1, width)[used]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(np.repeat(counts.ravel()[used], width)), pa.array(flat.ravel())], ["entry", "place", "n", "total"])

    found = blocks.select(F.size("ids").alias("n"), "trees").mapInArrow(run, "entry long, place long, n long, total long").groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.reshape(-1, width).copy()
    for r in found.collect():  # a row for each number of the books
        out[r["entry"], r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    parts, _, width = books.shape
    kind = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, grew in enumerate(batch.column(2)):
                ids, labels = batch.column(0)[k].values, batch.column(1)[k].values
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for part in range(parts):
                    order, points, levels = opened(grew[part].as_py(), len(ids), width)
                    entry = np.zeros(len(ids), np.int64)
                    for begin, end, e, _ in descended(points, levels, books[part]):
                        size = end - begin
                        entry[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(e, size)
                    codes[order, part] = entry
                    error[order] += square(points, books[part][entry])
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each usable vector, and the codebooks (part, entry, place) of whole numbers.

    Vectors that are null or hold null or non-finite components are left out; the rest must have one length, which
    parts divides, else ValueError. A null vec_id is a vector like any other but comes last when codebooks are begun;
    repeated ids begin them in order of their vectors. Repeated rows each give a row; fewer vectors than entries give
    shorter codebooks; an empty table gives no rows and no codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark, df = df.sparkSession, usable(df, vector)
    v = F.col(f"`{vector}`").cast("array<double>").alias("v")
    first = [r["v"] for r in df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    kind = df.schema[label].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0])
    if not dims or dims % parts:
        raise ValueError("the length of vectors must be a multiple of the parts")
    start = whole_numbers(pa.array(first, pa.list_(pa.float64())), parts, scale, dims)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = stored(trees(df, dims, vec_id, vector, label, parts, scale))
    for _ in range(rounds):
        books = refined(blocks, books)
    return stored(encoded(blocks, books)), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    salt = F.pmod(F.xxhash64("vec_id", "error"), F.lit(SALTS))  # so that no label's rows meet in one task
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    met = codes.withColumn("salt", salt).join(near(sums), F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by comparing every part with every entry; each round is a step of its own."""
    nearest = lambda k: f"""a{k} AS MATERIALIZED (SELECT id, part, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT x.id, x.part, b.e, list_sum(list_transform(list_zip(x.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b ON x.part = b.part) GROUP BY id, part)"""  # noqa: E731
    means = lambda k: f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.p, b.p) AS p FROM b{k} b LEFT JOIN (
  SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM (SELECT a.part, a.best.e AS e, i, CAST(sum(x.p[i]) AS BIGINT) AS s, count(*) AS n
   FROM a{k} a JOIN x ON x.id = a.id AND x.part = a.part, range(1, {64 // PARTS + 1}) r(i) GROUP BY ALL) GROUP BY part, e) m ON m.part = b.part AND m.e = b.e)"""  # noqa: E731
    steps = ", ".join(f"{nearest(k)}, {means(k)}" for k in range(ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = len(embedding)),
x AS MATERIALIZED (SELECT id, part, w[part * len(w) // {PARTS} + 1 : (part + 1) * len(w) // {PARTS}] AS p FROM v, range({PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS e, p FROM x WHERE id <= {ENTRIES}), {steps}, {nearest(ROUNDS)},
c AS (SELECT id, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (id), h"""


ORACLE = _oracle()
