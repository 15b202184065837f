"""The trie of conversations by their first turns, by an external mergesort that carries common prefixes.

A conversation is a key of 16 bytes for each turn (SHA-256 of its role and text, cut), so that the order of keys as
bytes is that of their turns. Tasks sort what they hold into runs in which each key knows how many turns it shares
with the one before it. Runs are cut at the same keys into ranges, and a range's runs are merged by a tree of losers
that compares two keys only from where they stop sharing turns with the last one out. The merged stream keeps the nodes
of its newest key open on a stack; those that the next key leaves are finished and go out.

A node that is open where a range ends goes on in the next one. Ranges therefore report what they saw of the nodes on
the paths of their first and last keys; all figures of a node are sums or minima over the ranges that it spans, and
these few rows are added up apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import drop, ship, stored, text_of, words_of

TURN = 16  # bytes of a turn in a key
RUN, RANGE = 1 << 24, 1 << 24  # bytes of keys of a run and, about, of a range
PACK = 1 << 16  # ids in one piece of text that is hashed
GROUP, HEADS, HEAD = 20, 4, 3  # of the query: conversations that share a head, lengths of heads, the longest

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end binary"
PIECE = f"{NODE}, part int, path boolean, on_first boolean, on_last boolean, words long, parent_depth long, parent_on_first boolean, first binary, last binary, shared long"


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns (digest in hex, words) in order of turn, null first, ties by digest. Null roles and texts are empty; rows without a conv_id belong to no conversation."""
    who, what = text_of(role), text_of(text)
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256), 1, 2 * TURN)
    each = F.struct(F.col(f"`{turn}`").isNotNull().alias("told"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.size(words_of(what)).alias("words"))
    lists = rows.filter(F.col(f"`{conv_id}`").isNotNull()).groupBy(F.col(f"`{conv_id}`").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))))


def keyed(convs: DataFrame) -> DataFrame:
    """conv_id, key and words of each conversation."""
    return convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two keys share, at of which are known."""
    most = min(len(a), len(b)) // TURN
    while at < most and a[at * TURN : at * TURN + TURN] == b[at * TURN : at * TURN + TURN]:
        at += 1
    return at


def runs(keys: DataFrame) -> DataFrame:
    """Sorted runs: a row for each different key of a run with the turns shared with the key before, how many conversations have it and the smallest of them."""

    def flush(number: int, held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[:2])
        rows: list[list] = []
        for key, conv, words in held:
            if rows and rows[-1][2] == key:
                rows[-1][5] += 1
            else:
                rows.append([number, len(rows), key, words, common(rows[-1][2], key) if rows else 0, 1, conv])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["run", "place", "key", "words", "shared", "n", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for conv, key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((key, conv, words.values.to_numpy().astype("<i4").tobytes()))
                size += len(key) + TURN
                if size >= RUN:
                    yield flush(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield flush(number, held)

    ship(keys.sparkSession)
    return keys.mapInArrow(run, "run long, place int, key binary, words binary, shared long, n long, least long")


def merged(streams: list[list[tuple]]) -> Iterator[tuple]:
    """Rows (key, shared, ...) of sorted streams in one order, shared with the row that came out before; equal keys come out one after the other."""
    size = 1 << max(0, len(streams) - 1).bit_length()
    at = [0] * size
    shared = [s[0][1] if s else 0 for s in streams] + [0] * (size - len(streams))
    head = [s[0][0] if s else None for s in streams] + [None] * (size - len(streams))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns what it shares with the winner."""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        if shared[a] != shared[b]:  # who shares more with the last one out is nearer to it
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = common(head[a], head[b], shared[a])
        first, second = (a, b) if (head[a][n * TURN :], a) < (head[b][n * TURN :], b) else (b, a)
        shared[second] = n
        return first, second

    losers = [0] * size
    winners = [*[0] * size, *range(size)]
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while head[top] is not None:
        yield (head[top], shared[top], *streams[top][at[top]][2:])
        at[top] += 1
        more = at[top] < len(streams[top])
        head[top] = streams[top][at[top]][0] if more else None
        shared[top] = streams[top][at[top]][1] if more else 0
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


class Open:
    """A node on the stack."""

    __slots__ = ("words", "least", "n", "children", "leaves", "saved", "end", "waiting")

    def __init__(self, words: int) -> None:
        self.words, self.least, self.n, self.children, self.leaves, self.saved, self.end, self.waiting = words, None, 0, 0, 0, 0, None, []


def finished(rows: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Rows of PIECE: nodes that begin and end within a range, and what it saw of the nodes on the paths of its first and last keys.

    On these paths the following is left out, as the neighbouring ranges decide it: that a node of the first path
    begins here (minus its words once, plus one child of its parent), and that the last key is a leaf.
    """
    path: list[Open] = []
    first = last = b""
    same = 0  # open nodes up to this depth are on the first key's path

    def close(depth: int, ended: bool) -> Iterator[tuple]:
        node, begun = path.pop(), depth > same
        if not ended and not node.leaves:
            node.leaves = 1
        node.saved += node.words * (node.n - begun)
        if path:
            up = path[-1]
            up.n, up.leaves, up.saved, up.children = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved, up.children + begun
            up.least = node.least if up.least is None else min(up.least, node.least)
        plain = begun and not ended
        for child in node.waiting:
            yield (*child[:2], node.least if plain else None, *child[3:8], part, False, None, None, None, None if plain else depth, None if plain else not begun, None, None, None)
        own = (node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.end)
        if not plain:
            yield (*own, part, True, not begun, ended, node.words, None, None, *((first, last, same) if depth == 0 else (None, None, None)))
        elif depth - 1 <= same:  # its parent is on the first path
            yield (*own, part, False, None, None, None, depth - 1, True, None, None, None)
        else:
            path[-1].waiting.append(own)

    for key, shared, words, n, least in rows:
        if path and key == last:
            path[-1].n, path[-1].least = path[-1].n + n, min(path[-1].least, least)
            continue
        if path:
            for depth in range(len(path) - 1, shared, -1):
                yield from close(depth, False)
            same = min(same, shared)
        else:
            first, same, path = key, len(key) // TURN, [Open(0)]
        for w in np.frombuffer(words, "<i4")[shared:].tolist():
            path.append(Open(w))
        path[-1].n, path[-1].least, path[-1].end, last = path[-1].n + n, least, hashlib.sha256(key).digest()[:TURN], key
    for depth in range(len(path) - 1, -1, -1):
        yield from close(depth, True)


def ranges(sorted_runs: DataFrame) -> DataFrame:
    """What each range of keys makes of all runs."""
    spark = sorted_runs.sparkSession
    total = sorted_runs.agg(F.sum(F.octet_length("key") + TURN)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    types = [f.dataType for f in spark.createDataFrame([], PIECE).schema]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n.split()[0], kinds[t.simpleString()]) for n, t in zip(PIECE.split(", "), types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[int, list[tuple]] = {}
        for batch in batches:
            for number, key, shared, words, n, least in zip(*(batch.column(c).to_pylist() for c in ("run", "key", "shared", "words", "n", "least"))):
                stream = streams.setdefault(number, [])
                stream.append((key, shared if stream else 0, words, n, least))
        held = []
        for row in finished(merged(list(streams.values())), TaskContext.get().partitionId()):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return sorted_runs.repartitionByRange(parts, "key").sortWithinPartitions("run", "place").mapInArrow(run, PIECE)


def joined(pieces: DataFrame) -> DataFrame:
    """The nodes (columns of NODE) of all ranges.

    A node on a path is named by the range it began in, its depth and whether it lies on that range's first path only.
    """
    spark = pieces.sparkSession
    roots = pieces.filter("path AND depth = 0")
    order = sorted(r["part"] for r in roots.select("part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(order, order[1:])), "part int, next int")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([common(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.int64())], ["part", "before"])

    met = roots.select("part", "last").join(after, "part").join(roots.select(F.col("part").alias("next"), F.col("first").alias("begin")), "next")
    before = {r["part"]: r["before"] for r in met.select("next", "last", "begin").mapInArrow(share, "part int, before long").collect()}
    facts = {r["part"]: r for r in roots.select("part", "shared", (F.octet_length("last") / TURN).cast("long").alias("long")).collect()}
    b = np.array([before.get(p, -1) for p in order], np.int64)  # turns shared by a range's first key and the key before it
    through = np.minimum(b, [facts[p]["shared"] for p in order])
    bounds = spark.createDataFrame([(p, i, int(b[i]), facts[p]["shared"], i + 1 == len(order) or int(b[i + 1]) < facts[p]["long"]) for i, p in enumerate(order)], "part int, i long, before long, through long, leaf boolean")

    @F.pandas_udf("long")
    def begun(i: pd.Series, depth: pd.Series, on_first: pd.Series) -> pd.Series:
        """The range in which the node at this depth of a range's path begins."""
        out = [int(np.flatnonzero(through[:r] < d)[-1]) if f and d <= b[r] else r for r, d, f in zip(i, depth, on_first)]
        return pd.Series(out, dtype="int64")

    rows = stored(pieces.filter("path").join(F.broadcast(bounds), "part"))
    # words of first-path nodes that begin here, from each node down
    below = rows.filter("on_first").groupBy("part").agg(F.collect_list(F.struct("depth", F.when(F.col("depth") > F.col("before"), F.col("words")).otherwise(0).alias("words"))).alias("all"))
    below = below.select("part", F.explode(F.transform("all", lambda x: F.struct(x["depth"].alias("depth"), x["words"].alias("words")))).alias("x")).select("part", "x.*")
    once = F.sum("words").over(Window.partitionBy("part").orderBy(F.desc("depth")))
    below = below.select("part", "depth", F.lit(True).alias("on_first"), once.alias("once"))
    longest = rows.filter("on_first").groupBy("part").agg(F.max("depth").alias("first_depth"))
    rows = rows.join(below, ["part", "depth", "on_first"], "left").join(longest, "part")
    up = F.greatest(F.col("depth") - 1, F.lit(0))
    only = lambda depth, first: (first & (F.col("through") < depth) & (F.col("before") < depth)).cast("long")
    up_first = F.col("on_first") | (up <= F.col("through"))
    named = rows.select(
        "part", "depth", "on_first", "conv_id", "n_convs", "end",
        (begun("i", "depth", "on_first") * 2 + only(F.col("depth"), F.col("on_first"))).alias("node"),
        F.when(F.col("depth") > 0, begun("i", up, up_first) * 2 + only(up, F.col("on_first"))).alias("up"),
        (F.col("n_children") + F.when(F.col("on_first") & (F.col("depth") < F.col("first_depth")) & (F.col("depth") >= F.col("before")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") + F.when(F.col("on_last") & F.col("leaf"), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") - F.coalesce("once", F.lit(0))).alias("saved_tokens"),
    )
    named = stored(named)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = stored(named.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("end").alias("end"), F.max("up").alias("up"), *sums))
    names = nodes.select(F.col("node").alias("_node"), F.col("depth").alias("_depth"), F.col("conv_id").alias("_conv"))
    spine = nodes.join(names, (F.col("up") == F.col("_node")) & (F.col("depth") - 1 == F.col("_depth")), "left").withColumn("parent_conv_id", F.col("_conv"))
    seen = named.join(names, (F.col("node") == F.col("_node")) & (F.col("depth") == F.col("_depth"))).select(F.col("part").alias("_part"), F.col("depth").alias("_d"), F.col("on_first").alias("_f"), "_conv")
    columns = [c.split()[0] for c in NODE.split(", ")]
    inner = pieces.filter("NOT path")
    hung = inner.filter("parent_depth IS NOT NULL").join(seen, (F.col("part") == F.col("_part")) & (F.col("parent_depth") == F.col("_d")) & (F.col("parent_on_first") == F.col("_f"))).withColumn("parent_conv_id", F.col("_conv"))
    return inner.filter("parent_depth IS NULL").select(columns).unionByName(hung.select(columns)).unionByName(spine.select(columns))


def ends(keys: DataFrame) -> DataFrame:
    """end (a hash of the key) and ends_sha256 of each key: SHA-256 of the ids that have it, ascending. Ids are sorted and written out by ranges, so a key that many have is hashed piece by piece."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(e)) if e[i] != e[i - 1]), len(e)]
            pieces = [(e[x], c[x], ",".join(map(str, c[x:y]))) for lo, hi in zip(cuts, cuts[1:]) for x in range(lo, hi, PACK) for y in (min(hi, x + PACK),)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*pieces), (pa.binary(), pa.int64(), pa.string()))], ["end", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for e, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if e == end:
                    state.update(b"," + ids.encode())
                else:
                    if end is not None:
                        done.append((end, state.hexdigest()))
                    end, state = e, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done)], ["end", "ends_sha256"])
        if end is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end]), pa.array([state.hexdigest()])], ["end", "ends_sha256"])

    rows = keys.select(F.unhex(F.substring(F.sha2("key", 256), 1, 2 * TURN)).alias("end"), "conv_id")
    texts = rows.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(pack, "end binary, least long, ids string")
    return texts.repartition("end").sortWithinPartitions("end", "least").mapInArrow(digest, "end binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations (conv_id, turns of turns_of): conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    conv_ids are unique and not null. A conversation without turns ends at the root; without conversations there are no
    rows. Equal conversations share all nodes. Texts count by role and text, of any length, and travel as 16 bytes; a
    single conversation is one key, 16 bytes a turn, and must fit a task. saved_tokens adds up, over the subtree, the
    words that all members but one need not repeat.
    """
    keys = stored(keyed(convs))
    order = stored(runs(keys))
    pieces = stored(ranges(order))
    drop(order)
    if pieces.isEmpty():
        return keys.sparkSession.createDataFrame([], NODE.replace("end binary", "ends_sha256 string"))
    nodes, last = joined(pieces), F.col("end")
    none = nodes.filter(last.isNull()).withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest())).drop("end")
    return nodes.filter(last.isNotNull()).join(ends(keys), "end").drop("end").unionByName(none)


def rebuilt(convs: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Conversations of turns_of whose first crc32(conv_id) % heads turns are those of the first of their group, as far as it has them."""
    own = stored(convs)
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("_head", F.lit(1), n), F.slice("turns", 1, 0))
    rest = F.slice("turns", n + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("_base"), "left").select("conv_id", F.concat(head, rest).alias("turns"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE = r"""WITH o AS (SELECT conv_id, list(struct_pack(h := h, w := w) ORDER BY turn NULLS FIRST, h) AS l FROM (
  SELECT conv_id, turn, sha256(length(r) || ':' || r || x)[1:32] AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)) GROUP BY conv_id),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, s: list_reduce(list_prepend(xor(a, s), list_transform(range(8), lambda z: CAST(z AS BIGINT))), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS n FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.l, [])[1:c.n], c.l[c.n + 1:]) AS l FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, coalesce(array_to_string(list_transform(l[1:d], lambda t: t.h), ''), '') AS k, l[d].w AS w, len(l) = d AS ends FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
h AS (SELECT left(k, 32 * (d - 1)) AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN h USING (k, d)),
s AS (SELECT left(k, 32 * a) AS k, a AS d, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (k, d) LEFT JOIN n u ON u.d = f.d - 1 AND u.k = left(f.k, 32 * (f.d - 1)) AND f.d > 0"""
