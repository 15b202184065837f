"""Repeated 50-byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through DEPTH bytes, most significant digit first, and a group of one drops out at every
pass, so what is left at the end are exactly the repeated windows.

The first digit of a window is its anchor: the GRAM bytes in it with the smallest hash, the leftmost on ties, which
only the window's own bytes decide. Neighbouring windows share an anchor, so documents give one key for a run of
about 18 windows (pass 1). Keys that occur in one document only drop out; the runs that are left give their bytes,
once for each batch of documents, and are grouped by whole run (pass 2), then by single window and 8 bytes at a time
(passes 3 to 9), until groups are equal through DEPTH bytes. No hash decides a match: it is compared byte by byte.

Documents stay in place: they are written once to a table bucketed by batch, and answers come to them by batch.
"""

from __future__ import annotations

import atexit
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import documents, released, scratch, ship, stored, text_of

DEPTH, GRAM = 50, 16
#: Bytes of input up to which batches stay at BATCH, and of the largest batch.
GIB, MOST = 1 << 30, 1 << 24
#: Bytes of a batch of documents and of a bucket of the table; window starts that are hashed at a time.
BATCH, BUCKET, SEGMENT = 1 << 20, 1 << 24, 1 << 20
LAST = np.iinfo(np.int64).max  # a null doc_id is compared as this one
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # odd multipliers


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number; data is contiguous."""
    return np.ndarray(shape=(data.size - 7,), dtype="<u8", buffer=data, strides=(1,))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    w = words_at(data)
    h = w[: data.size - GRAM + 1] * MIX[0]
    h ^= h >> np.uint64(29)
    h += w[GRAM - 8 :] * MIX[1]
    h ^= h >> np.uint64(32)
    h *= MIX[2]
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, anchor's offset from start, anchor's key) of each run of windows with one anchor; ends of documents in data."""
    valid = np.zeros(data.size, bool)
    begin = 0
    for end in ends.tolist():
        if end - begin >= depth:
            valid[begin : end - depth + 1] = True
        begin = end
    found = []
    for s in range(0, max(0, data.size - depth + 1), SEGMENT):
        stop = min(s + SEGMENT, data.size - depth + 1)
        h = grams(data[s : stop + depth - 1])
        low = np.uint64(0xFFFFFFFF)
        least = (h & ~low) | np.arange(h.size, dtype=np.uint64)
        width, need = 1, depth - GRAM + 1
        while width * 2 <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if need > width:
            least = np.minimum(least[: least.size - (need - width)], least[need - width :])
        anchor = (least & low).astype(np.int64)
        own = np.flatnonzero(valid[s:stop])
        if not own.size:
            continue
        a = anchor[own]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 1) | (a[1:] != a[:-1])]))
        found.append((own[edge] + s, np.diff(np.append(edge, own.size)), a[edge] - own[edge], h[a[edge]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def loaded(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, their ends, doc_ids with LAST for null) of a batch in order of its rows."""
    table = table.sort_by("row")
    texts = table.column("text").to_pylist()
    ids = np.array([LAST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64), ids


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows of it) for each part that has rows."""
    order = np.argsort(part, kind="stable")
    if order.size:
        edge = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        for rows in np.split(order, edge[1:]):
            yield int(part[rows[0]]), rows


ASKED = "part int, batch int, keys binary, twice binary"
SHARED = "batch int, keys binary"
SPANS = "part int, batch int, doc_ids binary, rows binary, starts binary, offsets binary, counts binary, keys binary, bytes binary"
MARKS = "batch int, rows binary, starts binary, counts binary, masks binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def ask(table: pa.Table, parts: int) -> pa.Table:
    """Pass 1, from a batch: its keys, each once, with whether two documents of the batch have it."""
    data, ends, _ = loaded(table)
    start, _, _, key = runs(data, ends)
    doc = np.searchsorted(ends, start, "right")
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    twice = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge) if key.size else np.zeros(0, bool)
    key, batch, out = key[edge], table.column("batch")[0].as_py(), []
    for p, rows in dealt(part_of(key, parts)):
        out.append((p, batch, key[rows].tobytes(), twice[rows].tobytes()))
    return _table(out, ASKED)


def answer(table: pa.Table) -> pa.Table:
    """Pass 1, for a part of the keys: to each batch, those of its keys that two documents have."""
    own = [np.frombuffer(b, "<u8") for b in table.column("keys").to_pylist()]
    if not own:
        return _table([], SHARED)
    key = np.concatenate(own)
    twice = np.concatenate([np.frombuffer(b, bool) for b in table.column("twice").to_pylist()])
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    size = np.diff(np.append(edge, key.size))
    many = (size > 1) | np.logical_or.reduceat(twice[order], edge)
    shared = np.zeros(key.size, bool)
    shared[order] = np.repeat(many, size)
    ends, out = np.cumsum([k.size for k in own]), []
    for batch, keys, end in zip(table.column("batch").to_pylist(), own, ends.tolist(), strict=True):
        if (s := shared[end - keys.size : end]).any():
            out.append((batch, keys[s].tobytes()))
    return _table(out, SHARED)


def spans(docs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """Pass 2, from a batch: the bytes of its runs with shared keys. Of equal runs only those of the smallest doc_id go out; the others are known to repeat and are sent on without bytes."""
    if not docs.num_rows or not answers.num_rows:
        return _table([], SPANS)
    data, ends, ids = loaded(docs)
    start, count, offset, key = runs(data, ends)
    known = np.sort(np.concatenate([np.frombuffer(b, "<u8") for b in answers.column("keys").to_pylist()]))
    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), known.size - 1)] == key)
    start, count, offset, key = start[hit], count[hit], offset[hit], key[hit]
    row = np.searchsorted(ends, start, "right")
    doc, first = ids[row], np.concatenate([[0], ends[:-1]])
    whole = data.tobytes()
    spans_ = [whole[s : s + n + DEPTH - 1] for s, n in zip(start.tolist(), count.tolist(), strict=True)]
    least: dict[tuple[int, bytes], int] = {}
    names = list(zip(offset.tolist(), spans_, strict=True))
    for name, d in zip(names, doc.tolist(), strict=True):
        if d < least.get(name, LAST + 1):
            least[name] = d
    own = np.array([least[name] for name in names], np.int64) == doc
    out, batch = [], docs.column("batch")[0].as_py()

    def row_of(p: int, k: np.ndarray, sent: bool) -> tuple:
        return (p, batch, doc[k].tobytes(), row[k].astype("<u4").tobytes(), (start - first[row])[k].astype("<u4").tobytes(), offset[k].astype(np.uint8).tobytes(), count[k].astype(np.uint8).tobytes(), key[k].tobytes() if sent else b"", b"".join([spans_[i] for i in k.tolist()]) if sent else b"")

    for p, k in dealt(part_of(key[own], parts)):
        out.append(row_of(p, np.flatnonzero(own)[k], True))
    if (known_ := np.flatnonzero(~own)).size:
        out.append(row_of(batch % parts, known_, False))
    return _table(out, SPANS)


def all_ones(count: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Passes from the most significant digit over windows at positions of data, first within groups: (windows left, their group), equal group for equal bytes."""
    left = np.argsort(group, kind="stable")
    group = group[left]
    w = words_at(np.concatenate([data, np.zeros(8, np.uint8)]))
    tail = np.uint64((1 << 8 * (depth % 8)) - 1)
    for d in range(-1, -(-depth // 8)):
        if d >= 0:
            digit = w[at[left] + 8 * d]
            if 8 * d + 8 > depth:
                digit &= tail
            order = np.lexsort((digit, group))
            left, group, digit = left[order], group[order], digit[order]
            new = (np.diff(group) != 0) | (digit[1:] != digit[:-1])
        else:
            new = np.diff(group) != 0
        if not left.size:
            break
        edge = np.concatenate([[True], new])
        number = np.cumsum(edge) - 1
        keep = np.bincount(number)[number] > 1
        left, group = left[keep], number[keep]
    return left, group


def match(table: pa.Table) -> pa.Table:
    """Passes 2 to 9, for a part of the keys: to each batch, which windows of its runs a smaller doc_id has."""
    out, sent = [], []
    for r in table.to_pylist():
        count = np.frombuffer(r["counts"], np.uint8).astype(np.int64)
        if r["bytes"]:
            sent.append((r, count))
        else:
            out.append((r["batch"], r["rows"], r["starts"], r["counts"], all_ones(count).tobytes()))
    names: dict[tuple[int, int, bytes], int] = {}
    classes, docs = [], []
    for r, count in sent:
        at, own = 0, []
        for k, (o, n) in zip(np.frombuffer(r["keys"], "<u8").tolist(), zip(r["offsets"], count.tolist(), strict=True), strict=True):
            own.append(names.setdefault((k, o, r["bytes"][at : at + n + DEPTH - 1]), len(names)))
            at += n + DEPTH - 1
        classes.append(np.array(own, np.int64))
        docs.append(np.frombuffer(r["doc_ids"], "<i8"))
    if names:
        least = np.full(len(names), LAST, np.int64)
        np.minimum.at(least, np.concatenate(classes), np.concatenate(docs))
        key = np.array([k for k, _, _ in names], np.uint64)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        number = np.zeros(key.size, np.int64)
        number[order] = np.repeat(np.arange(edge.size), np.diff(np.append(edge, key.size)))
        # only keys with several different runs have anything to compare window by window
        some = np.flatnonzero(np.bincount(number)[number] > 1)
        held = list(names)
        pieces = [held[i] for i in some.tolist()]
        size = np.array([len(p[2]) for p in pieces], np.int64)
        base, n = np.cumsum(size) - size, size - DEPTH + 1
        of = np.repeat(np.arange(some.size), n)
        i = np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
        masks = np.zeros(len(names), np.uint64)
        if some.size:
            off = np.array([p[1] for p in pieces], np.int64)[of] - i
            left, group = equal_windows(np.frombuffer(b"".join([p[2] for p in pieces]), np.uint8), base[of] + i, number[some][of] * 64 + off)
            if left.size:
                edge = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
                doc = least[some[of[left]]]
                first = np.repeat(np.minimum.reduceat(doc, edge), np.diff(np.append(edge, left.size)))
                hit = left[doc > first]
                np.bitwise_or.at(masks, some[of[hit]], np.uint64(1) << i[hit].astype(np.uint64))
        for (r, count), c, d in zip(sent, classes, docs, strict=True):
            mask = np.where(d > least[c], all_ones(count), masks[c])
            if (k := np.flatnonzero(mask)).size:
                out.append((r["batch"], np.frombuffer(r["rows"], "<u4")[k].tobytes(), np.frombuffer(r["starts"], "<u4")[k].tobytes(), count[k].astype(np.uint8).tobytes(), mask[k].tobytes()))
    return _table(out, MARKS)


def strip(docs: pa.Table, marks: pa.Table, text: bool = False) -> pa.Table:
    """From a batch and its marks: each document without the bytes that a repeated window covers."""
    if not docs.num_rows:
        return _table([], RESULT)
    data, ends, _ = loaded(docs)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begins = np.zeros(data.size + 1, np.int32)
    for m in marks.to_pylist():
        at = first[np.frombuffer(m["rows"], "<u4")] + np.frombuffer(m["starts"], "<u4")
        mask = np.frombuffer(m["masks"], "<u8")
        for i in range(int(np.frombuffer(m["counts"], np.uint8).max(initial=0))):
            begins[at[mask >> np.uint64(i) & np.uint64(1) == 1] + i] = 1
    total = np.cumsum(begins[: data.size])
    gone = total - np.concatenate([np.zeros(min(DEPTH, data.size), np.int64), total[:-DEPTH]])[: data.size] > 0
    out = []
    for i, s, e in zip(docs.sort_by("row").column("doc_id").to_pylist(), first.tolist(), ends.tolist(), strict=True):
        g = gone[s:e]
        kept = data[s:e][~g].tobytes()
        n_spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((i, e - s, int(g.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if text else None))
    return _table(out, RESULT)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def stored_by_batch(rows: DataFrame, buckets: int) -> DataFrame:
    """rows in a table bucketed by batch, in the shared folder; table and files go when the driver ends."""
    spark = rows.sparkSession
    name, path = f"tidewatch_{uuid.uuid4().hex}", scratch(spark)
    with released(spark):
        rows.repartition(buckets, "batch").write.bucketBy(buckets, "batch").option("compression", "zstd").option("path", path).saveAsTable(name)
    atexit.register(forget, spark, name)
    return spark.table(name)


def forget(spark, name: str) -> None:
    """Takes a table out of the catalog, unless its session is gone."""
    if spark.getActiveSession() is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeats_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if kept_text.

    A byte goes if a string of 50 bytes that covers it also starts in a row with a smaller doc_id. Null doc_ids count
    as the largest long, after all others; rows of one doc_id remove nothing from each other. Null and empty texts have no bytes. Other
    columns are ignored; an empty table gives no rows. Texts of any length are hashed in segments.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # a batch sends a row to each part, so batches grow with the root of the input: rows then grow with the input, until batches are MOST bytes
    batch_bytes = min(MOST, max(BATCH, int(BATCH * math.sqrt(total / GIB))))
    batches = max(1, -(-total // batch_bytes))
    parts = max(64, batches // 2)
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    held = stored_by_batch(rows, buckets)
    asked = held.groupBy("batch").applyInArrow(lambda t: ask(t, parts), ASKED)
    shared = stored(asked.groupBy("part").applyInArrow(answer, SHARED))
    sent = held.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(lambda a, b: spans(a, b, parts), SPANS)
    marks = stored(sent.groupBy("part").applyInArrow(match, MARKS))
    out = held.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(lambda a, b: strip(a, b, kept_text), RESULT)
    return out if kept_text else out.drop("kept")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats_removed(documents(spark, sf_dir))
