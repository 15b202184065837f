"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: of two fingerprints at distance 2 or less, one segment
differs by at most one bit. The lower segment is indexed with each of its bits as a wildcard; where it differs by two
bits the upper one is equal and is indexed as it stands. Fingerprints meet by equality of a variant, and what meets is
verified. A bucket of more than ROOM distinct fingerprints is not paired: its members are indexed once more by
variants of the bits that are still open, until a group holds at most four fingerprints, so the work grows with the
number of fingerprints and never with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import documents, ship, sorted_too, stored, text_of

WORDS, NEAR, ROOM, SEED, SEGMENT = 3, 2, 128, 42, 32
LOW = (1 << SEGMENT) - 1
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # of each byte value, highest first


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8: bit b is set if it is in more than half the shingles' XXH64; zero without words."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[k:] for k in range(words)])) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
    if len(h) < 64:
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    else:
        at = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
        ones = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp, the fingerprint as a signed 64-bit number, of each row of docs. Null texts count as empty, fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "tie", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("tie"), text_of(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, tie long, fp long")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def without(fp: Column, *places: Column) -> Column:
    for p in places:
        fp = fp.bitwiseAND(F.bitwise_not(bit(p)))
    return fp


def segment_variants(fps: DataFrame) -> DataFrame:
    """fp with (place, key): the lower segment with each of its 32 bits as a wildcard, and under place 32 the upper one as it stands. If the lower segments of a near pair differ by two bits, the upper ones are equal."""
    place = F.col("place")
    key = F.when(place < SEGMENT, without(F.col("fp").bitwiseAND(F.lit(LOW)), place)).otherwise(F.col("fp").bitwiseAND(F.lit(~LOW)))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT))).alias("place")).withColumn("key", key)


def pairs_out(first: int) -> Column:
    """Two different places of the 32 from first on."""
    return F.flatten(F.transform(F.sequence(F.lit(first), F.lit(first + 30)), lambda i: F.transform(F.sequence(i + 1, F.lit(first + 31)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def links(fps: DataFrame, near: int = NEAR, room: int = ROOM) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) at distance 1 or 2, and enough of them in large buckets to join the same components.

    A pair is taken in one bucket only: under its own differing bit of the lower segment, under place 0 if that segment
    is equal, under place 32 if it differs by two. Buckets of up to room members are paired; a larger one is indexed
    once more by variants of the bits it leaves open, and what then meets is linked to the smallest.
    """
    if near != 2:
        raise ValueError("two segments with one wildcard serve a distance of 2")
    index = segment_variants(fps)
    sized = index.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(index.join(sorted_too(sized), ["place", "key"]))
    a, b = F.col("a"), F.col("b")
    differ = a.bitwiseXOR(b)
    low = differ.bitwiseAND(F.lit(LOW))
    own = F.when(low == 0, 0).when(F.bit_count(low) == 1, F.bit_count(low - 1)).otherwise(SEGMENT)
    few = met.filter(F.col("n") <= room)
    pairs = few.select("place", "key", F.col("fp").alias("a")).join(sorted_too(few.select("place", "key", F.col("fp").alias("b"))), ["place", "key"]).filter((a < b) & (F.bit_count(differ) <= near) & (F.col("place") == own)).select("a", "b")
    many = met.filter(F.col("n") > room)
    # one bit of each segment open: a group has four members at most
    one = many.filter(F.col("place") < SEGMENT).select("fp", "place", F.explode(F.sequence(F.lit(SEGMENT), F.lit(63))).alias("q")).select("fp", "place", "q", without(F.col("fp"), F.col("place"), F.col("q")).alias("key"))
    # lower segments equal, or upper ones: two bits of the other are open
    two = many.filter(F.col("place").isin(0, SEGMENT)).select("fp", F.explode(F.when(F.col("place") == 0, pairs_out(SEGMENT)).otherwise(pairs_out(0))).alias("o"))
    two = two.select("fp", F.col("o.i").alias("place"), F.col("o.j").alias("q"), without(F.col("fp"), F.col("o.i"), F.col("o.j")).alias("key"))
    groups = one.unionByName(two).groupBy("place", "q", "key").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    star = groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of each node of edges (a, b), by large-star and small-star rounds until nothing changes. Every round is stored, so lost executors cost one round at most."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(sorted_too(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_too(low), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = stored(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of distance 2 or less), tie (a hash of the text) and stays, whether the row is its component's first.

    Texts without words have fingerprint zero and link like any other. A null doc_id names no component unless all in
    it are null. Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, doc_id, text, words))
    classes = stored(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least")))
    roots = components(links(classes.select("fp")))
    joined = stored(classes.join(sorted_too(roots), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = joined.join(sorted_too(joined.groupBy("root").agg(F.min("least").alias("best"))), "root").select(F.col("fp").alias("_fp"), "best")
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.tie") == F.col("tie"))
    return rows.join(sorted_too(named), F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), "tie", stays.alias("stays"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, among: DataFrame | None = None) -> DataFrame:
    """Of each component the row of docs with the smallest doc_id, then the smallest hash of its text; of rows that are the same in both, one. among: rows of docs, of which these are taken."""
    among = docs if among is None else among
    best = near_dedup(docs, doc_id, text, words).filter("stays").select(F.col("doc_id").alias("_best"), F.col("tie").alias("_best_tie")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in among.columns]).alias("row")
    rows = among.select(row, F.col(f"`{doc_id}`").cast("long").alias("_own"), F.xxhash64(text_of(text)).alias("_tie"))
    kept = rows.join(sorted_too(best), F.col("_own").eqNullSafe(F.col("_best")) & (F.col("_tie") == F.col("_best_tie")), "left_semi")
    return kept.withColumn("_place", F.row_number().over(Window.partitionBy("_own", "_tie").orderBy(F.lit(0)))).filter("_place = 1").select("row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("tie", "stays")
