"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Each group of at least 1/UNITS of all bytes (so UNITS of them at most) is a unit
of its own; the rest, by a hash of the text, form BINS units. These at most UNITS + BINS units, whatever the size of
the input, go by size to the least-loaded shard through a heap on the driver; rows learn their shard from tables of
that bounded size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import documents, stored, text_of

SHARDS, UNITS, BINS, ROWS = 8, 4096, 8192, 2000
LAWS = ("bytes", "rows", "key")


def longest_first(sizes: list[tuple[int, object]], shards: int) -> dict:
    """The shard of each unit (size, name): by falling size, then name, to the shard that holds least, the first on ties."""
    heap = [(0, k) for k in range(shards)]
    place = {}
    for size, name in sorted(sizes, key=lambda u: (-u[0], str(u[1]))):
        load, k = heap[0]
        place[name] = k
        heapq.heapreplace(heap, (load + size, k))
    return place


def numbered(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, by parts of a shard of about ROWS rows: no task numbers a whole shard."""
    parts = max(64, rows.count() // ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "row"))
    return rows.withColumn("within", within).join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("within") - 1)


def sharded(docs: DataFrame, law: str = "bytes", shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law "bytes": equal texts share a shard and sizes are as near equal as longest-processing-time scheduling makes
    them (a single group larger than a shard's share makes its shard larger). "rows": as bytes, with rows for sizes
    and no groups, so that counts differ by one at most. "key": doc_id and the number of shards alone decide by
    rendezvous hashing, and grown_shard is the shard under one shard more, which takes rows only into itself.
    Null texts count as empty with size 1; a null doc_id hashes as a value of its own; repeated rows share a shard
    but under "rows". Slots follow a hash of the rows, so reruns over rows stored alike agree. An empty table gives no rows.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    plain = text_of(text).cast("binary")
    rows = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(plain) + 1).cast("long").alias("size"),
            F.crc32(plain).alias("text_crc32"), F.unhex(F.sha2(plain, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"),
        )
    )
    spark = docs.sparkSession
    grown = F.lit(None).cast("int")
    if law == "key":
        drawn = lambda n: F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(k), "doc_id").alias("draw"), F.lit(k).alias("k")) for k in range(n)]))["k"]
        rows, grown = rows.withColumn("shard", drawn(shards)), drawn(shards + 1)
    elif law == "rows":
        parts = max(64, rows.count() // ROWS)
        part = F.pmod(F.xxhash64(F.lit(13), "row"), F.lit(parts)).cast("int")
        sizes = rows.groupBy(part.alias("dealt")).agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("dealt", (F.sum("n").over(Window.orderBy("dealt")) - F.col("n")).alias("ahead"))
        place = F.row_number().over(Window.partitionBy("dealt").orderBy("doc_id", "row"))
        rows = rows.withColumn("dealt", part).withColumn("place", place).join(before, "dealt")
        rows = rows.withColumn("shard", F.pmod(F.col("ahead") + F.col("place"), F.lit(shards)).cast("int")).drop("dealt", "place", "ahead")
    else:
        groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
        total = rows.agg(F.sum("size")).first()[0] or 0
        bin_of = F.pmod(F.xxhash64("digest"), F.lit(BINS)).cast("int")
        large = F.col("bytes") * UNITS >= total
        units = groups.groupBy(F.when(~large, bin_of).alias("bin"), F.when(large, F.col("digest")).alias("whole")).agg(F.sum("bytes").alias("bytes"))
        met = [(u["bytes"], u["bin"] if u["whole"] is None else bytes(u["whole"])) for u in units.collect()]  # UNITS + BINS at most
        place = longest_first(met, shards)
        whole = spark.createDataFrame([(bytearray(k), v) for k, v in place.items() if isinstance(k, bytes)], "digest binary, own int")
        bins = spark.createDataFrame([(k, v) for k, v in place.items() if isinstance(k, int)], "bin int, binned int")
        rows = rows.withColumn("bin", bin_of).join(F.broadcast(whole), "digest", "left").join(F.broadcast(bins), "bin", "left").withColumn("shard", F.coalesce("own", "binned"))
    return numbered(rows).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), grown.cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
