"""A table by key that a stream writes into, kept in buckets so that a batch costs what it brings.

The table is a folder of versions, v=<batch number>, each with the buckets that its batch touched. A bucket's rows are
those of its newest version whose write came to its end. A batch reads and writes the buckets of its keys only; a batch
that comes again finds the same rows before it and writes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.storage import remove

BUCKETS = 256


def folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(bucket, version, folder) of every whole version, from the names of folders."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for v in store.listStatus(top) if store.exists(top) else ():
        inside = {p.getPath().getName(): str(p.getPath()) for p in store.listStatus(v.getPath())}
        if v.getPath().getName().startswith("v=") and "_SUCCESS" in inside:
            found += [(int(n[7:]), int(v.getPath().getName()[2:]), at) for n, at in inside.items() if n.startswith("bucket=")]
    return found


def newest(found: list[tuple[int, int, str]], before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, of those before a batch if one is given."""
    out: dict[int, int] = {}
    for b, v, _ in found:
        if before is None or v < before:
            out[b] = max(v, out.get(b, -1))
    return out


def rows_of(spark: SparkSession, path: str, schema: str, found: dict[int, int]) -> DataFrame:
    paths = [f"{path}/v={v}/bucket={b}" for b, v in sorted(found.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it stands."""
    return rows_of(spark, path, schema, newest(folders(spark, path)))


def merge_into(path: str, schema: str, key: str, order: tuple[str, ...], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch gives each key, column by column, its last value by order that is not null. If the batch's last row is later than the table's, its values win where it has any; else they only fill what is null."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]).withColumn("bucket", bucket(key, buckets))
        last = last.persist()
        try:
            touched = {r["bucket"] for r in last.select("bucket").distinct().collect()}  # at most as many as there are
            before = {b: v for b, v in newest(folders(spark, path), number).items() if b in touched}
            old = rows_of(spark, path, schema, before).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
            both = last.drop("bucket").join(old, F.col(key) == F.col("_key"), "full_outer")
            later = F.coalesce(F.struct(*order) >= F.struct(*[f"_{c}" for c in order]), F.col("_key").isNull())
            pick = [F.when(later, F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))).alias(c) for c in columns]
            out = both.select(F.coalesce(key, "_key").alias(key), *pick).withColumn("bucket", bucket(key, buckets))
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        finally:
            last.unpersist()
        tidy(spark, path, number)

    return merge


def tidy(spark: SparkSession, path: str, number: int) -> None:
    """Removes buckets that neither the table nor a repeat of this batch reads."""
    found = folders(spark, path)
    now, before = newest(found), newest(found, number)
    for b, v, at in found:
        if v not in (now.get(b), before.get(b)):
            remove(spark, at)
