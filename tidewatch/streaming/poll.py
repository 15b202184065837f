"""Polls of a stream: each gives what is new since the last one that was acknowledged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Poll:
    """A consumer with a folder of its own for the stream's checkpoint, the batches read and the last one acknowledged.

    A batch is written under its number, so one that comes again replaces itself. take() reads on to the end of the
    source and gives the rows of all batches after the last acknowledged one; done() acknowledges them. A consumer that
    ends between the two gets the same rows again, with what has come since.
    """

    def __init__(self, stream: DataFrame, root: str) -> None:
        self.stream, self.root, self.spark = stream, root, stream.sparkSession
        self.last = -1

    def acknowledged(self) -> int:
        marks = self.spark.read.schema("batch long").option("recursiveFileLookup", True).json(f"{self.root}/acknowledged/*") if self._some("acknowledged") else None
        return -1 if marks is None else marks.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def _some(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def take(self) -> DataFrame:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{self.root}/batches/batch={n}")
        query = self.stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if not self._some("batches"):
            return self.spark.createDataFrame([], self.stream.schema)
        # folders of batches are partitions, so acknowledged ones are not read
        rows = self.spark.read.schema(self.stream.schema.add("batch", "long")).parquet(f"{self.root}/batches").filter(F.col("batch") > self.acknowledged())
        self.last = rows.agg(F.max("batch")).first()[0]
        return rows.drop("batch")

    def done(self) -> None:
        if self.last is not None and self.last >= 0:
            self.spark.range(1).select(F.lit(self.last).cast("long").alias("batch")).write.mode("overwrite").json(f"{self.root}/acknowledged/{self.last}")
