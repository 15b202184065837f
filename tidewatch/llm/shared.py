"""What the operators of this subpackage have in common: shared storage, null rules, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, as only Spark may reach it; a session that is gone is no error."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone already
        pass


#: Spark's own switches inside released(): a finished query's shuffle files are removed with it, and what the driver keeps of its plan's text is short (a table of 1 MiB in it would be two million characters, at every step of the query).
WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("true", "false"), "spark.sql.maxPlanStringLength": ("20000", str(2**31 - 16))}


@contextmanager
def released(spark: SparkSession):
    """Queries that run inside leave no shuffle files and no long texts behind."""
    before = {k: spark.conf.get(k, default) for k, (_, default) in WHILE_STORING.items()}
    for k, (value, _) in WHILE_STORING.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: lineage ends here and survives lost executors.

    What its job shuffled is of no more use and goes with the job.
    """
    path = scratch(df.sparkSession)
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once for each context; for operators that run Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewatch_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tidewatch-code-")) / "tidewatch.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))  # the driver serves it to executors
    sc._tidewatch_shipped = True


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text. Texts whose only white space is spaces and line ends, as nearly all, are split without a pattern."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c")) | F.contains(text, F.lit("\r"))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
    return F.array_remove(F.when(odd, F.split(text, SPACE, -1)).otherwise(plain), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free(docs: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of docs has (Spark's names do not tell upper and lower case apart)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def near(rows: DataFrame) -> DataFrame:
    """For joins: rows, broadcast only if they are 10,000 at most."""
    return F.broadcast(rows) if rows.limit(10_001).count() <= 10_000 else rows


def sorted_too(rows: DataFrame) -> DataFrame:
    """For joins: rows, never broadcast. Spark takes a table that was exploded or packed well for much smaller than it is, and would build it whole in the driver."""
    return rows.hint("merge")


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows of df whose vector is there and holds finite components only."""
    v = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.filter(v.isNotNull() & F.forall(v.cast("array<double>"), finite))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
