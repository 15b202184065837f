"""Exact dedup by content-defined chunk recipes.

Each text is cut where its own content says so: a chunk runs for at least MIN code points and then to the next
end that the text itself marks, MAX code points at most. Chunks are reduced to one row per distinct content, which verifies that an
identifier stands for one content only; after that, texts are compared by their ordered lists of identifiers, so
long texts move once, as chunks, and never as whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import SPACE, documents, let, stored, text_of

MIN, MAX, SHARES = 64, 2048, 64
#: A chunk ends with a mark after one of a few letters and digits, or with one of the rarer marks: seldom enough that chunks find the same ends again after a change before them.
ENDS = "[dfgrty0379][.!?;:…]|[。！？؟।]"


def chunks_of(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The chunks of a text in order; they join to the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least - 1}}}.{{0,{most - least}}}?(?:{ENDS})|.{{1,{most}}}"), F.lit(0))


def clashes(chunks: DataFrame) -> DataFrame | None:
    """Of rows (key, chunk), a row for each distinct chunk whose key also stands for another: key, chunk, place. None if there is no such key, as nearly always."""
    distinct = chunks.groupBy("key", "chunk").agg(F.lit(1).alias("one"))
    shared = stored(distinct.groupBy("key").agg(F.count("one").alias("n")).filter("n > 1").select("key"))
    if shared.isEmpty():
        return None
    # a key's distinct contents are few even where its copies are many
    return stored(distinct.join(shared, "key", "left_semi").select("key", "chunk", F.row_number().over(Window.partitionBy("key").orderBy("chunk")).alias("place")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after all white space is deleted. Of equal texts the one with most code
    points stays, then the smallest doc_id (null counts as largest); of rows that are the same in both, exactly
    one stays. Null texts count as empty, and all texts without a word form one group. An empty table gives no
    rows. Texts of any length are cut whole, and move as chunks. Other columns of docs are ignored whatever their names. key gives a chunk's first identifier.
    """
    norm = F.regexp_replace(text_of(text), SPACE, "")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.length(text_of(text)).alias("n_code"), norm.alias("norm"))
    cut = rows.select(F.explode(chunks_of(F.col("norm"))).alias("chunk")).select(key("chunk").cast("long").alias("key"), "chunk")
    clash = clashes(cut)
    digest = stored(
        rows.select(
            "doc_id", "n_code", F.monotonically_increasing_id().alias("row"), F.sha2("norm", 256).alias("text_sha256"),
            let(chunks_of(F.col("norm")), lambda c: F.concat(F.array(F.size(c).cast("long")), F.transform(c, lambda x: key(x)).cast("array<long>"))).alias("recipe"),
            *([] if clash is None else [chunks_of(F.col("norm")).alias("chunks")]),
        )
    )
    if "chunks" in digest.columns:
        # identifiers that stand for several contents: the content's place among them follows the recipe's [number, identifiers]
        met = digest.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("key", key("chunk").cast("long"))
        fixed = met.join(clash, ["key", "chunk"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "place"))).alias("places"))
        digest = stored(digest.drop("chunks").join(fixed, "row", "left").withColumn("recipe", F.concat("recipe", F.coalesce(F.transform("places", lambda x: x["at"].cast("long") * 4294967296 + x["place"]), F.array().cast("array<long>")))).drop("places"))
    # a recipe's rows are dealt to SHARES, reduced there, and only then brought together, so that no recipe is one task
    digest = digest.withColumn("share", F.pmod("row", F.lit(SHARES)))
    best = F.min(F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    shares = digest.groupBy("recipe", "share").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    recipe = Window.partitionBy("recipe")
    groups = shares.select(F.col("recipe").alias("_recipe"), F.col("share").alias("_share"), F.min("best").over(recipe).alias("best"), F.sum("n").over(recipe).alias("group_size"))
    return digest.join(groups, (F.col("recipe") == F.col("_recipe")) & (F.col("share") == F.col("_share"))).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS place,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
