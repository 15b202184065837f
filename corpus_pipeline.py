"""The corpus pipeline: documents in, token ids out, in five stages of the llm subpackage's operators.

Each stage takes and, but for the last, returns the columns of documents, whatever further ones there are; an empty
table gives an empty one. Repeated rows are rows like any other until near-dedup, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, line_dedup, mixing, quality, simhash
from tidewatch.llm.shared import WORD, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects, as they are. Null and empty texts have no words and go; a null language is one language; texts of any length are measured whole."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_level(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that are similar to an earlier one; n_chars follows, and what has no word left goes, null texts too. Null ids come first; equal rows lose the same lines."""
    out = line_dedup.deduplicated(docs).filter(F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the first of those their SimHash links them to, by doc_id (null first, ties by a hash of the text), and whose shingles of five words are not similar to an earlier one's, at a Jaccard similarity of 0.8 or more.

    Fingerprints of shingles of five words link at two different bits or fewer. They miss most pairs at 0.8, so an exact
    join of shingles follows, over all documents: what one of the two finds goes. Empty and null texts are copies of
    each other; of rows that are the same in id and text one stays.
    """
    return simhash.one_of_each(docs, words=5, among=stored(line_dedup.one_of_each(docs, words=5)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources near their targets, no document more than twice. Texts without words are not taken; a null source is a source."""
    return mixing.in_proportion(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded text of each document; null texts have no ids."""
    return bpe.round_trip(docs, ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_level), ("near-dedup", near_copies), ("mixing sources", source_mix), ("bpe encoding", token_ids)]

#: No SQL: similarity of texts, seeded blocks and BPE are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
