"""Which language a text is in, by the likelihood of its letters in runs of three.

A model is fitted on all labelled rows and holds every run in their texts. Scoring takes whole texts: their runs are met
with the model and added up by text. The GRAMS most frequent runs are broadcast; a model with more has the rest joined by
sorting, where only what is left of the texts, counted by text and run, moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.fixtures import fixture, table
from tidewatch.sources.storage import stored

GRAMS = 40_000  # runs of a model that are broadcast, the most frequent ones; the least number of runs that smoothing reckons with
MARGIN = 0.05  # by which the best language must beat the next, in nats a run
N = 3


def parted(text: Column) -> Column:
    """Words in small letters, and perhaps empty ones at the ends; what is no letter parts words."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+")


def words(text: Column) -> Column:
    """Words in small letters."""
    return F.filter(parted(text), lambda w: w != "")


def grams(word: Column) -> Column:
    """Runs of three of a word with a space at both ends."""
    w = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(w) - (N - 1)), lambda i: F.substring(w, i, F.lit(N)))


def counted(rows: DataFrame, *key: str) -> DataFrame:
    """key, gram, n: how often each run is in the texts of a key. Words are counted first, so that a run is cut out of a word once for each key."""
    each = rows.select(*key, F.explode(parted(F.col("text"))).alias("word")).filter("word <> ''").groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    return each.select(*key, "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy(*key, "gram").agg(F.sum("n").alias("n"))


def fitted(labelled: DataFrame) -> DataFrame:
    """gram, n and scores, how often a run occurs and a map of language to log likelihood: of all rows of labelled (text, lang). Rows without a text or a language are left out."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    by = stored(counted(rows, "lang").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n")))  # an entry for each language
    places = max(GRAMS, by.count())
    totals = by.select(F.explode("by").alias("lang", "m")).groupBy("lang").agg((F.sum("m") + places).alias("total"))  # a row for each language
    langs = totals.agg(F.array_sort(F.collect_list(F.struct("lang", "total"))).alias("langs"))
    score = F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), F.log((F.coalesce(F.try_element_at("by", x["lang"]), F.lit(0)) + 1) / x["total"]).alias("score")))
    return by.crossJoin(F.broadcast(langs)).select("gram", "n", F.map_from_entries(score).alias("scores"))


def identified(rows: DataFrame, model: DataFrame, key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """key, language and margin of each row of (key, text): the likeliest language, null where it does not beat the next by margin, or where no run of the text is known.

    Keys are unique. Null and empty texts have no language; texts of any length count whole. A model of one language
    gives that one wherever a run is known. Texts are dealt by key and move once; their runs are
    added up where they are cut out.
    """
    model = stored(model)
    some = model.select(F.map_keys("scores").alias("langs")).first()
    langs = some.langs if some else []
    names = [f"_{i}" for i in range(len(langs))]
    flat = model.select("gram", "n", *[F.get(F.map_values("scores"), F.lit(i)).alias(x) for i, x in enumerate(names)])  # every run has the same languages, in order
    runs = rows.select(key, "text").repartition(key).select(key, F.explode(F.flatten(F.transform(words(F.col("text")), grams))).alias("gram"))
    if model.count() <= GRAMS:
        met = runs.join(F.broadcast(flat.drop("n")), "gram")
        sums = met.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names])
    else:
        often = stored(flat.orderBy(F.desc("n"), "gram").limit(GRAMS)).drop("n")
        rare = flat.drop("n").join(F.broadcast(often.select("gram")), "gram", "left_anti")
        asked = runs.join(F.broadcast(often.withColumn("_often", F.lit(True))), "gram", "left").withColumn("_rare", F.when(F.col("_often").isNull(), F.col("gram")))
        parts = stored(asked.groupBy(key, "_rare").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names]))  # a row for each text, and for each of its runs that is not broadcast
        late = parts.filter("_rare IS NOT NULL").select(key, F.col("_rare").alias("gram"), "n").join(rare.hint("merge"), "gram")
        both = parts.filter("_rare IS NULL").select(key, "n", *names).unionByName(late.select(key, "n", *[(F.col(x) * F.col("n")).alias(x) for x in names]))
        sums = both.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    each = F.array(*[F.struct((F.col(x) / F.col("n")).alias("score"), F.lit(lang).alias("lang")) for x, lang in zip(names, langs)]) if langs else F.array().cast("array<struct<score:double,lang:string>>")
    best = sums.select(key, F.sort_array(each, asc=False).alias("l"))  # a struct for each language
    first, second = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    ahead = F.coalesce(first["score"] - second["score"], F.lit(math.inf))
    found = best.select(key, F.when(ahead >= margin, first["lang"]).alias("language"), ahead.alias("margin"))
    return rows.select(key).join(found, key, "left")


def document_languages(spark, d: str) -> DataFrame:
    """The language of every document by a model of all labelled ones."""
    docs = table(spark, d, "documents")
    return identified(docs, fitted(docs)).select("doc_id", "language")


def message_languages(spark, d: str) -> DataFrame:
    """The language of every distress message."""
    rows = fixture(spark, d, "distress_messages").select("doc_id", F.col("body").alias("text"))
    return identified(rows, fitted(table(spark, d, "documents"))).select("doc_id", "language")


QUERIES = {"document_languages": (document_languages, None), "message_languages": (message_languages, None)}
