"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose measure exceeds a cutoff. For each stratum (a language) and rule, cutoffs are tested
from the loosest to the strictest on all texts labelled good, as nothing else is fitted: the exact binomial probability of at most the
seen number of false rejections, were the true rate ALPHA / rules, must not exceed DELTA / (strata * rules). The first
cutoff that fails ends the sequence, so no correction is needed within it, and Bonferroni's covers the rest: with
probability 1 - DELTA, no stratum loses more than ALPHA of its good texts to all rules together. A stratum without
enough labels certifies nothing and rejects nothing by these rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.shared import documents, let, near, stored, text_of, words_of

ALPHA, DELTA = 0.02, 0.05
POSITIONS = 24  # bits of a packed word position
#: Measures in parts per 1000 and their cutoffs, loosest first; fixed before any label is seen.
RULES = {
    "symbols": (lambda m: 1000 * m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)), (300, 200, 150, 100, 70, 50, 30, 20)),
    "lines": (lambda m: 1000 * m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), (800, 600, 500, 400, 300, 200)),
    "repeats": (lambda m: 1000 * m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1)), (500, 400, 300, 250, 200, 150, 100)),
}


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three that occurs twice or more in words.

    Windows are first compared by the top 40 bits of their hash, packed with the position into one sortable number;
    those with an equal neighbour are then compared as text. From 2^24 words on, all are compared as text.
    """
    low = (1 << POSITIONS) - 1

    def counted(w: Column) -> Column:
        three = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        packed = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        near = lambda s, x, i: F.coalesce(F.shiftright(x, POSITIONS) == F.shiftright(F.get(s, i - 1), POSITIONS), F.lit(False)) | F.coalesce(F.shiftright(x, POSITIONS) == F.shiftright(F.get(s, i + 1), POSITIONS), F.lit(False))
        hashed = let(F.sort_array(packed), lambda s: F.transform(F.filter(s, lambda x, i: near(s, x, i)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
        at = F.when(F.size(w) < low, hashed).otherwise(F.sequence(F.lit(0), F.size(w) - 3))
        same = lambda t, x, i: F.coalesce(x["g"] == F.get(t, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(t, i + 1)["g"], F.lit(False))
        starts = let(F.array_sort(F.transform(at, lambda p: F.struct(three(p).alias("g"), p.alias("p")))), lambda t: F.sort_array(F.transform(F.filter(t, lambda x, i: same(t, x, i)), lambda x: x["p"])))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, counted)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed in the struct column _m.

    Null and empty texts have no words and fail the base rule.
    """
    t = text_of(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("_w", words_of(t)).withColumn("_l", lines)
    d = d.withColumn(
        "_m",
        F.struct(
            F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_w")).alias("n_repeat_words"), F.size("_l").cast("long").alias("n_lines"),
        ),
    ).drop("_w", "_l")
    return d


def base_failed(m: str = "_m") -> Column:
    n = F.col(f"{m}.n_words")
    return (n < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * n)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, to about 1e-13."""
    m = n + F.lit(11.0)
    series = (m - 0.5) * F.log(m) - m + 0.9189385332046728 + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * m * m * m * m * m)
    down = n + F.lit(1.0)
    for k in range(2, 11):
        down = down * (n + F.lit(float(k)))
    return series - F.log(down)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial of n and rate, for k below n * rate (else 1): terms from k down, and a bound for those left out."""
    k, n = k.cast("double"), n.cast("double")
    term = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate)))
    steps = F.least(k, F.ceil(50 * F.sqrt(n)) + 50).cast("int")
    ratio = lambda j: j / (n - j + 1) * ((1 - rate) / rate)
    start = F.struct(term.alias("t"), term.alias("s"))
    step = lambda a, i: F.struct((a["t"] * ratio(k - i + 1)).alias("t"), (a["s"] + a["t"] * ratio(k - i + 1)).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(1), steps), start, step)
    total = F.when(steps < 1, term).otherwise(tail["s"] + tail["t"] * F.when(k > steps, ratio(k)/ (1 - ratio(k))).otherwise(0.0))
    return F.when(k < n * rate, F.least(total, F.lit(1.0))).otherwise(F.lit(1.0))


def certified(good: DataFrame, strata: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The strictest certified cutoff of each rule and stratum: stratum, rule, cutoff.

    good: good texts, a row each: stratum, passes (whether it passes the base rule; the others do not count) and a column for each rule. strata: all strata that are tested.
    """
    tests = len(rules)
    hits = [F.count_if(F.col("passes") & (F.col(rule) > cut)).alias(f"{rule}_{i}") for rule, (_, cuts) in rules.items() for i, cut in enumerate(cuts)]
    counts = good.groupBy("stratum").agg(F.count_if("passes").alias("n"), *hits).filter("n > 0")
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, (_, cuts) in rules.items() for i, cut in enumerate(cuts)])
    seen = counts.select("stratum", "n", F.inline(rows)).crossJoin(strata.agg(F.count(F.lit(1)).alias("strata")))
    passes = at_most(F.col("k"), F.col("n"), alpha / tests) <= F.lit(float(delta)) / (F.col("strata") * tests)
    so_far = Window.partitionBy("stratum", "rule").orderBy("place")
    held = seen.withColumn("passes", F.min(passes).over(so_far)).filter("passes")
    return held.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs with the struct column _m of measures, and columns _base_failed and _kept; columns of docs that have these names give way.

    labels: doc_id, quality (1 good). All good labels count; null labels and ids count for nothing, a repeated label once per row of docs. A null stratum is one stratum. Without labels nothing is
    certified and only the base rule rejects. Every row of docs gives one row, repeated rows each; tables may be empty.
    """
    own = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("_m", "_base_failed", "_kept")])
    return whole(docs, labels, doc_id, text, stratum, rules, alpha, delta).select(*[F.col(f"row.`{c}`").alias(c) for c in own.columns], "_m", "_base_failed", "_kept")


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """The rows of docs that no rule rejects, as they are whatever their columns are called; cases as in judged()."""
    kept = F.coalesce("_kept", F.lit(False))  # as one whole: the optimizer would work out a part of it twice
    return whole(docs, labels, doc_id, text, stratum, **how).filter(kept).select("row.*")


def whole(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, stratum: str, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """row (all columns of docs in one), doc_id, stratum, _m, _base_failed and _kept."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{stratum}`").alias("lang"))
    m = measured(plain)
    return ruled(m, stored(m.select("doc_id", "lang", "_m")), labels, rules=rules, alpha=alpha, delta=delta)


def ruled(m: DataFrame, small: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """judged() of measured rows m. small: their doc_id, stratum and _m, stored, so that only numbers meet the labels."""
    measures = {rule: measure(F.col("_m")) for rule, (measure, _) in rules.items()}
    chosen = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_good")).distinct()
    tried = small.join(chosen, F.col(doc_id) == F.col("_good"), "left_semi")
    good = tried.select(F.col(stratum).alias("stratum"), (~base_failed()).alias("passes"), *[v.alias(k) for k, v in measures.items()])
    cutoffs = certified(good, small.select(F.col(stratum).alias("stratum")).distinct(), rules, alpha, delta)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(rules)).agg(F.min("cutoff")).select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_cut_{r}") for r in rules])
    out = m.join(near(stored(wide)), F.col(stratum).eqNullSafe(F.col("_s")), "left")
    rejected = F.lit(False)
    for rule, measure in measures.items():
        rejected = rejected | F.coalesce(measure > F.col(f"_cut_{rule}"), F.lit(False))
    return out.withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & ~rejected).drop("_s", *[f"_cut_{r}" for r in rules])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    m = stored(measured(documents(spark, sf_dir)).select("doc_id", "lang", "_m"))
    d = ruled(m, m, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return d.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
