import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    g = list(zip(w, w[1:], w[2:]))
    c, covered = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_measures_are_brute_force(spark, docs, texts):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).select("doc_id", "_m.*", "_base_failed", "_kept").collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r._base_failed) for r in got) == Counter((i, *measures(t)) for i, t, *_ in texts)
    assert all(r._kept == (not r._base_failed) for r in got)  # a label or two certify nothing


def test_long_texts_are_compared_as_text_alike(spark, monkeypatch):
    t = "a b c a b c d e f g a b c"
    df = spark.createDataFrame([(t,)], "t string")
    run = lambda: df.select(quality.repeated_words(F.split("t", " "))).first()[0]
    first = run()
    monkeypatch.setattr(quality, "POSITIONS", 3)  # more words than positions: the other way
    assert first == run() == measures(t)[4]


@pytest.mark.parametrize(("n", "k", "p"), [(50, 0, 0.01), (600, 0, 0.01), (600, 2, 0.01), (5000, 30, 0.01), (20000, 150, 0.01), (10, 9, 0.01)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.at_most(F.lit(k), F.lit(n), p)).first()[0]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1)) if k < n * p else 1.0
    assert math.isclose(got, want, rel_tol=1e-9)


def test_certified_cutoffs(spark):
    rows = [("a", i % 1000 == 0, 400.0 if i < 3 else 10.0) for i in range(4000)] + [("b", True, 10.0) for _ in range(20)]
    good = spark.createDataFrame(rows, "stratum string, drop boolean, symbols double").withColumn("passes", F.lit(True))
    rules = {"symbols": (None, (300, 200, 5))}
    got = quality.certified(good, good.select("stratum").distinct(), rules, alpha=0.01).collect()
    # three of 4000 are well below one in a hundred; all of them are not; twenty labels certify nothing
    assert [(r.stratum, r.cutoff) for r in got] == [("a", 200.0)]


def test_rules_reject_what_good_texts_never_show(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(3000)] + [(3000 + i, " ".join(f"w{i}y{j} $$$$" for j in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 3000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in quality.judged(docs, labels).filter("_kept").collect()}
    assert kept == set(range(3000))


def test_all_good_labels_count(spark):
    # 1,000 good texts suffice at one stratum, half of them would not: 0.02 / 3 and 0.05 / 3 ask for 613
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(1000)] + [(1000 + i, " ".join(f"w{i}y{j} $$$$" for j in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert {r.doc_id for r in quality.judged(docs, labels).filter("_kept").collect()} == set(range(1000))


def test_quality_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(empty, labels).collect() == []


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing out again and again."""
    left, target = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    while True:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]] if w else []
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            return target
        for i in over:
            target[i] = cap * sizes[i]
        left, open_ = left - sum(cap * sizes[i] for i in over), [i for i in open_ if i not in over]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 10, 500], [0, 5, 100000], [1], [7, 7, 7, 7, 7, 7]])
def test_targets_are_filled(spark, sizes):
    names = [*"abcdefgh"[: len(sizes) - 1], None] if len(sizes) > 1 else ["a"]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert all(math.isclose(got[n], w, rel_tol=1e-9, abs_tol=1e-9) for n, w in zip(names, want))


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_sainte_lague(spark, seats):
    votes = [53000.0, 24000.0, 23000.0, 100.0, 0.0, 24000.0]
    df = spark.createDataFrame([(1, f"u{i}", v) for i, v in enumerate(votes)], "all int, u string, votes double")
    got = {r.u: r.quota for r in mixing.apportioned(df, ["all"], ["u"], F.lit(seats)).collect()}
    want = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert [got[f"u{i}"] for i in range(len(votes))] == want


def test_mix(docs, texts):
    got = mixing.mixed(docs, rows_per_shard=20, block=16).collect()
    size = lambda t: len(WORD.findall(t or ""))
    by = Counter()
    for _, t, _, s in texts:
        by[s] += size(t)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in texts)
    names = sorted((s for s in by if s is not None)) + [None]
    want = dict(zip(names, fill([by[s] for s in names], [3, 1, 2][: len(names)])))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    for s in names:
        assert abs(taken[want[s]] - want[s]) <= 0.02 * want[s] + 16 * 8
    again = mixing.mixed(docs.repartition(5), rows_per_shard=20, block=16).collect()
    pick = lambda rows: Counter((r.doc_id, r.size, r.taken) for r in rows if r.doc_id is not None and r.doc_id not in (5, 7))
    assert pick(got) == pick(again)


def test_mix_of_nothing(empty):
    assert mixing.mixed(empty).collect() == []
    assert mixing.in_proportion(empty).collect() == []
