"""Languages of documents the model has not seen, and what has none; hulls against a plain chain."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.operators import language, rescue


def test_held_out_languages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fitted(docs.filter("doc_id % 2 = 0"))
    assert model.count() <= language.GRAMS
    held = docs.filter("doc_id % 2 = 1")
    met = language.identified(held.select("doc_id", "text"), model).join(held.select("doc_id", "lang"), "doc_id")
    n, right, none = met.agg(F.count(F.lit(1)), F.count_if(F.col("language") == F.col("lang")), F.count_if(F.col("language").isNull())).first()
    assert n == held.count() and right >= 0.97 * n and none <= 0.02 * n


def test_scores_are_those_of_a_plain_count(spark):
    rows = [(1, "aba abc", "x"), (2, "zzz zyz\n", "y"), (3, "abc ABA", "x"), (4, None, "x"), (5, "q", None)]
    model = {r.gram: r.scores for r in language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    n = defaultdict(lambda: defaultdict(int))
    for _, t, lang in rows:
        for w in (t or "").lower().split() if lang else ():
            for i in range(len(w)):
                n[lang][f" {w} "[i : i + 3]] += 1
    grams = {g for c in n.values() for g in c}
    assert set(model) == grams
    for g in grams:
        for lang, c in n.items():
            assert math.isclose(model[g][lang], math.log((c[g] + 1) / (sum(c.values()) + language.GRAMS)))


def test_no_language_without_known_letters(spark):
    model = language.fitted(spark.createDataFrame([(1, "aba abc", "x"), (2, "zzz zyz", "y")], "doc_id long, text string, lang string"))
    rows = [(1, "abc"), (2, None), (3, ""), (4, "12 34 !?"), (5, "qqq"), (6, "abc zzz abc zzz aba zyz"), (7, "zyz " * 30_000), (None, "aba")]
    got = {r.doc_id: r.language for r in language.identified(spark.createDataFrame(rows[:-1], "doc_id long, text string"), model).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[7]) == ("x", None, None, None, None, "y")
    assert language.identified(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def plain(points):
    p = sorted(set(points))
    if len(p) <= 2:
        return p
    out = []
    for side in (p, p[::-1]):
        c = []
        for q in side:
            while len(c) > 1 and (c[-1][0] - c[-2][0]) * (q[1] - c[-2][1]) - (c[-1][1] - c[-2][1]) * (q[0] - c[-2][0]) <= 0:
                c.pop()
            c.append(q)
        out += c[:-1]
    return out


def test_hulls(spark):
    r = random.Random(2)
    clouds = {
        1: [(r.gauss(14, 1), r.gauss(35, 2)) for _ in range(3000)], 2: [(math.cos(i / 20), math.sin(i / 20)) for i in range(120)], 3: [(float(i % 5), float(i // 5)) for i in range(25)],
        4: [(i / 3, i / 3) for i in range(9)], 5: [(1.0, 2.0)] * 4, 6: [(1.0, 2.0), (3.0, 2.0)], 7: [(r.choice([0.0, 1.0]), r.random()) for _ in range(60)],
    }
    rows = [(k, 0, *p) for k, c in clouds.items() for p in c] + [(1, 0, None, 3.0), (1, 0, float("nan"), 3.0), (8, 0, None, None)]
    got = defaultdict(list)
    for x in rescue.hulls(spark.createDataFrame(rows, "run_id long, step int, lon double, lat double").repartition(5)).orderBy("run_id", "vertex").collect():
        got[x.run_id].append((x.lon, x.lat))
    assert set(got) == set(clouds)
    for k, c in clouds.items():
        want = plain(c)
        if k == 5:
            assert len(got[k]) == 5 and got[k][0] == got[k][-1] == (0.99, 1.99)
        else:
            assert got[k] == [*want, want[0]]


def test_only_texts_move_to_be_scored(spark):
    rows = spark.createDataFrame([(1, "the sea the ship", "en"), (2, "das meer das schiff", "de"), (3, "the ship", None), (4, None, None), (5, "xq", None)], "doc_id long, text string, lang string")
    out = language.identified(rows, language.fitted(rows))
    assert {x.doc_id: x.language for x in out.select("doc_id", "language").collect()} == {1: "en", 2: "de", 3: "en", 4: None, 5: None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "word" not in plan


def counts(rows):
    n = defaultdict(lambda: defaultdict(int))
    for _, t, lang in rows:
        for w in t.split():
            for i in range(len(w)):
                n[lang][f" {w} "[i : i + 3]] += 1
    return n


def test_every_labelled_row_counts(spark):
    """More rows than were once drawn of a language, each with a word of its own."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"sea {word(i)}x", "x") for i in range(1300)] + [(i, f"mer {word(i)}y", "y") for i in range(1300, 1400)]
    model = {r.gram: r.scores for r in language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    n = counts(rows)
    assert set(model) == {g for c in n.values() for g in c}
    for g, scores in model.items():
        for lang, c in n.items():
            assert math.isclose(scores[lang], math.log((c[g] + 1) / (sum(c.values()) + language.GRAMS)))


def test_runs_that_are_not_broadcast_count_too(spark, monkeypatch):
    monkeypatch.setattr(language, "GRAMS", 7)
    r = random.Random(3)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 30)))
    rows = [(i, text("abcd" if i % 2 else "cdef"), "x" if i % 2 else "y") for i in range(60)]
    asks = [(i, text(r.choice(["abcd", "cdef", "abef", "qz", "efqz"]))) for i in range(80)] + [(80, ""), (81, None), (82, "q")]
    n = counts(rows)
    known = {g for c in n.values() for g in c}
    assert len(known) > 7
    want = {}
    for i, t in asks:
        runs = [f" {w} "[j : j + 3] for w in (t or "").split() for j in range(len(w))]
        runs = [g for g in runs if g in known]
        best = sorted(((sum(math.log((c[g] + 1) / (sum(c.values()) + len(known))) for g in runs) / len(runs), lang) for lang, c in n.items()), reverse=True) if runs else []
        want[i] = (best[0][1] if best[0][0] - best[1][0] >= language.MARGIN else None, best[0][0] - best[1][0]) if runs else (None, None)
    model = language.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {x.gram for x in model.collect()} == known
    got = {x.doc_id: (x.language, x.margin) for x in language.identified(spark.createDataFrame(asks, "doc_id long, text string"), model).collect()}
    assert set(got) == set(want)
    for i, (lang, ahead) in want.items():
        assert got[i][0] == lang and (got[i][1] is None if ahead is None else math.isclose(got[i][1], ahead, abs_tol=1e-9))
