import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import chat, line_dedup, simhash


def split(t):
    for c in "\t\x0b\x0c\r\n":
        t = t.replace(c, " ")
    return {w for w in t.split(" ") if w}


def late_lines(texts, tie, least=1):
    """By brute force over all pairs: (doc_id, tie) and places of the lines that go."""
    rows = sorted({(i is not None, i or 0, tie[t or ""], t or "") for i, t in texts})
    lines = [(r[:3], k, split(x)) for r in rows for k, x in enumerate(r[3].split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    gone = defaultdict(list)
    for n, (row, k, s) in enumerate(lines):
        if any(9 * len(s & t) >= 4 * (len(s) + len(t)) for _, _, t in lines[:n]):
            gone[row].append(k)
    return {(i if there else None, mark): sorted(ks) for (there, i, mark), ks in gone.items()}


def ties(spark, texts):
    return {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


@pytest.mark.parametrize("how", [{}, {"room": 2, "wide": 2, "heads": 1}], ids=["plain", "crowded"])
def test_lines_are_brute_force(spark, docs, texts, how):
    rows = [(i, t) for i, t, *_ in texts if t is None or len(t) < 50_000]
    df = docs.filter("text IS NULL OR length(text) < 50000")
    got = {(r.doc_id, r.tie): r.removed for r in line_dedup.removals(df, **how).collect()}
    assert got == late_lines(rows, ties(spark, rows))
    out = line_dedup.deduplicated(df, **how)
    assert out.columns == df.columns and out.count() == df.count()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similar_lines(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [r.sample(vocabulary, r.randrange(4, 25)) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            line = list(r.choice(base))
            for _ in range(r.randrange(0, 4)):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            lines.append(" ".join(line + line[: r.randrange(3)]))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = late_lines(rows, ties(spark, rows))
    for how in ({}, {"room": 2, "wide": 1, "heads": 1}):
        assert {(x.doc_id, x.tie): x.removed for x in line_dedup.removals(df, **how).collect()} == want


def test_lines_of_nothing(empty):
    assert line_dedup.deduplicated(empty).collect() == []


NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "<|m|>", "<\\|m|>", "<", "\\", "", "a</s", ">", "[[INST]", "[\\INST]", "<s><s>\n<|m|>", "é</s>😀", None]


def test_formatting_is_reversible(spark):
    rows = [(c, t, ["user", "assistant", "<s>", None][(c + t) % 4], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(20) for t in range(c % 7)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.reconstructed(chat.log_of(df)))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        spans = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        assert len(spans) == sum(t[1] == "assistant" for t in turns)


def test_events_fold(spark):
    e = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", None, "lo"), (1, 3, 1, "delta", "assistant", "bad"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "good"),
        (1, 6, 2, "delta", "user", "more"), (1, 7, 0, "edit", None, "Hello!"), (2, 1, 0, "delta", "user", "q"), (2, 2, 1, "delta", "assistant", "old"), (2, 3, 2, "delta", "user", "gone"), (2, 4, 1, "regenerate", None, "new"),
        (2, 5, 1, None, None, "er"), (3, None, 0, "delta", None, None),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, turn long, op string, role string, text string")
    got = sorted(tuple(r) for r in chat.reconstructed(df).select("conv_id", "turn", "role", "text").collect())
    assert got == [(1, 0, "user", "Hello!"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (2, 0, "user", "q"), (2, 1, "assistant", "newer"), (3, 0, "", "")]
    assert chat.formatted(chat.reconstructed(df.filter("false"))).collect() == []


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    footer = line(12)
    rows = [(i, line(70) + "\n" + footer, "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(60 + i, rows[i][1], "en", "s0", 0) for i in range(10)]  # copies
    near = " ".join(dict.fromkeys(line(3000).split(" ")))
    rows += [(80, near, "en", "s1", 0), (90, "too short", "en", "s1", 0), (91, "same again " * 60, "en", "s1", 0), (92, None, "en", None, 0)]
    root = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{root}/out{k}")
        docs = spark.read.parquet(f"{root}/out{k}")
        seen.append(docs.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    ids = [sorted(x.doc_id for x in s) for s in seen]
    assert ids[0] == [*range(70), 80]  # what is short or repeats itself goes, clean texts stay
    assert ids[1] == [*range(60), 80]  # nothing is left of copies
    by = {x.doc_id: x.text for x in seen[1]}
    assert footer in by[0] and all(footer not in by[i] for i in range(1, 60)) and by[5] == rows[5][1].split("\n")[0]
    assert ids[2] == ids[1]  # texts that are unlike each other all stay
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in ids[3]) <= 2
    assert ids[4] == ids[3] and all(len(x.ids) == x.n_tokens > 0 for x in seen[4])
    assert corpus_pipeline.run(spark, root).count() == len(seen[4])


def shingles(t):
    w = split_all(t)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def split_all(t):
    for c in "\t\x0b\x0c\r\n":
        t = t.replace(c, " ")
    return [w for w in t.translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]


def planted(seed, bases, of=150):
    """(doc_id, text) of base texts and, for each, near copies with a few words changed; a hot text has many."""
    r = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(of // 2, of * 2))]
        for copy in range(100 if b == 0 else 4):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 40) if copy else 0):
                w[r.randrange(len(w))] = f"x{r.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [(9000, ""), (9001, None), (9002, "Four Words Are Few"), (9003, "four words are few"), (9004, "four words are"), (9005, "a b c d e f g h i"), (5, rows[5][1])]


def kept_by_force(rows):
    order = sorted(((i, shingles(t or "")) for i, t in rows), key=lambda x: x[0])
    return [i for n, (i, s) in enumerate(order) if not any(5 * len(s & t) >= 4 * len(s | t) for _, t in order[:n])]


@pytest.mark.parametrize("how", [{}, {"room": 3, "wide": 2, "heads": 1}], ids=["plain", "crowded"])
def test_near_copies_at_four_fifths(spark, how):
    rows = planted(4, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in line_dedup.one_of_each(df, **how).collect())
    assert got == kept_by_force(rows)
    again = corpus_pipeline.near_copies(spark, df, "").collect()
    assert sorted(r.doc_id for r in again) == got


def test_near_copies_are_linked_by_simhash_and_by_shingles(spark, monkeypatch):
    r = random.Random(12)
    long = [f"w{r.randrange(10**6)}" for _ in range(900)]
    rows = [(1, " ".join(long)), (2, " ".join(long).upper()), (3, " ".join(f"v{r.randrange(10**6)}" for _ in range(40))), (4, " ".join([*long[:100], *long[820:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(x.doc_id for x in corpus_pipeline.near_copies(spark, df, "").collect())
    assert kept() == [1, 3, 4]
    monkeypatch.setattr(corpus_pipeline.line_dedup, "one_of_each", lambda docs, **_: docs)
    near = {x.doc_id: x.component_id for x in simhash.near_dedup(df, words=5).collect()}
    assert kept() == sorted(i for i, c in near.items() if i == c) == [1, 3, 4]


def test_short_lines_go_too(spark):
    short = ["Read more", "read more", "all rights are reserved", "reserved are rights all", "all rights are reserved here", "こんにちは世界。", "", " ", "x", "x x", "a b c", "a b c d"]
    r = random.Random(6)
    rows = [(i, "\n".join(r.choice(short) for _ in range(r.randrange(1, 6)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mark = ties(spark, rows)
    want = late_lines(rows, mark, least=1)
    got = line_dedup.marked(df, ["doc_id"], "doc_id", "text", {"room": 2, "wide": 1, "heads": 1}, "removed").collect()
    assert {r.doc_id: r.removed for r in got} == {i: want.get((i, mark[t]), []) for i, t in rows}
    assert sum(set(x.split()) == {"x"} for r in line_dedup.deduplicated(df).collect() for x in r.text.split("\n")) == 1


def test_tokens_hash_each_word_once(spark):
    df = spark.createDataFrame([("a b c a  d\tb",), ("",), ("x",)], "line string")
    lines = df.select("line", F.lit(0).alias("id"))
    levels = line_dedup.rarity(lines, classes=1 << 10)
    out = df.select(line_dedup.tokens(F.col("line"), levels).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    got = [r.t for r in out.collect()]
    assert [len(t) for t in got] == [4, 0, 1] and all(t == sorted(set(t)) for t in got)
    assert all(levels[x & 1023] == x >> 56 for t in got for x in t)


def test_pairs_are_sieved_by_stored_tokens(spark, monkeypatch):
    r = random.Random(9)
    common, rows = [f"c{k}" for k in range(400)], []
    for i in range(80):  # long lines that have a rare word in common, some of them near copies, and short lines
        if i % 4 == 1:
            line = [w if r.random() > 0.02 * (i % 11) else f"y{r.randrange(10**6)}" for w in rows[-1][1].split(" ")]
        else:
            line = [f"r{i // 8}", *r.sample(common, 150), *(f"u{r.randrange(10**6)}" for _ in range(60))] if i % 4 else r.sample(common[:9], r.randrange(1, 9))
        rows.append((i, " ".join(line)))
    sets = [split(t) for _, t in rows]
    pairs = [(a, b, -(-4 * (len(sets[a]) + len(sets[b])) // 9)) for a in range(80) for b in range(a)]
    similar = {(a, b) for a, b, least in pairs if len(sets[a] & sets[b]) >= least}
    lines = spark.createDataFrame(rows, "id long, line string").withColumn("first", F.col("id"))
    t = line_dedup.tokens(F.col("line"), line_dedup.rarity(lines))
    n = F.size("t")
    stored = lines.select("id", t.alias("t")).select("id", n.alias("n"), F.slice("t", F.lit(1), line_dedup.reach(n) + line_dedup.DEEP - 1).alias("prefix"))
    left = {(x.a, x.b) for x in line_dedup.sieved(spark.createDataFrame(pairs, "a long, b long, least long"), stored).collect()}
    assert similar and similar <= left
    assert not [(a, b) for a, b in left - similar if min(len(sets[a]), len(sets[b])) > 100 and len(sets[a] & sets[b]) < 120]
    texts = []  # of pairs that only a rare word brings together, no text is read
    monkeypatch.setattr(line_dedup, "agreeing", lambda pairs, lines, shingle: texts.append(lines.count()) or pairs.select("late"))
    far = spark.createDataFrame([p for p in pairs if (p[0], p[1]) not in left], "a long, b long, least long")
    assert line_dedup.verified(far, lines, stored, 0).count() == 0 and set(texts) == {0}


def test_smaller_sets_meet_others_with_a_shorter_prefix(spark, monkeypatch):
    r = random.Random(5)
    sizes = [r.randrange(4, 60) for _ in range(300)]
    posts = [(k, a, n, i, 0) for a, n in enumerate(sizes) for i, k in enumerate(sorted(r.sample(range(200), min(n, 99))[: n // 5 + 1]))]
    df = spark.createDataFrame(posts, "key long, id long, n int, i int, bits long")
    need = lambda n, m: -(-4 * (n + m) // 9)
    want = {
        (a, b, need(n, m))
        for k, a, n, i, _ in posts
        for l, b, m, j, _ in posts
        if k == l and (n, a) < (m, b) and 5 * n >= 4 * m and min(n - i, m - j) >= need(n, m)
    }
    mode, smallest = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(mode, -1)
    try:
        out = line_dedup.calm_pairs(df, 1)
        assert {tuple(x) for x in out.collect()} == want
    finally:
        spark.conf.set(mode, smallest)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1  # both sides are dealt once, and only then is the smaller one cut
    short = sum(i <= n // 9 for _, _, n, i, _ in posts)
    monkeypatch.setattr(line_dedup, "may_be", lambda x, y, level: F.lit(True))
    met = line_dedup.calm_pairs(df, 1).select("a").distinct().count()
    assert short < len(posts) and met <= len({a for _, a, n, i, _ in posts if i <= n // 9})
    every = [(k, a, n, i, b, m) for k, a, n, i, _ in posts for l, b, m, _, _ in posts if k == l and (n, a) < (m, b)]
    assert line_dedup.calm_pairs(df, 1).count() == sum(i <= n // 9 for _, _, n, i, _, _ in every) < len(every)


def test_filters_in_whole_numbers_are_those_of_need(spark):
    for s in range(2, 3000):
        least = -(-4 * s // 9)
        assert all((9 * left >= 4 * s) == (left >= least) for left in (least - 1, least, least + 1))
        assert all((9 * bits <= s) == (bits <= s - 2 * least) for bits in range(s % 2, s // 4 + 3, 2))


def test_texts_are_split_into_lines_once(spark):
    df = spark.createDataFrame([(1, "a b\n \n\nc"), (2, None), (3, "")], "doc_id long, text string")
    out = line_dedup.placed(df, "doc_id", "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((x.doc_id, x["at"], x.line) for x in out.collect()) == [(1, 0, "a b"), (1, 3, "c")]
    whole = line_dedup.placed(df, "doc_id", "text", whole=True)
    assert sorted((x.doc_id, x.line) for x in whole.collect()) == [(1, "a b\n \n\nc"), (2, ""), (3, "")]


OWN = "_m string, _w string, _kept string, _base_failed string, _mark string, _rate string, _times string, _own string, _tie string, row string, place string, gone string, draw string, removed string, `a.b` string"


def test_stages_leave_other_columns_alone(spark, tmp_path):
    r = random.Random(2)
    words = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    names = [x.split(" ")[0].strip("`") for x in OWN.split(", ")]
    texts = [words() for _ in range(6)] + [None, ""]
    rows = [(i, t, "en", "s", 0, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], f"doc_id long, text string, lang string, source string, n_chars long, {OWN}")
    root = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, root)
        assert out.columns == df.columns, name
        kept = out.collect()
        own = {x.doc_id for x in kept}
        assert (own <= set(range(6)) and own) if name == "mixing sources" else own >= set(range(6)), name
        assert all(x[n] == f"{n}{x.doc_id}" for x in kept for n in names), name
        assert stage(spark, df.filter("false"), root).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, df.filter("false"), root).collect() == []


def test_formatting_with_nulls(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (2, None, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.formatted(df).select("conv_id", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", ""), ("", "x")], 2: [("assistant", "y")]}
    assert chat.formatted(df.filter("false")).collect() == []
