import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import simhash, suffix_dedup

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def stripped(texts, depth=50):
    """By brute force: for each row, (doc_id, bytes, removed, spans, digest of the rest)."""
    rows = [(i, (t or "").encode()) for i, t in texts]
    first: dict[bytes, float] = {}
    order = lambda i: float("inf") if i is None else i
    for i, b in rows:
        for k in range(len(b) - depth + 1):
            w = b[k : k + depth]
            first[w] = min(first.get(w, float("inf")), order(i))
    out = Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if first[b[k : k + depth]] < order(i):
                gone[k : k + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[(i, len(b), sum(gone), sum(g and not h for g, h in zip(gone, b"\0" + gone)), sha256(kept).hexdigest())] += 1
    return out


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_repeats_are_brute_force(docs, texts):
    assert rows_of(suffix_dedup.repeats_removed(docs)) == stripped([(i, t) for i, t, *_ in texts])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_at_odd_places_and_in_small_segments(spark, monkeypatch, seed):
    r = random.Random(seed)
    word = lambda n, a="abcdefgh": "".join(r.choice(a) for _ in range(n))
    shared = [word(n) for n in (49, 50, 51, 60, 99, 100, 200, 700)]
    texts = []
    for i in r.sample(range(1000), 60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append(word(r.randrange(0, 80)))
            s = r.choice(shared)
            a = r.randrange(0, 5)
            parts.append(s[a : len(s) - r.randrange(0, 5)])
        texts.append((i, "".join(parts)))
    texts += [(5000, "ab" * 300), (5001, "ab" * 90), (5002, "b" * 49), (5003, "a" * 500), (5004, "a" * 50)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 333)
    monkeypatch.setattr(suffix_dedup, "BATCH", 4000)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(suffix_dedup.repeats_removed(df)) == stripped(texts)


def test_repeats_keep_the_text(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen"
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.repeats_removed(spark.createDataFrame([(1, t), (2, f"<{t}>")], "doc_id long, text string"), kept_text=True).collect()}
    assert got == {1: t.encode(), 2: b"<>"}


def test_repeats_of_nothing(empty):
    assert suffix_dedup.repeats_removed(empty).collect() == []


def fingerprint(text, words=3):
    w = (text or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    s = [" ".join(x) for x in zip(*[w[k:] for k in range(words)])] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def joined(fps, near=2):
    """The component of each distinct fingerprint by all pairs."""
    u = np.array(sorted(fps), np.uint64)
    parent = list(range(len(u)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= near) + i + 1:
            parent[root(i)] = root(int(j))
    return {int(x): root(i) for i, x in enumerate(u)}


def test_near_dedup_is_brute_force(docs, texts):
    fps = [fingerprint(t) for _, t, *_ in texts]
    comp = joined(set(fps))
    least = {}
    for (i, *_), f in zip(texts, fps):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    got = simhash.near_dedup(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", least.get(comp[f])) for (i, *_), f in zip(texts, fps))
    kept = simhash.one_of_each(docs).select("doc_id", "text").collect()
    assert len(kept) == len(set(comp.values()))


@pytest.mark.parametrize("room", [128, 8, 2])
def test_links_join_what_all_pairs_join(spark, room):
    r = random.Random(room)
    fps = set()
    for _ in range(3):
        c = r.getrandbits(64)
        for where in (range(64), range(32), range(32, 64)):
            for _ in range(120):
                x = c
                for b in r.sample(where, r.choice([0, 1, 2, 2, 3])):
                    x ^= 1 << b
                fps.add(x)
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    links = simhash.links(df, room=room)
    assert all(0 < (a ^ b & (1 << 64) - 1).bit_count() <= 64 for a, b in links.collect())
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).isEmpty()
    root = {x.node: x.root for x in simhash.components(links).collect()}
    want = joined(fps)
    groups: dict[int, set] = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(sign(f))
    assert all({root.get(f, f) for f in g} == {min(g)} for g in groups.values())


def test_near_dedup_of_nothing(empty):
    assert simhash.near_dedup(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []


def test_suffix_dedup_at_the_ends_of_the_longs(spark):
    low, high, text = -(2**63), 2**63 - 1, "x" * 30 + "y" * 30
    df = spark.createDataFrame([(high, text), (low, text), (None, text), (3, "z" * 49)], "`a.id` long, `a.text` string")
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeats_removed(df, "a.id", "a.text").collect()}
    assert got == {(low, 60, 0), (high, 60, 60), (None, 60, 60), (3, 49, 0)}


def test_near_dedup_broadcasts_no_table(spark, docs, monkeypatch):
    plans, stored = [], simhash.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(simhash, "stored", seen)
    seen(simhash.near_dedup(docs))
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
