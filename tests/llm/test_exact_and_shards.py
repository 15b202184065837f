import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, sharding

WHITE = re.compile("[\x20\x09-\x0d]")


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long")], ids=["hash", "length", "constant"])
def test_exact_dedup_is_brute_force(docs, texts, key):
    groups = defaultdict(list)
    for i, t, *_ in texts:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.exact_dedup(docs, key=key).collect()
    assert len(got) == len(texts)
    want = Counter()
    for i, t, *_ in texts:
        norm = WHITE.sub("", t or "")
        best = min(groups[norm])
        want[(i, None if best[1] else best[2], len(groups[norm]), sha256(norm.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_chunks_join_to_the_text_and_follow_content(spark):
    t = "".join(f"Sentence number {i} says {i * i}. " for i in range(400))
    df = spark.createDataFrame([(t,), ("New words in front. " * 20 + t,), ("",), ("x" * 5000,)], "t string").select("t", exact_dedup.chunks_of(F.col("t")).alias("c"))
    rows = df.collect()
    assert all("".join(r.c) == r.t for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > len(rows[0].c) * 0.8


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


@pytest.mark.parametrize("law", sharding.LAWS)
def test_sharding_laws(docs, texts, law):
    got = sharding.sharded(docs, law).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), crc32((t or "").encode())) for i, t, *_ in texts)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    if law == "bytes":
        groups = defaultdict(set)
        for r in got:
            groups[r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in groups.values())
        sizes = Counter()
        for i, t, *_ in texts:
            sizes[t or ""] += size(t)
        place = sharding.longest_first([(n, t) for t, n in sizes.items()], 8)
        load, best = Counter(), Counter()
        for r in got:
            load[r.shard] += r.size
        for t, n in sizes.items():
            best[place[t]] += n
        assert max(load.values()) <= max(best.values()) * 1.05
    if law == "key":
        assert all(r.grown_shard in (r.shard, 8) for r in got)
        assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in sharding.sharded(docs.repartition(7), law).collect()}
    else:
        assert all(r.grown_shard is None for r in got)


def test_sharding_of_nothing_and_of_unknown_laws(empty):
    for law in sharding.LAWS:
        assert sharding.sharded(empty, law).collect() == []
    with pytest.raises(ValueError):
        sharding.sharded(empty, "luck")


def test_longest_first_is_greedy():
    assert longest([7, 6, 5, 4, 3], 2) == [14, 11] or longest([7, 6, 5, 4, 3], 2) == [11, 14]


def longest(sizes, shards):
    place = sharding.longest_first([(s, k) for k, s in enumerate(sizes)], shards)
    load = [0] * shards
    for k, s in enumerate(sizes):
        load[place[k]] += s
    return load


def test_exact_dedup_at_the_ends_of_the_longs(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "a b", None), (high, "ab", None), (None, "a b", None), (5, "x", None), (None, "", None), (high, None, None), (low, " ", None)]
    df = spark.createDataFrame(rows, "`a.id` long, `a.text` string, recipe string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, "a.id", "a.text").collect()}
    assert got == {(low, low, 3, True), (high, low, 3, False), (None, low, 3, False), (5, 5, 1, True), (None, low, 3, False), (high, low, 3, False), (low, low, 3, True)}
