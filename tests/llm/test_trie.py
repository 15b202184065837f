"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from tidewatch.llm import prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, key string, words int, turns string, `end` string, part int"


def brute(convs):
    """convs: id to list of (role, text)."""
    members, final = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        final[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out, leaves, saved = Counter(), Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in children[k]) or 1
        saved[k] = sum(saved[c] for c in children[k]) + (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
        out[(min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(final[k]))).encode()).hexdigest())] += 1
    return out


def conversations(seed=1, n=400):
    r = random.Random(seed)
    turn = lambda: (r.choice(["user", "assistant", None]), r.choice(["a b", "a  b", "", None, "c", "ünï \x1c x", "</s>\n\n"]))
    out = {c: [turn() for _ in range(r.choice([1, 2, 3, 4, 6]))] for c in r.sample(range(2 * n), n)}
    hot, deep = [turn() for _ in range(3)], [("user", f"turn {i}") for i in range(300)]
    for k, c in enumerate(out):
        if k % 3 == 0:
            out[c] = list(hot)  # a third of all
        elif k % 50 == 1:
            out[c] = deep[: 250 + k % 17] + [turn()] * (k % 4)
    out[3 * n] = [("user", "long " * 50_000)]
    return out


def frame(spark, convs, extra=()):
    r = random.Random(2)
    rows = [(c, None if i == 0 and c % 2 else i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    rows += extra
    r.shuffle(rows)
    return spark.createDataFrame([(*t, "x", 1, "x", "x", 2) for t in rows], SCHEMA).repartition(5)


def plain(convs):
    return {c: [(a or "", b or "") for a, b in turns] for c, turns in convs.items()}


def rows_of(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("run,size", [(1 << 24, 1 << 24), (600, 2000), (100, 300)])
def test_trie_is_brute_force(spark, run, size, monkeypatch):
    for name, value in (("RUN", run), ("RANGE", size), ("PACK", 7)):
        monkeypatch.setattr(prefix_trie, name, value)
    convs = conversations()
    df = frame(spark, convs, [(None, 0, "user", "of no conversation")])
    assert rows_of(prefix_trie.trie(prefix_trie.turns_of(df))) == brute(plain(convs))


@pytest.mark.parametrize("size", [1 << 24, 400])
def test_rebuilt_conversations(spark, size, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", size)
    monkeypatch.setattr(prefix_trie, "RANGE", size)
    convs = conversations(4)
    own = plain(convs)
    want = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in want.values())  # some have no turn left
    assert rows_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(frame(spark, convs))))) == brute(want)


def test_few_and_none(spark):
    one = frame(spark, {7: [("user", "hi there")]})
    assert rows_of(prefix_trie.trie(prefix_trie.turns_of(one))) == brute({7: [("user", "hi there")]})
    assert prefix_trie.trie(prefix_trie.turns_of(one.filter("false"))).count() == 0
    again = frame(spark, {1: [("user", "x")], 2: [("user", "x"), ("user", "x")]}, [(1, 0, "user", "x")])  # a repeated row is a turn of its own
    assert rows_of(prefix_trie.trie(prefix_trie.turns_of(again))) == brute({1: [("user", "x")] * 2, 2: [("user", "x")] * 2})


def test_merging_compares_only_what_is_not_shared(monkeypatch):
    seen = []
    real = prefix_trie.common
    monkeypatch.setattr(prefix_trie, "common", lambda a, b, at=0: seen.append(at) or real(a, b, at))
    r = random.Random(3)
    keys = [bytes(16) * 40 + bytes([r.randrange(3) for _ in range(4)]) * 4 * r.randrange(3) for _ in range(200)]
    streams = [sorted(keys[i::7]) for i in range(7)]
    rows = [[(k, real(s[i - 1], k) if i else 0, k) for i, k in enumerate(s)] for s in streams]
    out = list(prefix_trie.merged(rows))
    assert [o[0] for o in out] == sorted(keys)
    assert all(o[1] == real(a[0], o[0]) for a, o in zip(out, out[1:]))
    assert sum(at >= 40 for at in seen) >= len(seen) - 8  # after the first round the 40 shared turns are not looked at again
