"""Vector codes and nearest neighbours against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import neighbours, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, id string, block string, n double"


def rows_of(n, dims, seed=3, spread=0.3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    out = []
    for i in range(n):
        c = centres[0 if i % 3 == 0 else r.randrange(5)]
        out.append((i * 20, [struct_float(x + r.gauss(0, spread)) for x in c], None if i % 7 == 0 else i % 3))
    return out


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def odd(dims):
    """Null vectors, null, NaN and infinite components, a zero vector, repeated rows and ids, a null id, equal vectors."""
    some = rows_of(1, dims, seed=9)[0][1]
    gaps = [None, [None, *some[1:]], [math.nan, *some[1:]], [math.inf, *some[1:]], [*some[1:], -math.inf]]
    return [(10**6 + 900 + 100 * i, v, 1) for i, v in enumerate(gaps)] + [(10**6, [0.0] * dims, 2), (10**6 + 100, some, 0), (10**6 + 100, some, 0), (10**6 + 200, some, None), (None, some, 0), (10**6 + 400, [-x for x in some], 1), (10**6 + 300, [1e3] * dims, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4, math.nan) for r in rows], SCHEMA).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[math.floor(4096 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])].append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(r[0], r[2], bytes(k).hex(), sum(far(c[p], books[p][k[p]]) for p in range(parts))) for r, c, k in zip(kept, cut, codes)], books


@pytest.mark.parametrize("n,dims,parts,entries", [(700, 16, 8, 16), (90, 6, 2, 5), (3, 8, 8, 16), (1, 8, 4, 16)])
def test_codes_are_brute_force(spark, n, dims, parts, entries, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 200)
    rows = rows_of(n, dims) + (odd(dims) if n > 1 else [])
    want, books = lloyd(rows, parts, entries, 6)
    got, found = vector_codes.compressed(frame(spark, rows), parts=parts, entries=entries)
    assert found.tolist() == books
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in got.collect()) == Counter(want)


def test_codes_of_nothing_and_of_what_cannot_be(spark):
    empty = frame(spark, rows_of(1, 8)).filter("false")
    assert vector_codes.compressed(empty)[0].count() == 0
    assert vector_codes.compressed(frame(spark, odd(8)[:5]))[0].count() == 0
    with pytest.raises(ValueError, match="multiple"):
        vector_codes.compressed(frame(spark, rows_of(5, 7)))
    with pytest.raises(Exception, match="one length"):
        vector_codes.compressed(frame(spark, rows_of(5, 8) + rows_of(5, 16)))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compressed(frame(spark, [(1, [1e30] * 8, 0)]))


def test_codes_query(spark, small):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/embeddings.parquet").to_pylist()
    want, books = lloyd([(r["vec_id"], r["embedding"], r["label"]) for r in t], 8, 16, 6)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = vector_codes.op11_vector_codes(spark, small).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == Counter((i, c, e, sums[label], digest) for i, label, c, e in want)


def exact(rows, k):
    part = [r for r in rows if usable(r[1]) and any(r[1])]
    for i, (q, v, _) in enumerate(part):
        if q is not None and q % 100 == 0:
            near = sorted((math.dist(v, w), p is None, p or 0) for j, (p, w, _) in enumerate(part) if j != i)
            yield q, [(d, None if none else p) for d, none, p in near]


@pytest.mark.parametrize("n,dims,block", [(3000, 32, 256), (1500, 8, 8192), (40, 16, 7)])
def test_nearest_against_brute_force(spark, n, dims, block, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "PILOT", 300)
    rows = rows_of(n, dims) + odd(dims)
    got = defaultdict(list)
    for r in neighbours.nearest(frame(spark, rows)).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    asked = defaultdict(list)
    for q, want in exact(rows, 10):
        asked[q].append([(round(d, 9), p) for d, p in want])
    hit = total = 0
    for q, wants in asked.items():
        found = sorted(((rank, round(s, 9), p) for rank, s, p in got[q]), key=lambda x: (x[0], x[1]))
        assert Counter(x[0] for x in found) == Counter({i: len(wants) for i in range(1, 11)})
        assert all(x[1:] in {w for want in wants for w in want} for x in found)
        if len(wants) == 1:
            assert [x[1] for x in found] == sorted(x[1] for x in found)
            assert all(a[2] <= b[2] for a, b in zip(found, found[1:]) if a[1] == b[1] and b[2] is not None and a[2] is not None)
            hit += sum((Counter(wants[0][:10]) & Counter(x[1:] for x in found)).values())
            total += 10
    assert set(got) == set(asked)
    assert hit >= 0.95 * total


def test_all_candidates_if_few(spark):
    rows = rows_of(6, 8) + odd(8)[:6]
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(frame(spark, rows)).collect()]
    want = [(q, i + 1, p) for q, near in exact(rows, 10) for i, (_, p) in enumerate(near)]
    assert sorted(got) == sorted(want)
    assert neighbours.nearest(frame(spark, rows).filter("false")).count() == 0
    assert neighbours.nearest(frame(spark, odd(8)[:6])).count() == 0
    alone = [(100, [1.0] * 8, 0)]
    assert neighbours.nearest(frame(spark, alone)).count() == 0


def test_doubles_and_names_with_dots(spark):
    rows = [(i * 50, [float(i % 17), 1.0 / (i + 1), -float(i)], None) for i in range(60)]
    df = spark.createDataFrame(rows, "`a.id` long, `a.v` array<double>, `a.l` string")
    got = neighbours.nearest(df, "a.id", "a.v", k=3).collect()
    assert len(got) == 30 * 3
    assert vector_codes.compressed(df, "a.id", "a.v", "a.l", parts=3)[0].count() == 60
