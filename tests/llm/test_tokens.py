import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import bpe, token_files

TOKENIZERS = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return TOKENIZERS.Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def odd(library):
    r = random.Random(2)
    letters = [*"abcdeéèñ ÀÉΣσςİıS't12  \n\t\x0b\x1c\x1f\x85\xa0　中文日本😀👍🏽́<|>", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "aaaa", ".....", "ǅ", "ﬁ", "Å", "½", "\x00", "\x01"]
    plain = [k.removesuffix("</w>") for k in sorted(library.get_vocab())]
    return ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(1500)] + ["".join(r.choice(plain) for _ in range(5)) for _ in range(1500)] + ["a" * k for k in range(70)] + ["ab" * k for k in range(40)]


def test_automaton_spells_as_the_library(library, odd):
    codec = bpe.Codec()
    for t in odd:
        ids = library.encode(t, add_special_tokens=False).ids
        mine = codec.encode(t.encode())
        assert mine.tolist() == ids, t
        assert codec.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_small_tables_change_nothing(monkeypatch, odd):
    want = [bpe.Codec().encode(t.encode()).tolist() for t in odd[:300]]
    for name in ("WORDS", "CHUNKS", "PREFIXES", "STEPS"):
        monkeypatch.setattr(bpe, name, 40)
    small = bpe.Codec()
    assert [small.encode(t.encode()).tolist() for t in odd[:300]] == want


def test_gadgets_give_exactly_what_merging_gives():
    """Over two letters and merges of every kind, each sequence of tokens on a path is the merged form of its text."""
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "b"), ("ab", "b"), ("aa", "aa"), ("aaab", "aa")]
    vocab = {"a": 0, "b": 1} | {u + v: k + 2 for k, (u, v) in enumerate(merges)}
    auto = bpe.Automaton(vocab, merges)

    def merged(text):
        w = list(text)
        for u, v in merges:
            out, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == (u, v):
                    out.append(u + v)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            w = out
        return [vocab[t] for t in w]

    for n in range(1, 11):
        for bits in range(2**n):
            text = "".join("ab"[bits >> k & 1] for k in range(n))
            ids = merged(text)
            assert all(auto.follows(x, y) for x, y in zip(ids, ids[1:]))


def test_round_trip(docs, texts, library):
    want = Counter()
    for i, t, *_ in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()) == want
    both = bpe.decoded(bpe.encoded(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in both) == Counter((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in texts)


def test_token_files(spark, docs, texts, library, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, block=5000)
    got = token_files.read_tokens(spark, path, ids=True).collect()
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, *_ in texts)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for i, t, *_ in texts)


def test_encoder_spells_as_the_library(library, odd):
    coder = token_files.Encoder(None)
    got = [x for k in range(0, len(odd), 100) for x in coder.encode([t.encode() for t in odd[k : k + 100]])]
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_encoder_asks_once_for_each_distinct_piece():
    asked = []

    class Asked(token_files.Table):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    coder = token_files.Encoder(None)
    coder.known = Asked(1000)
    got = coder.encode([b"the sea, THE sea. the\n"] * 200)
    assert sorted(asked) == [b"", b"sea,", b"sea.", b"the"] or sorted(asked) == [b"sea,", b"sea.", b"the"]
    assert len({i.tobytes() for i in got}) == 1 and len(got) == 200


def test_portions_spell_as_the_library(library, odd):
    coder = token_files.Encoder(None)
    texts = [t.encode() for t in odd] + [b"", b"x" * 5000, b""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    parts = list(token_files.portions(batch, 1000))
    assert len(parts) > 10 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [x.tolist() for p in parts for x in coder.encode(p.column(1))] == [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("vocab", [2, 7, 70_000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_repair_and_random_access(n, vocab):
    g, r = np.random.default_rng(n), random.Random(n)
    ids = g.integers(0, vocab, n).astype(np.uint32)
    ids[n // 3 : n // 2] = 0
    rules, spans, body = token_files.compress(ids, vocab, least=2, pairs=20, rounds=6)
    assert (token_files.expanded(rules, spans, body, vocab) == ids).all()
    for _ in range(40):
        a = r.randint(0, n)
        b = r.randint(a, n)
        assert (token_files.ids_between(rules, spans, body, vocab, a, b) == ids[a:b]).all()


def test_tokens_of_nothing(spark, empty, tmp_path):
    assert bpe.round_trip(empty).collect() == [] == bpe.encoded(empty).collect()
    token_files.write_tokens(empty, f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/none").collect() == []


def test_very_long_words_take_little_memory():
    import random
    import tracemalloc

    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(3)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    c = bpe.codec()
    tracemalloc.start()
    got = c.encode(word.encode()).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    assert got == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(word, add_special_tokens=False).ids
