"""BPE encoding and decoding with a tokenization automaton.

The merges of a vocabulary file are compiled into a deterministic automaton whose arcs are labelled with tokens and
whose paths are exactly the token sequences that BPE yields. It starts with one state and an arc for each base symbol;
the gadget of a merge (u, v) gives every state with an arc u into a state with an arc v an arc uv beside it, and sends
all its arcs u to a copy of their target without the arc v. All arcs of one label keep one target, so a token names
its state; copies are kept as (state copied, arc left out, merge that made it), and arcs are read from these.

A word has exactly one path; transitions between tokens are looked up in a table that fills as they are met, and the
last token of each prefix of a word is stored, so that words with common beginnings share the work. Ids are decoded
by emitting their arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import documents, ship, text_of

#: Entries of each table that a worker keeps. This bounds memory and changes no result.
WORDS, CHUNKS, PREFIXES, STEPS = 200_000, 400_000, 300_000, 500_000
#: Longer words and chunks are in no table: a word's path is then held by position, in memory in proportion to its length.
LONG = 64
# Fixed values of the public vocabulary file: its word pattern and end-of-word mark.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: path, or the public tokenizers' word_bpe_49k.json as installed on each machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Table(dict):
    """A bounded table: what is met first stays, as common keys are met early; what comes when it is full shares a quarter of the room that is emptied in turn."""

    def __init__(self, room: int):
        self.room, self.recent = room * 3 // 4, {}

    def put(self, key, value):
        if len(self) < self.room:
            self[key] = value
        else:
            if len(self.recent) >= self.room // 3:
                self.recent.clear()
            self.recent[key] = value
        return value

    def put_all(self, fresh: dict) -> None:
        if len(self) + len(fresh) <= self.room:
            self.update(fresh)
        else:
            if len(self.recent) + len(fresh) > self.room // 3:
                self.recent.clear()
            self.recent.update(fresh)


class Automaton:
    """The automaton of vocab (token to id) and merges (pairs of tokens, first merged first)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        made_by = {vocab[u + v] for u, v in merges}
        self.vocab, self.label = vocab, {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.made = {i: -1 for i in vocab.values() if i not in made_by}  # the merge that made a token's arcs
        self.copied, self.without, self.born = [0], [-1], [-2]  # state 0 is the start
        self.target = dict.fromkeys(self.made, 0)
        self.table: dict[int, bool] = {}
        for k, (u, v) in enumerate(merges):
            self._gadget(k, vocab[u], vocab[v], vocab[u + v])
        self.longest = max(map(len, vocab), default=0)
        self.last: dict[str, int] = {}

    def _gadget(self, k: int, u: int, v: int, uv: int) -> None:
        if u not in self.target or v not in self.target or uv in self.target or not self._arc(at := self.target[u], v):
            return
        after = self.target[v]  # read before u's arcs move, as u may be v
        self.copied.append(at)
        self.without.append(v)
        self.born.append(k)
        self.target[u] = len(self.copied) - 1
        self.target[uv], self.made[uv], self.left[uv] = after, k, u

    def _arc(self, state: int, token: int) -> bool:
        """Whether an arc of that token leaves the state: what was there when it was copied but for the arc left out, and later merges' arcs wherever their left part has one."""
        copied, without, born, made = self.copied, self.without, self.born, self.made
        while True:
            since = made[token]
            while born[state] > since:
                if without[state] == token:
                    return False
                state = copied[state]
            if since < 0:
                return True
            token = self.left[token]

    def follows(self, before: int, token: int) -> bool:
        key = before << 20 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= STEPS:
                self.table.clear()
            found = self.table[key] = self._arc(self.target[before], token)
        return found

    def _long(self, word: str) -> list[int]:
        """encode() of a long word: the last token of each prefix stands in a list, by the prefix's length."""
        vocab, target, n = self.vocab, self.target, len(word)
        last = [-1] * (n + 1)
        for size in range(1, n + 1):
            end = END if size == n else ""
            for k in range(max(0, size - self.longest), size):
                token = vocab.get(word[k:size] + end)
                if token is not None and token in target and (k == 0 or self.follows(last[k], token)):
                    last[size] = token
                    break
            else:
                raise ValueError(f"no path for the first {size} letters")
        ids = [last[n]]
        n -= len(self.label[ids[0]]) - len(END)
        while n > 0:
            ids.append(last[n])
            n -= len(self.label[last[n]])
        return ids[::-1]

    def _last(self, prefix: str, size: int, end: str) -> int:
        """The last token on the path of prefix, whose shorter prefixes are known."""
        vocab, known, target = self.vocab, self.last, self.target
        for k in range(max(0, size - self.longest), size):
            token = vocab.get(prefix[k:size] + end)
            if token is not None and token in target and (k == 0 or self.follows(known[prefix[:k]], token)):
                return token
        raise ValueError(f"no path for {prefix!r}")

    def encode(self, word: str) -> list[int]:
        """The ids of a word of byte letters, its last one marked as the end."""
        known = self.last
        n = len(word)
        if n > LONG:
            return self._long(word)
        if len(known) + n >= PREFIXES:
            known.clear()
        k = n - 1
        while k > 0 and word[:k] not in known:
            k -= 1
        for i in range(k + 1, n):
            prefix = word[:i]
            known[prefix] = self._last(prefix, i, "")
        token = self._last(word, n, END)
        ids = [token]
        n -= len(self.label[token]) - len(END)
        while n > 0:
            token = known[word[:n]]
            ids.append(token)
            n -= len(self.label[token])
        return ids[::-1]


def lowered(text: str) -> str:
    """The text as the vocabulary file normalises it, but for white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one, without a final sigma
    return text.lower()


class Codec:
    """Encodes and decodes whole texts with the vocabulary file at path."""

    def __init__(self, path: str | None = None):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.labels = [""] * self.size
        for t, i in (model["vocab"] | self.special).items():
            self.labels[i] = t
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern, self.letters = regex.compile(PATTERN), byte_letters()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words = Table(WORDS)
        self.chunks = Table(CHUNKS)

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word) or self.words.recent.get(word)
        if ids is None:
            plain = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            ids = self.automaton.encode(plain)
            if len(word) <= LONG:
                self.words.put(word, ids)
        return ids

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.pattern.findall(lowered(text)):
            out += self._word(word)
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        if (ids := self.chunks.recent.get(chunk)) is not None:
            return ids
        text, out, at = chunk.decode("utf-8", "replace"), [], 0
        if self.specials and "<" in text:
            for m in self.specials.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(self.special[m[0]])
                at = m.end()
        out += self._plain(text[at:])
        ids = np.array(out, dtype=self.kind).tobytes()
        return self.chunks.put(chunk, ids) if len(chunk) <= LONG else ids

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a text in UTF-8. No word spans ASCII white space, so what stands between it is looked up whole."""
        known, chunk = self.chunks, self._chunk
        if b"<|" not in text:  # ASCII letters are lowered here already, which spares chunks; not where there may be special tokens
            text = text.lower()
        return np.frombuffer(b"".join([known.get(c) or chunk(c) for c in text.split()]), dtype=self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of ids with one space between, as the vocabulary file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    return Codec(path)


ENCODED = "doc_id long, ids array<int>, n_tokens long"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_tokens. Null and empty texts have no ids; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in pieces(batch):
                ids = [c.encode(t.as_py()) for t in part.column(1)]
                n = [len(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), listed(ids, n), pa.array(n, pa.int64())], ["doc_id", "ids", "n_tokens"])

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text")).mapInArrow(run, ENCODED)


def listed(ids: list[np.ndarray], n: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of encoded(). Null ids count as none; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in pieces(batch):
                texts = [c.decode(np.array(i.as_py() or [], np.int64)) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    ship(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens and digests of its ids and of the text decoded from them, and ids if asked for. Cases as in encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        number = [str(i) for i in range(c.size)]
        for batch in batches:
            for part in pieces(batch):
                found = [c.encode(t.as_py()) for t in part.column(1)]
                n = [len(i) for i in found]
                first = [hashlib.sha256(" ".join(map(number.__getitem__, i.tolist())).encode()).hexdigest() for i in found]
                second = [hashlib.sha256(c.decode(i).encode("utf-8")).hexdigest() for i in found]
                columns, names = [part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(listed(found, n))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text")).mapInArrow(run, DIGESTS + ", ids array<int>" * ids)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
