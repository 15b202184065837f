"""Token-id files compressed by Re-Pair.

Rows are dealt by range of doc_id into shards, and each shard's ids are written in ascending order as blocks of about
BLOCK ids (whole documents each). In a block, frequent pairs of neighbouring ids are replaced by nonterminals, round
after round, many pairs a round. A block stores its rules, each symbol's expansion length follows from them and is
stored too, and so any range of ids is decoded by expanding only the symbols that cover it.

The files are Parquet with a row per block: shard, block, doc_ids and lengths of its documents in order, vocab (ids
are below it, nonterminals from it on), rules (pairs of symbols, unsigned 32-bit), spans (expansion lengths of the
rules, unsigned 32-bit), body (symbols, unsigned of `width` bytes), all little-endian.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.bpe import END, PATTERN, Table, lowered, vocabulary_path
from tidewatch.llm.shared import documents, scratch, ship, text_of

#: Ids of a block; pairs replaced in a round; how often a pair must occur; rounds at most; rows a shard is dealt.
BLOCK, PAIRS, LEAST, ROUNDS, SHARD_ROWS, END_ID = 1 << 20, 2048, 16, 7, 8000, 1
#: Entries of a worker's tables of chunks and of words; they bound memory and change no result.
CHUNKS, WORDS = 1_000_000, 600_000
#: Bytes of text that are encoded at once, whole texts each; marks that the vocabulary file makes words of by themselves.
AT_ONCE, MARKS = 4 << 20, '.,;:!?)"'


class Encoder:
    """The ids of texts by the tokenizers library. What stands between ASCII white space is numbered by Arrow, and each distinct piece is looked up once; what is new is cut into words as the vocabulary file says, and words that are new are encoded by the library, many at once, and told apart by their end marks."""

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.size = 1 + max(vocab.values())
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pattern = regex.compile(PATTERN)
        self.marks = {m: self.alone(m) for m in MARKS}
        self.known, self.words = Table(CHUNKS), Table(WORDS)

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def spelled(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        parts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        ids = np.array([i for part in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False) for i in part.ids], self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return {w: self.alone(w) for w in words}
        flat, stops = ids.tobytes(), (stops * self.kind.itemsize).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *stops], stops)}

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of new chunks; none holds a line end, so one stands between them while they are normalised. Most are letters, with one mark after them at most."""
        plain = [c for c in chunks if b"<|" not in c]
        texts = lowered(b"\n".join(plain).decode("utf-8", "replace")).split("\n") if plain else []
        bodies, tails, odd, marks = [], [], {}, self.marks
        for t in texts:
            if t.isalpha():
                bodies.append(t)
                tails.append(b"")
            elif t[-1:] in marks and t[:-1].isalpha():
                bodies.append(t[:-1])
                tails.append(marks[t[-1]])
            else:
                odd[len(bodies)] = self.pattern.findall(t)
                bodies.append("")
                tails.append(b"")
        known, recent = self.words, self.words.recent
        met = set(bodies).union(*odd.values()) - {""}
        new = met.difference(known).difference(recent)
        fresh = self.spelled(list(new)) if new else {}
        own = {w: known.get(w) or recent[w] for w in met.difference(new)}
        own.update(fresh)
        own[""] = b""
        found = list(map(add, map(own.__getitem__, bodies), tails))
        for i, words in odd.items():
            found[i] = b"".join(map(own.__getitem__, words))
        known.put_all(fresh)
        if len(plain) == len(chunks):
            return found
        rest = iter(found)
        return [self.alone(c.decode("utf-8", "replace")) if b"<|" in c else next(rest) for c in chunks]  # may hold a special token

    def encode(self, texts: list[bytes] | pa.Array) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
        if not len(texts):
            return []
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy, as ascii_lower() is wrong on slices
        texts = pc.cast(texts, options=pc.CastOptions(target_type=pa.large_string(), allow_invalid_utf8=True))  # learn() takes any bytes
        # ASCII letters are lowered here already, which spares chunks; not where there may be special tokens
        special = pc.match_substring(texts, "<|")
        rows = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)) if special.true_count else pc.ascii_lower(texts))
        coded = rows.values.dictionary_encode()
        names, places = coded.dictionary.buffers()[2], np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        names = names.to_pybytes() if names else b""
        chunks = [names[a:b] for a, b in pairwise(places)]
        known, recent = self.known, self.known.recent
        got = list(map(known.get, chunks))
        open_ = [i for i, ids in enumerate(got) if ids is None]
        if recent:
            for i in open_:
                got[i] = recent.get(chunks[i])
            open_ = [i for i in open_ if got[i] is None]
        if open_:
            new = [chunks[i] for i in open_]
            fresh = self.learn(new)
            for i, ids in zip(open_, fresh, strict=True):
                got[i] = ids
            known.put_all(dict(zip(new, fresh, strict=True)))
        flat = pa.array(got, pa.large_binary()).take(coded.indices)
        size = self.kind.itemsize
        ids = np.frombuffer(flat.buffers()[2] or b"", self.kind)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[rows.offsets.to_numpy()] // size
        return [ids[a:b] for a, b in pairwise(ends.tolist())]


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


def portions(batch: pa.RecordBatch, room: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text (the second column), of whole rows."""
    number = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // room
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(edges):
        if b > a:
            yield batch.slice(a, b - a)


def frequent(symbols: np.ndarray, least: int, most: int) -> np.ndarray:
    """The most frequent neighbouring pairs (left << 32 | right) that occur at least so often; ties go to smaller pairs."""
    pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:] if symbols.size and symbols.max() >= 1 << 16 else symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:].astype(np.uint32)
    if not pairs.size:
        return np.zeros(0, np.uint64)
    pairs.sort()
    edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    times = np.diff(np.append(edge, pairs.size))
    often = np.flatnonzero(times >= least)
    often = often[np.argsort(-times[often], kind="stable")[:most]]
    found = pairs[edge[often]]
    return found if found.dtype == np.uint64 else (found.astype(np.uint64) >> np.uint64(16)) << np.uint64(32) | (found & np.uint32(0xFFFF)).astype(np.uint64)


def compress(ids: np.ndarray, vocab: int, least: int = LEAST, pairs: int = PAIRS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, spans, body): rules of shape (n, 2), symbol vocab + k standing for rules[k]; spans their expansion lengths."""
    body, rules, span = ids.astype(np.uint32), [], np.ones(vocab, np.int64)
    room = max(0, (1 << 16) - vocab)  # symbols stay within 16 bits wherever the vocabulary does
    for _ in range(rounds):
        keys = np.sort(frequent(body, least, min(pairs, room) if vocab < 1 << 16 else pairs))
        if not keys.size:
            break
        left, right = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        new = len(span) + np.arange(keys.size, dtype=np.uint32)
        # the pair that starts at a place, by the numbers of its two symbols among those that start and end pairs
        l_, r_ = np.zeros(len(span), np.int32), np.zeros(len(span), np.int32)
        starts, ends = np.unique(left), np.unique(right)
        l_[starts], r_[ends] = np.arange(1, starts.size + 1), np.arange(1, ends.size + 1)
        width = ends.size + 1
        which = np.zeros((starts.size + 1) * width, np.int16 if keys.size < 1 << 15 else np.int32)
        which[l_[left] * width + r_[right]] = np.arange(1, keys.size + 1)
        own = np.take(which, np.take(l_ * width, body[:-1]) + np.take(r_, body[1:]))
        at = np.flatnonzero(own)
        k = own[at] - 1
        # of matches that overlap in a row, every second one goes
        number = np.arange(at.size, dtype=np.int32)
        run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) != 1]), number, 0)) if at.size else number
        take = (number - run) % 2 == 0
        at, k = at[take], k[take]
        body[at] = new[k]
        keep = np.ones(body.size, bool)
        keep[at + 1] = False
        body = body[keep]
        rules.append(np.stack([left, right], 1))
        span = np.concatenate([span, span[left] + span[right]])
        room -= keys.size
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), span[vocab:].astype(np.uint32), body


def expanded(rules: np.ndarray, spans: np.ndarray, symbols: np.ndarray, vocab: int) -> np.ndarray:
    """The ids that symbols stand for."""
    size = np.concatenate([np.ones(vocab, np.int64), spans.astype(np.int64)])
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(int(at[-1]), np.uint32)
    flat[:vocab] = np.arange(vocab)
    level = np.zeros(size.size, np.int32)
    for k in range(len(rules)):
        a, b = rules[k]
        level[vocab + k] = 1 + max(level[a], level[b])
    for depth in range(1, int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == depth)
        parts = rules[own - vocab].ravel()
        flat[_spread(at[own], size[own])] = flat[_spread(at[parts], size[parts])]
    return flat[_spread(at[symbols], size[symbols])]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the next."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if total.size else 0) + np.repeat(start - (total - size), size)


def ids_between(rules: np.ndarray, spans: np.ndarray, body: np.ndarray, vocab: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block, from the symbols that cover them only."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    size = np.concatenate([np.ones(vocab, np.int64), spans.astype(np.int64)])[body]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    skip = start - int(ends[a] - size[a])
    return expanded(rules, spans, body[a : b + 1], vocab)[skip : skip + stop - start]


FILE = "shard int, block int, doc_ids array<long>, lengths array<long>, vocab long, rules binary, spans binary, width int, body binary"


def _block(shard: int, block: int, doc_ids: list, rows: list[np.ndarray], vocab: int) -> pa.RecordBatch:
    rules, spans, body = compress(np.concatenate(rows), vocab)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(r) for r in rows]], pa.list_(pa.int64())), pa.array([vocab], pa.int64()),
            pa.array([rules.astype("<u4").tobytes()], pa.binary()), pa.array([spans.astype("<u4").tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([body.astype(f"<u{width}").tobytes()], pa.binary()),
        ],
        ["shard", "block", "doc_ids", "lengths", "vocab", "rules", "spans", "width", "body"],
    )


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Writes the ids of docs, each followed by end_id, to token files at path in ascending order of doc_id.

    Null doc_ids come first; rows of one doc_id go by a hash of their text. Null and empty texts have the end id alone.
    Other columns are ignored. An empty table writes files without blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number, doc_ids, rows, held = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part in portions(batch):
                for i, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1)), strict=True):
                    doc_ids.append(i)
                    rows.append(np.concatenate([ids, end]))
                    held += len(ids) + 1
                    if held >= block:
                        yield _block(shard, number, doc_ids, rows, coder.size)
                        number, doc_ids, rows, held = number + 1, [], [], 0
        if rows:
            yield _block(shard, number, doc_ids, rows, coder.size)

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    parts = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    dealt.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str, ids: bool = False) -> DataFrame:
    """One row per document of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules, spans = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["spans"], "<u4")
                flat = expanded(rules, spans, np.frombuffer(row["body"], f"<u{row['width']}"), row["vocab"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                cut = [flat[e - n : e] for n, e in zip(row["lengths"], ends.tolist(), strict=True)]
                n = len(cut)
                columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - np.array(row["lengths"], np.int64), pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(spark)
    files = spark.read.schema(FILE).parquet(path)
    docs = files.mapInArrow(run, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    blocks = files.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("all"))  # a row per shard: a small table whatever the input
    shards = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("shard_start"))
    before = blocks.withColumn("block_start", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("before"))
    return docs.join(before, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path)
