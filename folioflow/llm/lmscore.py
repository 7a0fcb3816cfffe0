"""Language-model scoring: n-gram counts in a log-frequency Bloom filter that workers probe.

The filter holds, for every word pair of the training texts, its count on a logarithmic scale: level 1 for one
occurrence, one level more for each doubling. A count is read by probing level after level until one is missing.
Probabilities interpolate the pair's relative frequency with the single word's add-one probability (whose counts are
exact); the weight depends on how often the history occurs and is fitted to all training texts, each token held out of
its own counts. Level 1 takes so many probes that of all words of the vocabulary at most FALSE_WORDS are expected to be
seen falsely after a given word; as many occurrences are added to the history's count, so what follows a word is
expected to sum to at most 1, falsely seen pairs included. All pairs of the training texts are put, those of rare words,
too. A pair with a word seen once counts for the share of such pairs that recur, fitted in the same way.

Texts are turned into chunks of about CHUNK_TOKENS tokens: their distinct word hashes and, per token, a number into
them. Words leave a chunk as rows (hash, count), summed inside it first and combined before they are
shuffled; so rows grow with the corpus and not with chunks times buckets. Chunks get counts back in one join; words
of over one in FREQUENT tokens, of which there can be no more than FREQUENT, never take part in it but are
broadcast. The filter is cut into segments of about SEGMENT_PAIRS pairs, GROUP of which are one task's. Pairs travel
sorted, by group, as compressed differences: a few bytes a pair instead of a row. Up to BROADCAST_BYTES in all the filter is broadcast; a larger one is
not: then chunks send their pairs to the groups and get the levels back. Both ways give the same levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

CHUNK_TOKENS = 1 << 18
#: Mean pairs of a segment of the filter.
SEGMENT_PAIRS = 1 << 18
#: Segments to which pairs are sent together.
GROUP = 8
#: Bits of a pair's key that are kept. More than a pair's place in its segment: that two of a segment's pairs agree in them is far rarer than a false probe.
KEY_BITS = 56
#: Words of at least one in so many tokens are frequent; there are at most so many of them.
FREQUENT = 1 << 21
#: The whole filter is broadcast only if its bits take no more than this.
BROADCAST_BYTES = 192 << 20
#: Of all words of the vocabulary, about so many are expected to be seen falsely after a given word; probes of every further level.
FALSE_WORDS, FURTHER_PROBES = 1, 6
#: Entries that a task combines before it sends them: words, pairs.
COMBINED, COMBINED_PAIRS = 1 << 17, 1 << 19
HELD_OUT_OF, HELD_OUT = 7, 2
#: What stands for the end of a text, and before its first word: no word holds a space.
END = xxhash.xxh64_intdigest(b" end", 42)

_CHUNK = "chunk long, doc_ids array<bigint>, held binary, lens binary, vocab binary, idx binary"
_COUNTED = f"{_CHUNK}, counts binary"
_READY = "chunk long, doc_ids array<bigint>, held binary, lens binary, idx binary, counts binary, levels binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def squeeze(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1) if len(a) else b""


def loosen(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * np.uint64(0x9E3779B97F4A7C15) + word) & np.uint64((1 << 64) - (1 << 64 - KEY_BITS))


def packed_keys(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct keys as differences, and counts."""
    steps = np.diff(keys >> np.uint64(64 - KEY_BITS), prepend=np.uint64(0))
    return squeeze(steps if counts is None else np.concatenate([steps, counts.astype(np.uint64)]))


def unpacked_keys(raw: bytes, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    both = loosen(raw, np.uint64)
    n = len(both) // 2 if counts else len(both)
    return np.cumsum(both[:n], dtype=np.uint64) << np.uint64(64 - KEY_BITS), both[n:].astype(np.int64)


def _by_group(keys: np.ndarray, segments: int) -> Iterator[tuple[int, int, int]]:
    """(group, first, end) of sorted keys."""
    group = segment_of(keys, segments) // GROUP
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(keys)] if len(keys) else [0]
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield int(group[a]), a, z


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Rises with the key, so sorted keys lie together by segment."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def first_probes(words: int, false_words: float = FALSE_WORDS) -> int:
    """Probes of level 1: of ``words`` absent pairs, at most ``false_words`` are expected to be seen falsely."""
    return max(2, math.ceil(math.log2(max(words, 1) / false_words)))


class Bits:
    """One segment of the filter: ``on`` while it is built, ``raw`` while it is read."""

    def __init__(self, n_bits: int, probes: int, raw: bytes | None = None):
        self.n, self.probes = n_bits, probes
        self.raw = None if raw is None else np.frombuffer(raw, np.uint8)
        self.on = np.zeros(n_bits, bool) if raw is None else None

    @staticmethod
    def size(levels: int, keys: int, probes: int) -> int:
        """Bits for ``keys`` keys with so many levels in all: half of them will be on."""
        return max(64, int((keys * probes + (levels - keys) * FURTHER_PROBES) * 1.4427) // 64 * 64 + 64)

    @staticmethod
    def places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        first = mixed(keys + np.uint64(level * 0xD1342543DE82EF95 & (1 << 64) - 1))
        return first, mixed(first) | np.uint64(1)

    def put(self, keys: np.ndarray, levels: np.ndarray) -> None:
        """Every key at all levels up to its own."""
        n = np.uint64(self.n)
        for level in range(1, int(levels.max(initial=0)) + 1):
            a, step = self.places(keys[levels >= level], level)
            for _ in range(self.probes if level == 1 else FURTHER_PROBES):
                self.on[((a >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64)] = True
                a = a + step

    def packed(self) -> bytes:
        return np.packbits(self.on, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which a key is found without a gap; 0: absent."""
        return Filter(1, self.probes, {0: (self.n, self.raw.tobytes())}).levels(keys)


class Filter:
    """Segments one behind the other, read together."""

    def __init__(self, segments: int, probes: int, rows: dict[int, tuple[int, bytes]]):
        self.segments, self.probes = segments, probes
        self.sizes, self.starts, at = np.ones(segments, np.uint64), np.zeros(segments, np.uint64), 8
        parts = [b"\0" * 8]  # a segment without pairs reads a bit that is off
        for s, (n, raw) in rows.items():
            self.sizes[s], self.starts[s] = n, at * 8
            parts.append(raw)
            at += len(raw)
        self.raw = b"".join(parts)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        raw, out = np.frombuffer(self.raw, np.uint8), np.zeros(len(keys), np.uint8)
        for lo in range(0, len(keys), 1 << 16):
            part = keys[lo : lo + (1 << 16)]
            seg = segment_of(part, self.segments)
            size, start = self.sizes[seg], self.starts[seg]
            at, level = np.arange(len(part)), 1
            while len(at) and level < 64:
                a, step = Bits.places(part[at], level)
                for _ in range(self.probes if level == 1 else FURTHER_PROBES):
                    p = ((a >> np.uint64(32)) * size[at] >> np.uint64(32)) + start[at]
                    ok = (raw[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    at, a, step = at[ok], a[ok] + step[ok], step[ok]
                out[lo + at] = level
                level += 1
        return out


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        hashes, ids, held, arrays, size = _Hashes(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            vocab, idx, n = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lens = np.array([len(a) for a in arrays], np.uint64)
            row = {"chunk": [task << 32 | made], "doc_ids": [ids], "held": [np.array(held, np.uint8).tobytes()], "lens": [squeeze(lens)], "vocab": [squeeze(vocab[order])], "idx": [squeeze(rank[idx])]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema({"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), **dict.fromkeys(("held", "lens", "vocab", "idx"), pa.binary())}))

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or b"").lower().split()  # bytes.lower: A-Z only; bytes.split: 0x20, 0x09-0x0D
                arrays.append(np.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), np.uint64(END)))
                ids.append(doc)
                held.append(out)
                size += len(words) + 1
                if size >= chunk_tokens:
                    yield flush()
                    made += 1
                    hashes, ids, held, arrays, size = _Hashes(), [], [], [], 0
        if arrays:
            yield flush()

    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).cast("binary").alias("text")).mapInArrow(encode, _CHUNK)


class Chunk:
    def __init__(self, row: dict):
        self.id, self.doc_ids = row["chunk"], row["doc_ids"]
        self.held, self.lens = np.frombuffer(row["held"], np.uint8).astype(bool), loosen(row["lens"], np.uint64).astype(np.int64)
        self.idx = loosen(row["idx"], np.uint32).astype(np.int64)
        self.vocab = loosen(row["vocab"], np.uint64) if "vocab" in row else None
        self.counts = loosen(row["counts"], np.uint64).astype(np.int64) if "counts" in row else None
        self.starts = np.cumsum(self.lens) - self.lens

    def trains(self) -> np.ndarray:
        return np.repeat(~self.held, self.lens)

    def history(self) -> np.ndarray:
        """Per token the number of the word before it; before the first: the end of a text."""
        prev = np.empty_like(self.idx)
        prev[1:] = self.idx[:-1]
        prev[self.starts] = self.idx[self.starts + self.lens - 1]
        return prev

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens make a pair of known words with the word before them, and those pairs' keys."""
        prev = self.history()
        at = np.flatnonzero(np.minimum(self.counts[prev], self.counts[self.idx]) > 0)
        return at, pair_keys(self.vocab[prev[at]], self.vocab[self.idx[at]])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            yield Chunk(row), row


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], names=list(columns))


class _Sums:
    """Counts by key, combined while they are few: what is hot leaves a task in few rows."""

    def __init__(self, limit: int = COMBINED):
        self.limit, self.keys, self.counts, self.held = limit, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.limit:
            keys, counts = self.take()
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def full(self) -> bool:
        return self.held > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([np.zeros(0, np.uint64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts])
        self.keys, self.counts, self.held = [], [], 0
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _combined(counts_of):
    """Chunks -> (key, n) with the counts of several chunks added up."""

    def run(batches):
        sums = _Sums()
        for c, _ in _chunks(batches):
            sums.add(*counts_of(c))
            if sums.full():
                keys, n = sums.take()
                yield _batch(key=keys, n=n)
        keys, n = sums.take()
        yield _batch(key=keys, n=n)

    return run


def word_counts(ws: Workspace, chunks: DataFrame) -> DataFrame:
    """(word, c) of all words of the training texts, written."""

    def count(c):
        n = np.bincount(c.idx[c.trains()], minlength=len(c.vocab))
        return c.vocab[n > 0], n[n > 0].astype(np.int64)

    return ws.keep(chunks.mapInArrow(_combined(count), "key long, n long").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "words")


def build_filter(ws: Workspace, chunks: DataFrame, segments: int, probes: int) -> DataFrame:
    """(segment, n_bits, bits) of the training pairs' filter, written.

    Pairs are shuffled once, to their group of segments, and summed there: most pairs of a corpus are rare, so combining them any
    further before the shuffle would save little. A task holds one group.
    """

    def count(c):
        at, keys = c.pairs()
        return np.unique(keys[c.trains()[at]], return_counts=True)

    def send(batches):
        sums = _Sums(COMBINED_PAIRS)

        def out():
            keys, n = sums.take()
            rows = [(g, packed_keys(keys[a:z], n[a:z])) for g, a, z in _by_group(keys, segments)]
            for lo in range(0, len(rows), 1024):
                g, raw = zip(*rows[lo : lo + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(raw, pa.binary())], names=["grp", "raw"])

        for c, _ in _chunks(batches):
            sums.add(*count(c))
            if sums.full():
                yield from out()
        yield from out()

    def build(batches):
        now, sums = None, _Sums(COMBINED_PAIRS)

        def out():
            keys, n = sums.take()
            seg = segment_of(keys, segments)
            cuts = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                level = np.frexp(n[a:z].astype(np.float64))[1].astype(np.int64)  # 1: level 1; 2, 3: level 2; 4..7: level 3
                bits = Bits(Bits.size(int(level.sum()), z - a, probes), probes)
                bits.put(keys[a:z], level)
                yield pa.RecordBatch.from_arrays([pa.array([int(seg[a])], pa.int64()), pa.array([bits.n], pa.int64()), pa.array([bits.packed()], pa.binary())], names=["segment", "n_bits", "bits"])

        for b in batches:
            for grp, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if now is not None and grp != now:
                    yield from out()
                now = grp
                sums.add(*unpacked_keys(raw.as_py(), counts=True))
        if now is not None:
            yield from out()

    sent = chunks.mapInArrow(send, "grp long, raw binary").repartition("grp").sortWithinPartitions("grp")
    return ws.keep(sent.mapInArrow(build, "segment long, n_bits long, bits binary"), "filter")


def _sorted_table(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table as arrays in the order of its keys."""
    t = df.select(key, value).toArrow()
    k, v = (np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in t.column(n).chunks)]) for n in (key, value))
    k = k.view(np.uint64)
    order = np.argsort(k)
    return k[order], v[order]


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which keys are there)"""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    there = table[0][at] == keys
    return np.where(there, table[1][at], 0), there


def _answers(asked: DataFrame, name: str) -> DataFrame:
    """(chunk, pos, value) -> one row a chunk."""
    return asked.groupBy("chunk").agg(F.collect_list("pos").alias(f"{name}_at"), F.collect_list("value").alias(name))


def rare_counts(chunks: DataFrame, words: DataFrame, frequent) -> DataFrame:
    """(chunk, words_at, words): training counts of each chunk's words that are not frequent."""

    def ask(batches):
        for c, _ in _chunks(batches):
            rare = np.flatnonzero(~_looked_up(frequent.value, c.vocab)[1])
            yield _batch(chunk=np.full(len(rare), c.id), pos=rare.astype(np.int32), word=c.vocab[rare])

    return _answers(chunks.mapInArrow(ask, "chunk long, pos int, word long").join(words, "word").select("chunk", "pos", F.col("c").alias("value")), "words")


def asked_levels(chunks: DataFrame, table: DataFrame, segments: int, probes: int) -> DataFrame:
    """(chunk, groups, pairs): levels of each chunk's distinct pairs, in the pairs' order by group, asked of the segments: for filters that are not broadcast.

    Questions stream past their group's bits: a task holds one group of segments and one batch.
    """

    def ask(batches):
        for c, _ in _chunks(batches):
            keys = np.unique(c.pairs()[1])
            rows = [(c.id, g, packed_keys(keys[a:z])) for g, a, z in _by_group(keys, segments)]
            for lo in range(0, len(rows), 1024):
                chunk, g, raw = zip(*rows[lo : lo + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(g, pa.int64()), pa.array(raw, pa.binary())], names=["chunk", "grp", "raw"])

    def answer(batches):
        now, held, bits = None, {}, None
        for b in batches:
            out = []
            for chunk, grp, n_bits, segment, raw in zip(*(b.column(n).to_pylist() for n in ("chunk", "grp", "n_bits", "segment")), b.column("raw"), strict=True):
                if grp != now:
                    now, held, bits = grp, {}, None
                if n_bits is not None:
                    held[segment] = (n_bits, raw.as_py())
                    continue
                if bits is None:  # segments come before the questions
                    bits = Filter(segments, probes, held)
                out.append((chunk, grp, squeeze(bits.levels(unpacked_keys(raw.as_py())[0]))))
            if out:
                chunk, grp, raw = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(grp, pa.int64()), pa.array(raw, pa.binary())], names=["chunk", "grp", "raw"])

    asked = chunks.mapInArrow(ask, "chunk long, grp long, raw binary").selectExpr("chunk", "grp", "raw", "cast(null as long) n_bits", "cast(null as long) segment")
    both = asked.union(table.select(F.lit(0).cast("long"), F.expr(f"segment div {GROUP}"), "bits", "n_bits", "segment"))
    both = both.repartition("grp").sortWithinPartitions("grp", F.col("n_bits").isNull())
    answers = both.mapInArrow(answer, "chunk long, grp long, raw binary")
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("grp", "raw"))).alias("got")).select("chunk", F.col("got.raw").alias("pairs"))


def probability(level: np.ndarray, history: np.ndarray, word: np.ndarray, tokens: int, words: int, without: int = 0, false_words: float = FALSE_WORDS, once: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count of the history, frequency of the pair after it, add-one probability of the word; ``without``: occurrences to leave out; ``once``: what a pair with a word seen once counts."""
    pair = np.where(level > 0, np.left_shift(1, np.maximum(level.astype(np.int64) - 1, 0)), 0)
    pair = np.maximum(np.minimum(pair, np.minimum(history, word)) - without, 0)
    history, word = np.maximum(history - without, 0), np.maximum(word - without, 0)
    pair = np.where(np.minimum(history, word) == 1, once, 1.0) * pair
    return history, pair / (history + false_words), (word + 1) / (tokens - without + words + 1)


def bucket(history: np.ndarray) -> np.ndarray:
    return np.frexp(history.astype(np.float64))[1]


def _list(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    """A row's list, null as none."""
    x = batch.column(name)[i]
    return x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict, pa.RecordBatch]]:
    """Chunks one by one, with their row's binary columns, and its lists as a batch of one row."""
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in b.schema.names if n not in ("words", "words_at", "pairs")}
            yield Chunk(row), row, b.slice(i, 1)


def _row(row: dict, names: str, **more: bytes) -> pa.RecordBatch:
    kinds = {x.split()[0]: {"long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[x.split()[1]] for x in names.split(", ")}
    return pa.RecordBatch.from_pydict({n: [(row | more)[n]] for n in kinds}, schema=pa.schema(kinds))


def counted_chunks(ws: Workspace, chunks: DataFrame, words: DataFrame, enough: int) -> DataFrame:
    """Chunks with the training count of each of their words, written."""
    often = ws.spark.sparkContext.broadcast(_sorted_table(words.where(F.col("c") >= enough), "word", "c"))

    def attach(batches):
        for c, row, lists in _each(batches):
            counts, _ = _looked_up(often.value, c.vocab)
            counts[_list(lists, "words_at", 0)] = _list(lists, "words", 0)
            yield _row(row, _COUNTED, counts=squeeze(counts.astype(np.uint64)))

    out = ws.keep(chunks.join(rare_counts(chunks, words, often), "chunk", "left").mapInArrow(attach, _COUNTED), "counted")
    often.unpersist()
    return out


def ready_chunks(ws: Workspace, counted: DataFrame, table: DataFrame, segments: int, probes: int, broadcast_bytes: int) -> DataFrame:
    """Chunks with the counts of their words and the level of each token's pair, written: all that scoring takes."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    whole, asked = None, counted
    if size <= broadcast_bytes:
        whole = ws.spark.sparkContext.broadcast(Filter(segments, probes, {r["segment"]: (r["n_bits"], bytes(r["bits"])) for r in table.toLocalIterator()}))
    else:
        asked = counted.join(asked_levels(counted, table, segments, probes), "chunk", "left")

    def level(batches):
        for c, row, lists in _each(batches):
            at, keys = c.pairs()
            keys, back = np.unique(keys, return_inverse=True)
            if whole is not None:
                got = whole.value.levels(keys)
            else:
                parts = lists.column("pairs")[0]
                got = np.concatenate([np.zeros(0, np.uint8), *(loosen(x.as_py(), np.uint8) for x in (parts.values if parts.is_valid else ()))])
            out = np.zeros(len(c.idx), np.uint8)
            out[at] = got[back]
            yield _row(row, _READY, levels=squeeze(out))

    ready = ws.keep(asked.mapInArrow(level, _READY), "ready")
    if whole is not None:
        whole.unpersist()
    return ready


def _token_parts(c: Chunk, row: dict, tokens: int, words: int, without: int, false_words: float, once: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return probability(loosen(row["levels"], np.uint8), c.counts[c.history()], c.counts[c.idx], tokens, words, without, false_words, once)


#: Steps of the ratio between relative frequency and add-one probability: 32 a doubling, around 1.
_STEPS, _MIDDLE = 32, 2048


def fit_weights(ready: DataFrame, tokens: int, words: int, false_words: float = FALSE_WORDS) -> tuple[dict[int, float], float]:
    """Weight of the pair's frequency per doubling of the history's count, by expectation-maximisation, and what a pair with a word seen once counts.

    All training tokens take part, each left out of its own counts; what reaches the driver is a histogram whose size
    depends on the number of doublings and steps alone.
    """
    cells = 2 * _MIDDLE + 1

    def tally(batches):
        total = np.zeros(2 * 64 * cells, np.int64)
        for c, row in _chunks(batches):
            t = c.trains()
            ch, seen, single = (x[t] for x in _token_parts(c, row, tokens, words, 1, false_words))
            rare = np.minimum(ch, c.counts[c.idx][t] - 1) == 1
            with np.errstate(divide="ignore"):
                step = np.where(seen > 0, np.clip(np.round(np.log2(np.maximum(seen, 1e-300) / single) * _STEPS), 1 - _MIDDLE, _MIDDLE) + _MIDDLE, 0).astype(np.int64)
            total += np.bincount(((rare * 64 + bucket(ch).astype(np.int64)) * cells + step)[ch > 0], minlength=len(total))
        b, s = np.divmod(np.flatnonzero(total), cells)
        yield _batch(b=b, step=s, n=total[total > 0])

    rows = ready.mapInArrow(tally, "b long, step long, n long").groupBy("b", "step").agg(F.sum("n").alias("n")).collect()
    rare = [r for r in rows if r["b"] >= 64]
    once = sum(r["n"] for r in rare if r["step"]) / max(1, sum(r["n"] for r in rare))
    out = {}
    for b in sorted({r["b"] % 64 for r in rows}):
        own = sorted((r["b"], r["step"], r["n"]) for r in rows if r["b"] % 64 == b)
        ratio = np.array([0.0 if s == 0 else 2.0 ** ((s - _MIDDLE) / _STEPS) * (once if k >= 64 else 1) for k, s, _ in own])
        n = np.array([k for *_, k in own], float)
        w = 0.5
        for _ in range(200):
            w = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
            w = min(w, 0.999)
        out[b] = w
    return out, once


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, segment_pairs: int = SEGMENT_PAIRS, broadcast_bytes: int = BROADCAST_BYTES, false_words: float = FALSE_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Words are what white space parts, A-Z in lower case; each text ends with an end token. Texts whose crc32(id) mod 7
    is 2 are scored but not learned from. Null and empty texts are their end token. A null id counts as the empty text;
    repeated rows are learned from and scored each. Texts are read whole; a longer one than a chunk is a chunk of its
    own. Other columns are ignored. No rows: no rows. Without training texts only the base remains.
    """
    ws = Workspace(docs.sparkSession, "lmscore")

    def measure(batches):
        for c, _ in _chunks(batches):
            yield _batch(train=np.array([c.trains().sum()], np.int64))

    chunks = ws.keep(chunk_texts(docs, id_col, text_col, chunk_tokens), "chunks")
    tokens = chunks.select("chunk", "doc_ids", "held", "lens", "idx").mapInArrow(measure, "train long").agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    words = word_counts(ws, chunks)
    vocabulary = words.count()
    segments, probes, enough = max(1, -(-tokens // segment_pairs)), first_probes(vocabulary, false_words), max(2, -(-tokens // FREQUENT))
    counted = counted_chunks(ws, chunks, words, enough)
    ws.drop(chunks, words)
    ws.release()
    table = build_filter(ws, counted, segments, probes)
    ws.release()
    ready = ready_chunks(ws, counted, table, segments, probes, broadcast_bytes)
    ws.drop(counted, table)
    weights, once = fit_weights(ready, tokens, vocabulary, false_words)

    def score(batches):
        by_bucket = np.array([weights.get(b, 0.0) for b in range(65)])
        for c, row in _chunks(batches):
            ch, seen, single = _token_parts(c, row, tokens, vocabulary, 0, false_words, once)
            w = by_bucket[bucket(ch)] * (ch > 0)
            known = (c.counts[c.idx] > 0).astype(np.int64)
            cols = [
                pa.array(c.doc_ids, pa.int64()), pa.array(c.held), pa.array(c.lens), pa.array(np.add.reduceat(known, c.starts)), pa.array(np.full(len(c.lens), tokens, np.int64)),
                pa.array(np.add.reduceat(np.log10(single), c.starts)), pa.array(np.add.reduceat(np.log10(w * seen + (1 - w) * single), c.starts)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
