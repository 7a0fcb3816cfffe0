"""Near copies by fingerprint and by text: SimHash links widened to texts whose five-word shingles are alike by 4/5 or more.

Links within three bits come from the Golay index (``simhash``). A text of which more than a fifth of the shingles are in no
other text is alike to none; shingles are counted over all texts (``prints``), and only the other texts are looked at further. They are found by a
pigeonhole on their sets of shingles: sets of likeness 4/5 differ in at most a ninth of their sizes together, so cut by
hash into some segments more than that, they agree on segments that no difference touches. A segment's key is a hash of its shingles. Sizes
fall into classes (each half as large again), for which the number of segments is fixed; a text that may have partners in the next class
gives keys for that one, too. Segments may be empty and then have no key; a set with too few others to be sure of a shared one also
gives its least hashes, a fifth of them and one: of two such sets alike by 4/5, those share one. So two sets of likeness 4/5 share a key, always.

Groups grow in rounds. In a round every key names one of its texts (another in every round), and every group takes three of the
texts that its keys name: the one named most often, the shortest, and any. These pairs are verified on the whole sets; so a round
verifies at most three pairs a group, however large a group of copies is or however many texts share a passage. Rounds end when one
joins no groups, or after ROUNDS. They only make the rest small, which is searched exhaustively: all pairs of texts of different
groups that share a key are counted by shared keys, and verified if these are as many as sets of their sizes and likeness 4/5
must share. Keys of over HOT texts are left out there: a text with no more of them than keys to spare shares others with any
partner for certain. Texts with more meet each other by their rarest shingles, a fifth of them and one, of which two sets of likeness 4/5 share one.
These are not paired by rows: texts are dealt into blocks, those of a family together, and any two blocks with such a shingle in common are
compared as a whole, by matrix products over their sets, which give the exact sizes of all intersections. What leaves are links between groups, fewer than groups in the blocks. Rows grow
with texts times blocks of a family; only the products, of a family too large for a block, grow with the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components
from .simhash import fingerprint, link_fingerprints

WORDS = 5
ROUNDS = 3
#: Keys of more texts are left out where others do.
HOT = 64
#: Shingles of a block of texts, each text counted as TEXT shingles more: so many at most, more or less; and where so many, a family is cut further into up to SPREAD blocks, for more tasks.
TILE, LEAST_TILE, SPREAD, TEXT = 1 << 18, 1 << 15, 16, 128
#: Shingles (and TEXT for each text) of the texts that ask together which of their shingles are in no other text.
CHUNK = 1 << 19
#: Shingles of a range of hashes, if words are of five bytes; a range is one task's at once.
RANGE = 1 << 22
#: Keys of texts that may be told to all tasks; more are joined.
TOLD_KEYS = 1 << 22
#: Rows (id and key) of such a table that may be broadcast.
TOLD_ROWS = 1 << 20
#: Keys that a task remembers so that it gives the segments of a repeated text once.
REMEMBERED = 1 << 18


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-shingles; fewer words: of all of them; no words: none."""
    words = text.lower().split() if text else []
    whole = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)] if words else [])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in whole), np.uint64))


def _class_ends(size: int) -> list[int]:
    """Largest size of the class that holds ``size``, and of the next if a set of ``size`` has partners there."""
    top = 4
    while top < size:
        top = top * 3 // 2
    return [top, top * 3 // 2] if 5 * size // 4 > top else [top]


def segment_keys(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set, and what they are: two sets of likeness 4/5 or more share one.

    A key's mark holds how many segments of its class have one (from bit 18), one more than how many of these may be
    left out so that with any partner one is still shared (12 bits; 0: none is sure), and the class (6 bits; 0: a least hash).
    """
    size, out, marks, unsure = len(sets), [], [], False
    for top in _class_ends(size) if size else ():
        most = 2 * top // 9
        n = most + 1 + (most + 7) // 8
        segment = (sets >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), size]
        out += [xxhash.xxh64_intdigest(sets[a:z].tobytes(), top << 24 | int(segment[a])) for a, z in zip(cuts, cuts[1:], strict=False)]
        have = len(cuts) - 1
        sure = max(0, have - (size + min(top, 5 * size // 4)) // 9)
        unsure |= sure == 0
        marks += [have << 18 | min(sure, 4095) << 6 | _class_number(top)] * have
    if unsure:
        least = sets[: size // 5 + 1]
        out += [xxhash.xxh64_intdigest(x.tobytes(), 1) for x in least]
        marks += [1 << 18] * len(least)
    return np.array(out, np.uint64), np.array(marks, np.int64)


def _class_number(top: int) -> int:
    number, end = 1, 4
    while end < top:
        end, number = end * 3 // 2, number + 1
    return number


def prints(ws: Workspace, docs: DataFrame, text_col: str) -> DataFrame:
    """(key, fp, n, own), written, of every text (key: XXH64 of the text): fingerprint, size of its set, how many of its shingles no other text has.

    Chunks of texts send their shingles to ranges of hashes, 32 bits each beyond the range's, and get counts back. Texts that are
    repeated in several tasks have several rows, whose shingles count as those of different texts; a hash shared by chance does so, too: ``own`` may be too small, never too large.
    """
    texts = _keyed(docs, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(5, (size // (6 * RANGE)).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        chunk, held, rows = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen = set()
                seen.add(key)
                text = text.as_py()
                rows.append((key, fingerprint(text), shingles(text)))
                held += len(rows[-1][2]) + TEXT
                if held >= CHUNK:
                    yield _asked(chunk, bits, rows)
                    chunk, held, rows = chunk + 1, 0, []
        if rows:
            yield _asked(chunk, bits, rows)

    def gather(t: pa.Table) -> pa.Table:
        if t.num_rows != 1 << bits or len(t["digest"].unique()) != 1:
            raise RuntimeError("a part of the texts was read twice, with different rows")
        first = t["range"].to_pylist().index(0)
        keys, fps, sizes = (np.frombuffer(t[c][first].as_py(), kind) for c, kind in (("keys", np.int64), ("fps", np.int64), ("sizes", np.int32)))
        own = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.uint32).astype(np.int32) for x in t["own"])
        return pa.table([pa.array(x) for x in (keys, fps, sizes, own)], names=["key", "fp", "n", "own"])

    asked = texts.select("key", F.col("text").cast("binary")).mapInArrow(ask, f"{_ASKED}, counts binary, shingles binary")
    told = asked.groupBy("range").applyInArrow(_told, f"{_ASKED}, own binary")
    return ws.keep(told.groupBy("chunk").applyInArrow(gather, "key long, fp long, n int, own int"), "prints")


#: A chunk's row of a range; the first range's row brings the texts' keys, fingerprints and sizes, too.
_ASKED = "range int, chunk long, digest long, keys binary, fps binary, sizes binary"


def _asked(chunk: int, bits: int, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """The chunk's rows, one a range: how many shingles each text has there, and the shingles, text after text."""
    keys, fps, sizes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64), np.array([len(r[2]) for r in rows], np.int32)
    every, n = np.concatenate([r[2] for r in rows]), 1 << bits
    at = (every >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.bincount(at * len(rows) + np.repeat(np.arange(len(rows)), sizes), minlength=n * len(rows)).astype(np.uint32).reshape(n, -1)
    values = (every >> np.uint64(32 - bits)).astype(np.uint32)[np.argsort(at, kind="stable")]
    ends = np.cumsum([0, *counts.sum(1).tolist()]).tolist()
    small = zstandard.ZstdCompressor(level=1)
    once = [pa.array([x.tobytes(), *[None] * (n - 1)], pa.binary()) for x in (keys, fps, sizes)]
    packed = [pa.array([small.compress(c.tobytes()) for c in counts], pa.binary()), pa.array([values[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary())]
    digest = np.array([xxhash.xxh64_intdigest(keys.tobytes())], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, chunk)), pa.array(np.repeat(digest, n)), *once, *packed], names=["range", "chunk", "digest", "keys", "fps", "sizes", "counts", "shingles"])


def _told(t: pa.Table) -> pa.Table:
    """The rows of a range, with how many of each text's shingles no other text has."""
    every = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t["shingles"]])
    order = np.argsort(every)
    new = np.ones(len(every) + 1, bool)
    new[1:-1] = every[order[1:]] != every[order[:-1]]
    alone = np.empty(len(every), bool)
    alone[order] = (new[1:] & new[:-1])[: len(every)]
    small, own, a = zstandard.ZstdCompressor(level=1), [], 0
    for x in t["counts"]:
        counts = np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
        z = a + int(counts.sum())
        owner = np.repeat(np.arange(len(counts)), counts)[alone[a:z]]
        own.append(small.compress(np.bincount(owner, minlength=len(counts)).astype(np.uint32).tobytes()))
        a = z
    return t.drop_columns(["counts", "shingles"]).append_column("own", pa.array(own, pa.binary()))


def _marked(sets: DataFrame) -> DataFrame:
    """(key, n, tokens, marks) of the sets: sizes and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                own = [x.values.to_numpy().view(np.uint64) for x in part.column(1)]
                tokens, marks = zip(*map(segment_keys, own), strict=True)
                ends = pa.array(np.cumsum([0, *map(len, tokens)]).astype(np.int32))
                flat, what = pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(marks))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in own], pa.int32()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, what)], names=["key", "n", "tokens", "marks"])

    return sets.select("key", "tokens").mapInArrow(run, "key long, n int, tokens array<long>, marks array<long>")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))


def _sets(ws: Workspace, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, tokens), written: the sorted hashes (as unsigned) of all shingles of the texts with these keys.

    Up to TOLD_KEYS keys (32 MB) are broadcast, so that texts are filtered where they are read; beyond, texts are joined with them.
    """
    told = None
    if (n := keys.count()) <= TOLD_KEYS:
        told = ws.spark.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()) if n else np.zeros(0, np.int64))
    else:
        texts = texts.join(keys, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            own = b.column(0).to_numpy()
            wanted = np.ones(len(own), bool) if told is None else _among(told.value, own)
            keys, sets = [], []
            for i in np.flatnonzero(wanted).tolist():
                key = int(own[i])
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen = set()
                    seen.add(key)
                    keys.append(key)
                    sets.append(shingles(b.column(1)[i].as_py()))
                if len(keys) == 256 or (keys and i == len(own) - 1):
                    yield _set_batch(keys, sets)
                    keys, sets = [], []
            if keys:
                yield _set_batch(keys, sets)

    found = texts.select("key", F.col("text").cast("binary")).mapInArrow(run, "key long, tokens array<long>")
    return ws.keep(found.groupBy("key").agg(F.first("tokens").alias("tokens")), "sets")


def _among(sorted_keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(own), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, own), len(sorted_keys) - 1)] == own


def _set_batch(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["key", "tokens"])


def _similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of keys whose whole sets have a likeness of 4/5 or more."""
    left, right = (sets.select(F.col("key").alias(k), F.col("tokens").alias(f"_{k}")) for k in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("_a") + F.size("_b"))).drop("_a", "_b")


def _relabel(ws: Workspace, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    found = connected_components(ws, links).withColumnRenamed("label", "further").withColumnRenamed("node", "label")
    out = ws.keep(labels.join(found, "label", "left").select("key", F.coalesce("further", "label").alias("label")), name)
    return out


def groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, label): the group of every distinct text, key the XXH64 of the text (null as empty).

    Texts are linked if their fingerprints lie within three bits (``simhash``) or their five-word shingles have a
    likeness of 4/5 or more; groups are the closure. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    texts = _keyed(docs, text_col)
    seen = prints(ws, docs, text_col)
    fps = ws.keep(seen.select("key", "fp").distinct(), "fingerprints")
    links = ws.keep(link_fingerprints(ws, fps.select("fp").distinct()), "verified")
    labels = _relabel(ws, fps.select("key", F.col("fp").alias("label")), links, "labels")
    ws.drop(links, fps)
    sets = _sets(ws, texts, seen.where("n > 0 and 5 * own <= n").select("key").distinct())
    ws.drop(seen)
    ws.release()
    marks = ws.keep(_marked(sets), "marks")
    posts = marks.select(F.explode(F.arrays_zip("tokens", "marks")).alias("t"), "key", "n").select(F.col("t.tokens").alias("token"), "key", "n", F.col("t.marks").alias("mark"))
    shared = posts.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token")
    open_ = ws.keep(posts.join(shared, "token").distinct(), "shared")
    ws.drop(marks)
    for turn in range(ROUNDS):
        named = open_.select("token", "key", "n", "mark").join(labels, "key")
        # one order for all keys of a round, so the same few texts are named within a large group: by hash, the shortest, the longest, by another hash, ..
        order = F.struct(F.lit(0) if turn % 3 == 0 else F.col("n") * (3 - 2 * (turn % 3)), F.xxhash64("key", F.lit(turn)))
        told = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("key", "n", "label"), order).alias("named")).where("lo <> hi")
        before, open_ = open_, ws.keep(named.join(told.select("token", "named"), "token"), "open")
        ws.drop(before)
        near = (F.col("label") != F.col("named.label")) & (5 * F.col("n") >= 4 * F.col("named.n")) & (5 * F.col("named.n") >= 4 * F.col("n"))
        votes = open_.where(near).groupBy("label", "key", "named").agg(F.count(F.lit(1)).alias("votes"))
        pair = [F.col(c).alias(a) for c, a in (("key", "a"), ("named.key", "b"), ("label", "la"), ("named.label", "lb"))]
        by = (F.col("votes").cast("long"), -F.col("named.n").cast("long"), F.xxhash64("named.key", F.lit(turn)))  # shares most keys, is shortest, any
        best = votes.groupBy("label").agg(*(F.max(F.struct(x.alias("by"), F.xxhash64("key", "named.key", F.lit(turn)).alias("tie"), *pair)).alias(f"c{i}") for i, x in enumerate(by)))
        pairs = ws.keep(best.select(F.explode(F.array("c0", "c1", "c2")).alias("c")).select("c.a", "c.b", "c.la", "c.lb").distinct(), "pairs")
        found = ws.keep(_similar(sets, pairs), "similar")
        joined = found.limit(1).count()
        if joined:
            last, labels = labels, _relabel(ws, labels, found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "labels")
            ws.drop(last)
        ws.drop(pairs, found)
        ws.release()
        if not joined and turn:
            break
    found = _rest(ws, open_.select("token", "key", "n", "mark"), labels, sets)
    if found.limit(1).count():
        labels = _relabel(ws, labels, found, "labels")
    ws.drop(found, sets, open_)
    ws.release()
    return labels


def _rest(ws: Workspace, posts: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), written: links of different groups, whose closure is that of all pairs of their texts that have a likeness of 4/5."""
    posts = posts.join(labels, "key")
    shared = posts.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("texts")).where("lo <> hi").select("token", "texts")
    posts = ws.keep(posts.join(shared, "token"), "rest")
    kind, sure, have = F.col("mark").bitwiseAND(63), F.shiftright("mark", 6).bitwiseAND(4095), F.shiftright("mark", 18)
    hot = posts.groupBy("key", "mark").agg(F.count_if(F.col("texts") > HOT).alias("hot"))
    by = [F.col(c).alias(x) for c, x in (("key", "a"), ("key_", "b"), ("label", "la"), ("label_", "lb"))]
    near = (F.col("key") < F.col("key_")) & (F.col("label") != F.col("label_")) & (5 * F.col("n") >= 4 * F.col("n_")) & (5 * F.col("n_") >= 4 * F.col("n"))

    cold = posts.where((F.col("texts") <= HOT) & (kind > 0)).join(hot, ["key", "mark"])
    left = cold.select("token", "key", "n", "label", kind.alias("class"), (have - F.col("hot")).alias("have"))
    right = left.select("token", *(F.col(c).alias(f"{c}_") for c in ("key", "n", "label", "have")))
    least = F.greatest("have", "have_") - F.floor((F.col("n") + F.col("n_")) / 9)  # under 1: both meet below
    votes = left.join(right, "token").where(near & (least >= 1)).groupBy(*by, "class", least.alias("least")).agg(F.count(F.lit(1)).alias("votes"))
    sharing = votes.where("votes >= least").select("a", "b", "la", "lb")

    unsure = hot.where(F.col("hot") >= sure).select("key").distinct()
    own = unsure.join(sets, "key").join(labels, "key").select("key", "label", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    texts = own.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("texts", "token"))
    rarest = ws.keep(own.join(texts, "token").withColumn("rank", rank).where("rank <= n div 5 + 1 and lo <> hi").select("key", "label", "n", "token"), "rarest")
    found = ws.keep(_similar(sets, sharing).select(F.col("la").alias("a"), F.col("lb").alias("b")).union(_compared(ws, rarest, sets)).distinct(), "similar")
    ws.drop(posts, rarest)
    return found


def _compared(ws: Workspace, rarest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of the groups of texts that share a token of ``rarest`` and have a likeness of 4/5.

    Which texts share a block only decides how many blocks meet, and not what is found.
    """
    family = rarest.select("key", "token", F.col("key").alias("family"))
    for _ in range(2):
        least = family.groupBy("token").agg(F.min("family").alias("least"))
        family = rarest.select("key", "token").join(family.select("key", "token", "family").join(least, "token").groupBy("key").agg(F.min("least").alias("family")), "key")
    own = rarest.select("key", "label", "n").distinct().join(family.select("key", "family").distinct(), "key")
    weight = F.sum(F.col("n") + TEXT)
    blocks = own.groupBy("family").agg(F.greatest(F.ceil(weight / TILE), F.least(F.ceil(weight / LEAST_TILE), F.lit(SPREAD))).alias("blocks"))
    own = ws.keep(own.join(blocks, "family").select("key", "label", "n", F.xxhash64("family", F.pmod(F.xxhash64("key"), "blocks")).alias("block")), "blocks")
    met = rarest.select("token", "key").join(own.select("key", "block"), "key").select("token", "block").distinct()
    tiles = ws.keep(met.join(met.withColumnRenamed("block", "other"), "token").where("block <= other").select("block", "other").distinct(), "tiles")
    texts = own.join(sets, "key").select("label", "tokens", F.col("block").alias("at"))
    left = tiles.join(texts, F.col("block") == F.col("at")).select("block", "other", F.lit(0).alias("side"), "label", "tokens")
    right = tiles.where("block < other").join(texts, F.col("other") == F.col("at")).select("block", "other", F.lit(1).alias("side"), "label", "tokens")
    return left.union(right).groupBy("block", "other").applyInArrow(_tile_links, "a long, b long")


def _tile_links(t: pa.Table) -> pa.Table:
    """Links (a, b) of labels of texts alike by 4/5, between the sides of a tile or (no second side) within one; of links that close a ring one is left out."""
    side, label = t["side"].to_numpy(), t["label"].to_numpy()
    sizes = t["tokens"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    every = np.concatenate([x.values.to_numpy() for x in t["tokens"]])
    rows, (column, token) = np.repeat(np.arange(len(side)), sizes), np.unique(every, return_inverse=True)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    place = np.zeros(len(side), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    mine = [np.flatnonzero(np.isin(rows, s)) for s in (left, right)] if side.any() else [np.arange(len(rows))] * 2
    counts = [np.bincount(token[m], minlength=len(column)) for m in mine]
    met = (counts[0] > 0) & (counts[1] > (0 if side.any() else 1))
    heavy = met & (counts[0] * counts[1] > len(left) * len(right) // 128)  # the others' pairs are counted one by one
    shared = np.zeros(len(left) * len(right), np.float32)
    width = max(2048, (1 << 22) // max(len(left), len(right)))
    for cut in np.array_split(np.flatnonzero(heavy), -(-int(heavy.sum()) // width) or 1):
        dense = []
        for m, s in zip(mine, (left, right), strict=True):
            at = np.full(len(column), -1)
            at[cut] = np.arange(len(cut))
            x = np.zeros((len(s), len(cut)), np.float32)
            own = m[at[token[m]] >= 0]
            x[place[rows[own]], at[token[own]]] = 1
            dense.append(x)
        shared += (dense[0] @ dense[1].T).ravel()
    light = met & ~heavy
    one, two = (m[light[token[m]]] for m in mine)
    one, two = one[np.argsort(token[one], kind="stable")], two[np.argsort(token[two], kind="stable")]
    begin, times = np.searchsorted(token[two], token[one]), counts[1][token[one]]
    ends = np.cumsum(times)
    for a in range(0, int(ends[-1]) if len(ends) else 0, 1 << 22):
        z = np.arange(a, min(a + (1 << 22), int(ends[-1])))
        i = np.searchsorted(ends, z, side="right")
        j = begin[i] + z - (ends[i] - times[i])
        pair = place[rows[one[i]]] * len(right) + place[rows[two[j]]]
        shared += np.bincount(pair, minlength=len(shared))
    alike = 9 * shared.reshape(len(left), -1).astype(np.float64) >= 4 * (sizes[left][:, None] + sizes[right][None, :])
    i, j = np.nonzero(alike & (label[left][:, None] != label[right][None, :]))
    found = np.unique(np.sort(np.stack([label[left][i], label[right][j]], 1), axis=1), axis=0)
    root: dict[int, int] = {}
    out = []
    for a, b in found.tolist():
        ends_ = []
        for x in (a, b):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            ends_.append(x)
        if ends_[0] != ends_[1]:
            root[ends_[0]] = ends_[1]
            out.append((a, b))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group exactly one row, with the smallest id. Rows without an id stay.

    If ids repeat, the row that stays is one of the smallest id (among its texts, that with the smallest hash); other
    rows of that id go only if they are in the same group.
    """
    ws = Workspace(docs.sparkSession, "copies")
    own = "_key"
    while own in docs.columns:
        own = f"_{own}"
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    narrow = keyed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"), F.col(own).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    rows = ws.keep(narrow.join(groups(docs, text_col), "key"), "rows")
    first = rows.groupBy("label").agg(F.min(F.struct("_id", "key")).alias("first"))
    rows = rows.join(first, "label").withColumn("stays", F.struct("_id", "key") == F.col("first"))
    gone = ws.keep(rows.where("not stays or rows > 1").select("_id", "key", "stays"), "gone")
    on = lambda g: (F.col(f"d.`{id_col}`") == g["_id"]) & (F.col(f"d.`{own}`") == g["key"])
    told = lambda t: F.broadcast(t) if t.count() <= TOLD_ROWS else t  # noqa: E731  # so that texts are not shuffled
    repeated = told(gone.where("stays"))
    gone = told(gone)
    rest = keyed.alias("d").join(gone, on(gone), "left_anti")
    again = keyed.alias("d").join(repeated, on(repeated), "left_semi").dropDuplicates([id_col, own])
    return rest.unionByName(again).select(docs.columns)
