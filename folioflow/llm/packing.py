"""Best-fit packing of token pieces: a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. Multiplicative weights price the lengths, a knapsack
dynamic program finds the dearest configuration, and the cover is rounded to whole sequences; what rounding leaves is
priced again, and best fit takes the rest once a solution places little of it. All of this works on the histogram
(one row per length), also best fit, so the driver's work does not grow with the number of pieces; ranks within a length
tie pieces to sequences without moving them together.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, small_table

CAPACITY, END_ID = 1024, 2
#: Rows that are ranked together, and buckets of such in all (besides one a length).
BUCKET_ROWS, MAX_BUCKETS = 1 << 20, 1 << 18


def best_knapsack(price: np.ndarray, capacity: int) -> dict[int, int]:
    """Multiset of lengths (index of ``price``, 0 unused) of total at most ``capacity`` with the highest sum of prices."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(price) - 1)
        v = best[c - m : c][::-1] + price[1 : m + 1]
        k = int(v.argmax())
        if v[k] > best[c - 1]:
            best[c], take[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if take[c] and best[c] > best[c - 1]:
            out[int(take[c])] += 1
            c -= int(take[c])
        else:
            c -= 1
    return dict(out)


def fractional_cover(demand: dict[int, int], capacity: int, rounds: int = 3000, eta: float = 3.0, dear: float = 2.0) -> list[tuple[dict[int, int], float]]:
    """Configurations and how many of each (fractional) cover the demand, by multiplicative weights.

    A length's price starts as the share of a sequence it takes to the power ``dear``, so long pieces are covered while there
    are short ones to go with them, and falls exponentially with the share of its demand that is covered. Each round buys
    the dearest configuration for the demand of its scarcest length; scaled so that nine tenths of the lengths are covered
    at most once, what stays over is for the rounding.
    """
    lengths = np.array(sorted(demand))
    d = np.array([demand[x] for x in lengths], float)
    covered, found = np.zeros(len(d)), {}
    for _ in range(rounds):
        price = np.zeros(capacity + 1)
        price[lengths] = (lengths / capacity) ** dear * np.exp(-eta * (covered - covered.mean()))
        config = best_knapsack(price, capacity)
        at = np.searchsorted(lengths, list(config))
        m = np.array(list(config.values()), float)
        amount = (d[at] / m).min()
        covered[at] += amount * m / d[at]
        key = tuple(sorted(config.items()))
        found[key] = found.get(key, 0.0) + amount
        if covered.mean() >= 1:
            break
    scale = 1 / max(1e-9, float(np.percentile(covered, 90)))
    return [(dict(k), x * scale) for k, x in found.items()]


Pattern = tuple[tuple[int, int], ...]


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing, all bins of one content at a time: {pattern of (length, how often): bins}. A length fills the fullest bins that hold it."""
    free: dict[int, dict[Pattern, int]] = {capacity: {}}
    out: Counter = Counter()
    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        while n > 0:
            room = min((r for r, bins in free.items() if r >= x and bins), default=None)
            if room is None:
                room, pattern, bins = capacity, (), n
            else:
                pattern, bins = free[room].popitem()
            each = min(room // x, n)
            used = min(bins, n // each)
            if bins > used and pattern:
                free[room][pattern] = bins - used
            after = free.setdefault(room - each * x, {})
            grown = (*pattern, (x, each))
            after[grown] = after.get(grown, 0) + used
            n -= each * used
    for bins in free.values():
        for pattern, n in bins.items():
            out[pattern] += n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], int]:
    """Length histogram -> [(configuration as (length, how often) pairs, number of sequences)], each piece used exactly once; and how many sequences best fit made.

    The program's configurations that leave at most a 512th of a sequence empty are rounded, those with the longest piece
    first, as long as their pieces last. Then the program is solved for what is left, until a solution places less than a quarter of it.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("a length is outside 1..capacity")
    out: Counter = Counter()
    if full := left.pop(capacity, 0):
        out[((capacity, 1),)] += full
    while left:
        before = sum(left.values())
        found = [(config, x) for config, x in fractional_cover(left, capacity) if sum(k * m for k, m in config.items()) >= capacity - capacity // 512]
        for config, x in sorted(found, key=lambda f: (-max(f[0]), -f[1])):
            n = min(max(1, round(x)), *(left.get(k, 0) // m for k, m in config.items()))
            if n > 0:
                out[tuple(sorted(config.items(), reverse=True))] += n
                for k, m in config.items():
                    left[k] -= n * m
                    if not left[k]:
                        del left[k]
        if 4 * sum(left.values()) > 3 * before:
            break
    rest = best_fit(left, capacity)
    return list((out + rest).items()), rest.total()


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first ranks, first sequences, offsets): ranks of that length from each first rank on fill one slot of consecutive sequences."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for config, n in patterns:
        offset = 0
        for length, m in config:
            for _ in range(m):
                out.setdefault(length, []).append((used[length], sequence, offset))
                used[length] += n
                offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(ws: Workspace, pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to every row of ``pieces`` (``length``: 1..capacity), which are written first.

    Every row gets a number of its own. A piece of full length is a sequence by itself and takes that number, so it is not
    shuffled. The others are ranked within their length: a length is cut into buckets of about ``bucket_rows`` rows (more
    if MAX_BUCKETS would not do), and a rank is one within the bucket plus the rows of earlier buckets; so neither a length
    that many rows share nor a row that repeats is one task's work. Collected and broadcast are the histogram and at most
    MAX_BUCKETS + ``capacity`` bucket sizes.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    rows = ws.keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect()}
    whole = rows.where(F.col("length") == capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = {k: n for k, n in histogram.items() if k != capacity}
    if not rest:
        return whole
    most = max(bucket_rows, -(-sum(rest.values()) // MAX_BUCKETS))
    cut = small_table(spark, [(k, -(-n // most)) for k, n in rest.items()], "length bigint, _buckets bigint")
    part = rows.where(F.col("length") != capacity).join(F.broadcast(cut), "length")
    part = part.withColumn("_bucket", F.col("length") * (1 << 32) + F.pmod(F.xxhash64("_row"), F.col("_buckets")))
    sizes = part.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    bucket, size = (sizes.column(c).to_numpy() for c in ("_bucket", "n"))
    order = np.argsort(bucket)
    bucket, size = bucket[order], size[order]
    before = np.cumsum(size) - size
    first = before - before[np.searchsorted(bucket, bucket >> 32 << 32)]  # rows of the length's earlier buckets
    shared = spark.sparkContext.broadcast((slots(plan(rest, capacity)[0]), bucket, first))
    ranked = part.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_row")).cast("long") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, buckets, starts = shared.value
        for b in batches:
            length, own, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_bucket", "_rank"))
            rank = rank + starts[np.searchsorted(buckets, own)] if len(rank) else rank
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(i):
                    ranks, seqs, offs = where[int(length[i[0]])]
                    k = np.searchsorted(ranks, rank[i], "right") - 1
                    seq[i], off[i] = seqs[k] + rank[i] - ranks[k], offs[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = ranked.select(*names, "_bucket", "_rank").mapInArrow(place, f"{kind}, sequence_id long, offset long")
    return placed.union(whole)


class Encoder:
    """Ids of a byte-level BPE vocabulary file of ``tokenizers``, held to that library's own ids while it runs.

    The file's vocabulary is handed to an engine that is several times as fast (by the library alone packing takes more CPU time than
    its budget). One text in ``checked``, the first of each task among them, is encoded by the library, too, and must give the same
    ids, or the job stops; texts on which the engine gives up are the library's.
    """

    def __init__(self, path: str, pattern: str, checked: int = 64):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are the parallelism
        self.whole, self.checked, self.seen = Tokenizer.from_file(path), checked, 0
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow from 256 on
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in special}
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        try:
            ids = np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        except (ValueError, RuntimeError):  # the pattern engine gives up on very long runs of one kind
            return self.by_library(text)
        if self.seen % self.checked == 0 and not np.array_equal(ids, self.by_library(text)):
            raise ValueError("the engine's ids differ from those of tokenizers")
        self.seen += 1
        return ids


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str | None = None, pattern: str | None = None) -> Encoder:
    import public_tokenizers as P

    key = vocabulary or P.path("byte_bpe_50k.json"), pattern or P.PATTERN
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    _ENCODERS[key].seen = 0
    return _ENCODERS[key]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids plus the end id; the first piece takes the odd length."""
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary_path)
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                out: dict[str, list] = {k: [] for k in kinds}
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    starts = [0, *range(first, len(ids), capacity)]
                    for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        for c, v in zip(out.values(), (doc, k, a, z - a, zlib.crc32(ids[a:z].tobytes())), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds.values(), strict=True)], names=list(kinds))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """All documents' pieces with the sequence and the place each goes to.

    Null and empty texts have one piece, the end id. Repeated rows are packed each for itself. Very long texts are cut
    into pieces of ``capacity``. Other columns are ignored. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws, token_pieces(docs, capacity, vocabulary_path), capacity)
