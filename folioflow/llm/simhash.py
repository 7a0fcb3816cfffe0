"""Near-duplicate documents: SimHash fingerprints linked through a Golay-code fuzzy index.

The 64 bits are cut into segments of 22, 21 and 21 bits, each a [23,12,7] Golay word with leading zeros. The code is
perfect: a word lies within 3 bits of exactly one codeword, and a word one bit away decodes to one of at most six
codewords known from the word alone. Those indices are a segment's keys; two segments that differ in at most one bit
share one. Of at most three differing bits, either a segment is untouched and another has at most one (keys: exact
segment + codeword, six ways), or each segment has exactly one (keys: two codewords + the untouched half of the third,
two ways). So every link shares a key of 33 bits or more; candidates are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components

MAX_BITS = 3
WIDTHS, SHIFTS = (22, 21, 21), (42, 21, 0)
#: Members of one key that a task compares among themselves; larger groups go by common midpoints.
RUN_CAP = 4096


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """Majority of the XXH64 (seed 42) bits over the word n-shingles of UTF-8 bytes; no words: 0."""
    words = text.lower().split() if text else []  # bytes.lower: A-Z only; bytes.split: 0x20, 0x09-0x0D
    if not words:
        return 0
    total, counts = max(1, len(words) - n + 1), np.zeros(64, np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else iter([b" ".join(words)])
    while len(h := np.array(list(map(xxhash.xxh64_intdigest, islice(shingles, 1 << 16), repeat(42))), np.uint64)):
        lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        counts += np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long. Null and empty texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                fps = np.array([fingerprint(x.as_py()) for x in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _nearest() -> np.ndarray:
    """12-bit index of the one codeword within three bits, for every word of 22 bits."""
    g = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    syndrome_of_bit = []
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= g << (k - 11)
        syndrome_of_bit.append(r)
    leader = np.zeros(2048, np.uint32)
    for i in range(23):
        leader[syndrome_of_bit[i]] = 1 << i
        for j in range(i):
            leader[syndrome_of_bit[i] ^ syndrome_of_bit[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[syndrome_of_bit[i] ^ syndrome_of_bit[j] ^ syndrome_of_bit[k]] = 1 << i | 1 << j | 1 << k
    u = np.arange(1 << 22, dtype=np.uint32)
    s = np.zeros(1 << 22, np.uint16)
    for bit in range(22):
        s ^= np.where(u >> bit & 1, syndrome_of_bit[bit], 0).astype(np.uint16)
    return ((u ^ leader[s]) >> 11).astype(np.uint16)


_TABLE: list[np.ndarray] = []


def _codewords(seg: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 6) codeword indices of words within one bit of ``seg``, and which of them are distinct."""
    if not _TABLE:
        _TABLE.append(_nearest())
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    near = np.sort(_TABLE[0][seg.astype(np.uint32)[:, None] ^ flips], axis=1)
    new = np.concatenate([np.ones((len(seg), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    place = np.cumsum(new, axis=1) - 1
    out, ok = np.zeros((len(seg), 6), np.uint64), np.zeros((len(seg), 6), bool)
    r, c = np.nonzero(new)
    out[r, place[r, c]], ok[r, place[r, c]] = near[r, c], True
    return out, ok


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of unsigned 64-bit fingerprints."""
    segs = [fps >> np.uint64(s) & np.uint64((1 << w) - 1) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    codes = [_codewords(s, w) for s, w in zip(segs, WIDTHS, strict=True)]
    rows, keys = [], []
    u = np.uint64
    kind = 0
    for exact in range(3):
        for other in range(3):
            if exact != other:
                idx, ok = codes[other]
                r, c = np.nonzero(ok)
                rows.append(r)
                keys.append(u(kind << 60) | segs[exact][r] << u(12) | idx[r, c])
                kind += 1
    pair_ok = codes[0][1][:, :, None] & codes[1][1][:, None, :]
    r, c, d = np.nonzero(pair_ok)
    both = codes[0][0][r, c] << u(12) | codes[1][0][r, d]
    for half in (segs[2] >> u(11), segs[2] & u(2047)):
        rows.append(r)
        keys.append(u(kind << 60) | both << u(11) | half[r])
        kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _spread(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning links (<= 3 bits) of the groups that distinct fingerprints form; each is compared once with those not yet reached."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[: max(1, 2_000_000 // len(left))], front[max(1, 2_000_000 // len(left)) :]
            hit = np.bitwise_count(block[:, None] ^ left[None, :]) <= MAX_BITS
            got = hit.any(0)
            if got.any():
                a += block[hit[:, got].argmax(0)].tolist()
                b += left[got].tolist()
                front, left = np.concatenate([front, left[got]]), left[~got]
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> verified links (a, b); members of keys over RUN_CAP come back as (fp, null)."""

    def table(a, b):
        a, b = np.array(a, np.uint64).view(np.int64), b if b is None else np.array(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["a", "b"])

    def whole(k, f):
        """Complete runs."""
        if len(k) < 2:
            return
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        run = np.repeat(np.arange(len(start)), size)
        small = np.repeat(size < 8, size)
        for d in range(1, 8):
            i = np.flatnonzero((run[d:] == run[:-d]) & small[d:]) if len(k) > d else []
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= MAX_BITS]
            if len(i):
                yield table(f[i], f[i + d])
        for s, n in zip(start[size >= 8], size[size >= 8], strict=True):
            if n > RUN_CAP:
                yield table(f[s : s + n], None)
                continue
            a, b = _spread(f[s : s + n])
            if a:
                yield table(a, b)

    hold_k, hold_f, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        k = np.concatenate([hold_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([hold_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if hot is not None:
            n = int(np.searchsorted(k, hot, "right"))
            if n:
                yield table(f[:n], None)
            k, f = k[n:], f[n:]
        if not len(k):
            hold_k, hold_f = k, f
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))
        yield from whole(k[:cut], f[:cut])
        hold_k, hold_f, hot = k[cut:], f[cut:], None
        if len(hold_k) > RUN_CAP:
            yield table(hold_f, None)
            hot, hold_k, hold_f = hold_k[0], hold_k[:0], hold_f[:0]
    yield from whole(hold_k, hold_f)


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> every word within two bits of it, with the distance."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    dist = np.concatenate([[0], np.ones(64), np.full(len(i), 2)]).astype(np.int32)
    for b in batches:
        f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for x in (f[s : s + 64] for s in range(0, len(f), 64)):
            mid = (x[:, None] ^ masks[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(x, len(masks)).view(np.int64)), pa.array(np.tile(dist, len(x)))], names=["mid", "fp", "d"])


def link_fingerprints(ws: Workspace, fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose closure equals that of all pairs at <= 3 bits.

    Keys are shuffled once and compared inside sorted runs; a run yields at most one link per member beyond the
    first when it has 8 members or more. A run over RUN_CAP is not held: its members are linked through midpoints. Two fingerprints at
    most 3 bits apart have a word within 1 bit of one and 2 of the other; at such a word all members within 2 bits may
    link to any member within 1, so one star per word is exact, with at most 2081 members by counting.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for x in (f[s : s + 2048] for s in range(0, len(f), 2048)):
                r, k = golay_keys(x)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(x[r].view(np.int64))], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = ws.keep(keyed.mapInArrow(_links, "a long, b long"), "candidates")
    links = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    stars = (
        hot.mapInArrow(_midpoints, "mid long, fp long, d int").groupBy("mid")
        .agg(F.min(F.when(F.col("d") <= 1, F.col("fp"))).alias("a"), F.collect_list("fp").alias("all"))
        .where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b")
    )
    return links.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id linked, itself included), copies.

    Equal fingerprints are one node from the start, so a group of exact copies costs one row in the search. Null and
    empty texts have fingerprint zero and link like any other. Rows with a null id get their group's id (null if the
    group has no other). Repeated rows come back repeated; other columns are ignored. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.keep(with_fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = ws.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "nodes")
    links = ws.keep(link_fingerprints(ws, nodes), "verified")
    labels = connected_components(ws, links)
    ws.drop(links)
    linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = ws.keep(linked.join(groups, "label").select("fp", "component_id", "copies"), "classes")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
