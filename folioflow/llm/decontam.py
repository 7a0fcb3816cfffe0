"""Benchmark decontamination: windows of benchmark words, broadcast as a hash set, scanned over every document.

A window is a hash of its words' hashes. A block of the benchmark becomes sorted arrays of numbers (hash, a second hash,
item), about 20 bytes a window, made once on the driver, broadcast once and shared by all batches of a worker. A document's
windows are hashed together by array operations, looked up in a bitmap first, then in the sorted array, and a hit is
verified by the second hash, computed for hits alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: UTF-8 bytes of benchmark text that one broadcast may stand for (about 100 MB of arrays); larger benchmarks are scanned in blocks of whole items.
BLOCK_BYTES = 32 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 18
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Word bytes stay (lower-case letters, digits, everything beyond ASCII), the rest becomes a space.
_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_WORD).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


def rolled(x: np.ndarray, n: int, factor: np.uint64, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``n`` words that begin at ``starts`` (all)."""
    m = len(x) - n + 1 if starts is None else len(starts)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out ^= x[k : k + m] if starts is None else x[starts + k]
        out *= factor
    return out ^ out >> np.uint64(29)


class Windows:
    """Windows of a block of items: per number of words the sorted hashes, second hashes and item numbers, and a bitmap of the hashes' first bits."""

    def __init__(self, items: list[tuple[object, bytes | None]], n: int):
        hashes, found = _Hashes(), {}
        self.items = [str(i) for i, _ in items]
        for number, (_, text) in enumerate(items):
            x = hashes.of(words(text))
            if len(x):
                size = min(n, len(x))
                found.setdefault(size, []).append((rolled(x, size, _FIRST), rolled(x, size, _SECOND), np.full(len(x) - size + 1, number, np.int32)))
        self.tables = {}
        for size, parts in sorted(found.items()):
            h, check, item = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((item, check, h))
            h, check, item = h[order], check[order], item[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (item[1:] != item[:-1])])  # a window that an item repeats once
            bits = max(10, min(28, int(len(h)).bit_length() + 3))
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[size] = (h[new], check[new], item[new], np.packbits(bitmap, bitorder="little"), bits)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray | None, set[str]]:
        """Which words (hashes) lie inside an occurrence of a window, and the items of those windows."""
        hit, items = None, set()
        for size, (table, check, item, bitmap, bits) in self.tables.items():
            if len(x) < size:
                continue
            h = rolled(x, size, _FIRST)
            at = (h >> np.uint64(64 - bits)).astype(np.int64)
            near = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if not len(near):
                continue
            low, high = np.searchsorted(table, h[near]), np.searchsorted(table, h[near], "right")
            near, low, high = near[high > low], low[high > low], high[high > low]
            if not len(near):
                continue
            second = rolled(x, size, _SECOND, near)
            for start, a, z, c in zip(near.tolist(), low.tolist(), high.tolist(), second, strict=True):
                same = item[a:z][check[a:z] == c]
                if len(same):
                    hit = np.zeros(len(x), bool) if hit is None else hit
                    hit[start : start + size] = True
                    items.update(self.items[i] for i in same.tolist())
        return hit, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """Items in blocks of at most ``limit`` bytes (a single larger item alone), read one partition at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col).cast("binary")).toLocalIterator():
        size = len(row[1] or b"") + 64
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row[0], bytes(row[1]) if row[1] is not None else None))
        held += size
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """All rows and columns of ``docs`` plus ``names``: n_words, spans (array of (start, stop) word ranges that are hit), items (array of text).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer, but not none. Null and empty
    texts have no words and no hits; items without words have no windows; an empty benchmark hits nothing. Repeated
    rows of either table count each for itself (equal ids of items once). The benchmark goes to the workers as
    broadcasts that stand for at most ``block_bytes`` of its text each; a larger one is scanned block by block, and a document's spans and
    items grow from block to block, so memory is bounded and no item is left out. Input columns that bear one of
    ``names`` are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop(*names).withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"), names[2]: F.expr("cast(array() as array<string>)")})
    schema = out.schema

    def merged(old: list, hit: np.ndarray | None) -> list:
        if hit is None:
            return old
        for s in old:
            hit[s["start"] : s["stop"]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]

    def scan_with(shared, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, hashes = shared.value, _Hashes()
            for whole in batches:
                for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                    n_words, spans, items = [], [], []
                    for text, s, old in zip(b.column(at), b.column(names[1]), b.column(names[2]), strict=True):
                        text = text.as_py()
                        x = hashes.of(words(text.encode() if isinstance(text, str) else text))
                        hit, got = found.scan(x)
                        n_words.append(len(x))
                        spans.append(merged(s.as_py(), hit))
                        items.append(sorted({*old.as_py(), *got}))
                    cols = [*b.columns[:-3], pa.array(n_words, pa.int64()), pa.array(spans, b.column(names[1]).type), pa.array(items, b.column(names[2]).type)]
                    yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

        return run

    any_block = False
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        any_block = True
        out = out.mapInArrow(scan_with(spark.sparkContext.broadcast(Windows(block, window)), schema.fieldNames().index(text_col)), schema)
    if not any_block:
        out = out.mapInArrow(scan_with(spark.sparkContext.broadcast(Windows([], window)), schema.fieldNames().index(text_col)), schema)
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (word ranges) and what stands between them."""
    if not spans:
        return text
    raw = text.encode()
    flat = raw.lower().translate(_WORD)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.frombuffer(flat, np.uint8) != 32).view(np.int8), [0]])))
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at : edges[2 * a]])
        at = edges[2 * b - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (``remove='documents'``) or without the hit words (``'spans'``); all columns as they were, whatever their names.

    Rows with null or empty texts stay; repeated rows stay repeated; no rows: no rows.
    """
    names = ("_words", "_spans", "_items")
    while set(names) & set(docs.columns):
        names = tuple(f"_{n}" for n in names)
    found = hits(docs, benchmark, text_col=text_col, names=names, **options)
    if remove == "documents":
        return found.where(F.size(names[1]) == 0).select(docs.columns)
    at, spans_at = found.columns.index(text_col), found.columns.index(names[1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut_spans(t.as_py(), [(x["start"], x["stop"]) for x in s.as_py()]) if len(s) else t.as_py() for t, s in zip(b.column(at), b.column(spans_at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, b.column(at).type), *b.columns[at + 1 :]], schema=b.schema)

    return found.mapInArrow(cut, found.schema).select(docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def digest(items: list[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
