"""Regions of pages as pictures: geometry as column expressions, pictures by an injected page drawer, each file opened once a document."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RasterOptions:
    """Points are scaled to ``dpi``; ``max_width`` and ``min_height`` None: neither shrunk nor padded (pictures for descriptions)."""

    dpi: int = 150
    max_width: int | None = 600
    min_height: int | None = 32


AS_DRAWN = RasterOptions(max_width=None, min_height=None)


class Document(Protocol):
    """An opened file: ``draw`` gives a page's region as (height, width, 3) bytes at a zoom; ``close`` if it has one."""

    def draw(self, page: int, bbox: list[float], zoom: float) -> np.ndarray: ...


def geometry(bbox: Column, options: RasterOptions = RasterOptions()) -> Column:
    """Struct of left, top (pixels on the page), drawn_width, drawn_height, width, height (after shrinking and padding) and pad_top of a region.

    A region is drawn from the pixel its left upper corner falls into to that its right lower corner ends in.
    """
    zoom = options.dpi / 72
    x0, y0, x1, y1 = (F.get(bbox, i) * F.lit(zoom) for i in range(4))
    left, top = F.floor(x0 + 1e-3).cast("int"), F.floor(y0 + 1e-3).cast("int")
    wide, high = F.ceil(x1 - 1e-3).cast("int") - left, F.ceil(y1 - 1e-3).cast("int") - top
    width, height = wide, high
    if options.max_width:
        too_wide = wide > options.max_width
        height = F.when(too_wide, F.floor(high.cast("double") * (F.lit(float(options.max_width)) / wide.cast("double"))).cast("int")).otherwise(high)
        width = F.least(wide, F.lit(options.max_width))
    pad, final = F.lit(0), height
    if options.min_height:
        pad = F.when(height < options.min_height, F.floor((F.lit(options.min_height) - height) / 2).cast("int")).otherwise(0)
        final = F.greatest(height, F.lit(options.min_height))
    return F.struct(left.alias("left"), top.alias("top"), wide.alias("drawn_width"), high.alias("drawn_height"), width.alias("width"), final.alias("height"), pad.alias("pad_top"))


def finished(pixels: np.ndarray, options: RasterOptions) -> np.ndarray:
    """Shrunk to the width limit (means over areas) and padded with white to the least height."""
    high, wide = pixels.shape[:2]
    if options.max_width and wide > options.max_width:
        pixels = _shrunk(pixels, int(high * (options.max_width / wide)), options.max_width)
    if options.min_height and pixels.shape[0] < options.min_height:
        out = np.full((options.min_height, pixels.shape[1], 3), 255, np.uint8)
        top = (options.min_height - pixels.shape[0]) // 2
        out[top : top + pixels.shape[0]] = pixels
        pixels = out
    return pixels


def _shrunk(pixels: np.ndarray, high: int, wide: int) -> np.ndarray:
    for axis, n in ((0, max(high, 1)), (1, wide)):
        size = pixels.shape[axis]
        edges = np.linspace(0, size, n + 1)
        sums = np.concatenate([np.zeros_like(np.take(pixels, [0], axis), float), np.cumsum(pixels, axis, float)], axis)
        low = np.floor(edges).astype(int)
        part = np.take(sums, np.minimum(low + 1, size), axis) - np.take(sums, low, axis)
        shape = [1, 1, 1]
        shape[axis] = n + 1
        at = np.take(sums, low, axis) + part * (edges - low).reshape(shape)
        pixels = np.diff(at, axis=axis) / (size / n)
    return np.clip(np.round(pixels), 0, 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """(height, width, 3) bytes as a PNG file."""
    high, wide = pixels.shape[:2]
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(pixels, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def page_regions(chunks: DataFrame) -> DataFrame:
    """One row a document: doc_id, regions (array of (seq, page, bbox)): what a document's file is opened for, and no more."""
    at = F.struct("seq", F.col("page").try_cast("int").alias("page"), "bbox")
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(at), lambda a, b: a["seq"] - b["seq"]).alias("regions"))


def with_rasters(chunks: DataFrame, files: DataFrame, open_file: Callable[[bytes], Document], options: RasterOptions = RasterOptions()) -> DataFrame:
    """Adds ``image`` (PNG; null if it could not be drawn) to chunks with ``seq``, ``page`` and ``bbox``. ``files``: doc_id, content (one row a document).

    A document's regions are gathered and meet its file once: file bytes are not copied to every chunk, and a worker opens each file once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content, regions in zip(batch["doc_id"], batch["content"], batch["regions"], strict=True):
                out, file = [], None
                try:
                    file = open_file(bytes(content))
                except Exception:  # an unreadable file fails its own chunks alone
                    pass
                for r in regions:
                    try:
                        got = png(finished(file.draw(int(r["page"]), list(r["bbox"]), options.dpi / 72), options))
                    except Exception:  # so does a region that cannot be drawn
                        got = None
                    out.append((doc, int(r["seq"]), got))
                getattr(file, "close", lambda: None)()
                yield pd.DataFrame(out, columns=["doc_id", "_seq", "image"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    wanted = page_regions(chunks.where("bbox is not null and page is not null")).join(files.select("doc_id", "content"), "doc_id")
    drawn = wanted.select("doc_id", "content", "regions").mapInPandas(run, f"doc_id {kind}, _seq int, image binary")
    same = (chunks["doc_id"] == drawn["doc_id"]) & (chunks["seq"] == drawn["_seq"])
    return chunks.join(drawn, same, "left").select(*(chunks[c] for c in chunks.columns), "image")


def image_name(doc: Column, chunk_id: Column, described: bool = False, ident: Column | None = None) -> Column:
    """File name of a region's picture: of a repaired text, of a described image, or under a record's id."""
    return F.concat(ident, F.lit(".png")) if ident is not None else F.concat(F.lit("chunk"), chunk_id, F.lit("_"), doc.cast("string"), F.lit("_image.png" if described else ".png"))
