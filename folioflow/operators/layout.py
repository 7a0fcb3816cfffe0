"""Documents to layout blocks: files are read whole by Spark and handed to an injected layout model, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import stem

BLOCKS = "doc_id string, seq int, block_path string, block_type string, page string, bbox array<double>, html string, error string"
_NAMES = ["doc_id", "seq", "block_path", "block_type", "page", "bbox", "html", "error"]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string()]
#: Blocks of a batch: one batch a document costs more than the documents themselves.
_ROWS = 2048


@dataclass(frozen=True)
class LayoutOptions:
    """What a layout model is asked for; ``extra`` goes to it as it is."""

    force_ocr: bool = True
    image_layer: bool = True
    high_resolution: bool = True
    extra: tuple[tuple[str, str], ...] = ()


class LayoutModel(Protocol):
    """One document's bytes to its blocks in reading order: (block_path, block_type, bbox, html); ``close`` if it has one frees what it holds."""

    def blocks(self, content: bytes, name: str) -> Iterator[tuple[str, str, list[float], str]]: ...


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of all files under ``path`` whose names match; doc_id is the name without its ending."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(stem(F.col("path")).alias("doc_id"), "content")


def scan_layout(documents: DataFrame, make: Callable[[LayoutOptions], LayoutModel], options: LayoutOptions = LayoutOptions()) -> DataFrame:
    """Blocks of (doc_id, content): what ``parse_blocks`` takes after ``with_text``.

    Each Python worker makes its model once a task and closes it at the end. The page is the third part of the block's path. A document
    that the model cannot read gives one row with ``seq`` null and the error, and does not stop the others.
    """

    def blocks_of(model: LayoutModel, doc: str, content: bytes | None) -> list[tuple]:
        try:
            return [(doc, i, path, kind, path.split("/")[2], list(map(float, bbox)), html, None) for i, (path, kind, bbox, html) in enumerate(model.blocks(bytes(content), doc))]
        except Exception as e:  # one unreadable document
            return [(doc, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = make(options), []
        try:
            for batch in batches:
                for doc, content in zip(*batch.columns, strict=True):
                    held += blocks_of(model, doc.as_py(), content.as_py())
                    for at in range(0, len(held) - _ROWS + 1, _ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held[at : at + _ROWS], strict=True), _TYPES, strict=True)], names=_NAMES)
                    held = held[len(held) // _ROWS * _ROWS :]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)
        finally:
            getattr(model, "close", lambda: None)()

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, BLOCKS)
