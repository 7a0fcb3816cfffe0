"""Parent groups: consecutive chunks of a section, about ``group_size`` each, labels kept together."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.lexicon import HEADER, STRICT, Lexicon


def numbered(rows: Iterable[tuple[object, str | None, str, object]], size: int) -> Iterator[tuple[object, object, int]]:
    """(doc, path, label, place) in reading order -> (doc, place, group): documents number their groups from 0.

    The unit is a run of one label within a section, or one row without a label; units are never split. A group is full
    with ``size`` rows: then the next unit opens another, but a row without a label still joins the run before it.
    """
    number = held = 0
    section: object = None
    alone = itertools.count()
    for (doc, path, label, _), run in itertools.groupby(rows, lambda r: (r[0], r[1], r[2], None if r[2] else next(alone))):
        places = [r[3] for r in run]
        if section is None or section[0] != doc:
            number = held = 0
        elif section[1] != path and held:
            number, held = number + 1, 0
        section = (doc, path)
        if label and held and (held >= size or held + len(places) > size):
            number, held = number + 1, 0
        for place in places:
            yield doc, place, number
        held += len(places)
        if not label and held >= size:
            number, held = number + 1, 0


def with_parent_group(chunks: DataFrame, lex: Lexicon = STRICT) -> DataFrame:
    """Adds parent_group ("0", "1", .. per document) to all chunks but headers, which leave.

    The rule is a fold, which no window expresses. Rows go to their document's partition in reading order, and four
    narrow columns pass through it as a stream: memory holds one run of a label, not a document.
    """
    body = chunks.where(F.col("block_type") != HEADER)
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_type = pa.null()

        def rows():
            nonlocal doc_type
            for b in batches:
                doc_type = b.column(0).type
                for d, s, p, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    yield d, p, (c or "").strip(), s

        placed = numbered(rows(), lex.group_size)
        while part := list(itertools.islice(placed, 4096)):
            docs, seqs, groups = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(seqs, pa.int32()), pa.array([str(g) for g in groups], pa.string())], names=["doc_id", "seq", "parent_group"])

    ordered = body.select("doc_id", F.col("seq").cast("int").alias("seq"), "section_path", "content_label").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    groups = ordered.mapInArrow(run, f"doc_id {kind}, seq int, parent_group string")
    return body.join(groups, ["doc_id", "seq"])


def parent_chunks(grouped: DataFrame) -> DataFrame:
    """One row per group: id, section_path, chunk_ids, mini_chunk_count, content_labels, linked_chunks, unresolved_refs, chunks.

    Labels and unresolved references keep the order of their first appearance; of equal links the last wins; links to
    labels inside the group go.
    """
    fields = [c for c in grouped.columns if c not in ("doc_id", "parent_group", "seq")]
    rows = grouped.groupBy("doc_id", F.col("parent_group").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", *fields)), lambda a, b: a["seq"] - b["seq"]).alias("chunks"))
    labels = F.array_distinct(F.filter(F.transform("chunks", lambda c: c["content_label"]), lambda x: x != ""))
    entries = F.flatten(F.transform("chunks", lambda c: F.map_entries(c["linked_chunks"])))
    outside = F.filter(entries, lambda e: ~F.array_contains(F.col("content_labels"), e["key"]))
    keys = F.array_distinct(F.transform(F.col("_links"), lambda e: e["key"]))
    last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(F.col("_links"), lambda e: e["key"] == k), -1)["value"]))
    rows = rows.withColumn("content_labels", labels).withColumn("_links", outside)
    return rows.select(
        "doc_id", "id", F.get("chunks", 0)["section_path"].alias("section_path"), F.transform("chunks", lambda c: c["chunk_id"]).alias("chunk_ids"),
        F.size("chunks").alias("mini_chunk_count"), "content_labels", last.alias("linked_chunks"),
        F.array_distinct(F.flatten(F.transform("chunks", lambda c: c["unresolved_refs"]))).alias("unresolved_refs"), "chunks",
    )


def chunk_stats(annotated: DataFrame, grouped: DataFrame) -> DataFrame:
    """doc_id, total_chunks, total_parent_chunks, total_final_chunks, unresolved_refs: one aggregation over both, narrow."""
    none = lambda kind: F.lit(None).cast(kind)
    both = annotated.select("doc_id", F.lit(1).alias("c"), none("string").alias("g"), none("int").alias("u")).union(grouped.select("doc_id", none("int"), "parent_group", F.size("unresolved_refs")))
    per = both.groupBy("doc_id").agg(F.count("c").alias("total_chunks"), F.countDistinct("g").alias("total_parent_chunks"), F.count("g").alias("total_final_chunks"), F.coalesce(F.sum("u"), F.lit(0)).alias("unresolved_refs"))
    return per
