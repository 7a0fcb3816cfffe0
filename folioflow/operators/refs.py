"""References between chunks: found in texts, resolved against the labels of the same document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.lexicon import STRICT, Lexicon

from .labels import anchors


def extract_references(labelled: DataFrame, lex: Lexicon = STRICT) -> DataFrame:
    """doc_id, seq, chunk_id, pos, label: every reference but those to the chunk's own label."""
    found = labelled.select("doc_id", "seq", "chunk_id", "content_label", F.posexplode(T.references(F.col("text"), lex)).alias("pos", "label"))
    return found.where(F.col("label") != F.col("content_label")).drop("content_label")


def first_references(refs: DataFrame) -> DataFrame:
    """A reference counts once a chunk, at its first place."""
    return refs.groupBy("doc_id", "seq", "chunk_id", "label").agg(F.min("pos").alias("pos"))


def resolved(refs: DataFrame, found_anchors: DataFrame) -> DataFrame:
    """References whose label has chunks, with those."""
    return first_references(refs).join(found_anchors, ["doc_id", "label"])


def unresolved(refs: DataFrame, found_anchors: DataFrame) -> DataFrame:
    """References whose label no chunk of the document has."""
    return first_references(refs).join(found_anchors.select("doc_id", "label"), ["doc_id", "label"], "left_anti")


def with_links(labelled: DataFrame, lex: Lexicon = STRICT) -> DataFrame:
    """Adds linked_chunks (label -> chunk ids) and unresolved_refs (first occurrence first).

    A row's references are an array of its own; only they, exploded, meet the anchors, and come back as one narrow row a chunk.
    """
    own = F.array_distinct(F.filter(T.references(F.col("text"), lex), lambda x: x != F.col("content_label")))
    asked = labelled.select("doc_id", "seq", F.posexplode(own).alias("pos", "label"))
    met = asked.join(anchors(labelled), ["doc_id", "label"], "left")
    found = met.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "chunk_ids")), lambda a, b: a["pos"] - b["pos"]).alias("_refs"))
    known = F.filter("_refs", lambda x: x["chunk_ids"].isNotNull())
    links = F.map_from_entries(F.transform(known, lambda x: F.struct(x["label"], x["chunk_ids"])))
    missing = F.transform(F.filter("_refs", lambda x: x["chunk_ids"].isNull()), lambda x: x["label"])
    none = F.expr("cast(array() as array<struct<pos:int,label:string,chunk_ids:array<string>>>)")
    rows = labelled.join(found, ["doc_id", "seq"], "left").withColumn("_refs", F.coalesce("_refs", none))
    return rows.withColumns({"linked_chunks": links, "unresolved_refs": missing}).drop("_refs")
