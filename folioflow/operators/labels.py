"""Content labels: which definition, theorem or figure a chunk belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.lexicon import FIGURE_GROUPS, STRICT, Lexicon

from .blocks import reading_order


def with_content_label(chunks: DataFrame, lex: Lexicon = STRICT) -> DataFrame:
    """Adds content_label (empty if none).

    Text that begins with a kind and a number starts a label, which up to ``max_continuation`` following texts inherit,
    until a stop word, a figure or any other block. Every such row is an event; a row's label is that of the last event
    if it was a start and is near enough. Figures carry their own number.
    """
    text, kind = T.strip(F.col("text")), F.col("block_type")
    is_text, is_figure = kind == "Text", kind.isin(*FIGURE_GROUPS)
    number = F.regexp_extract(text, T.label_pattern(lex), 2)
    started = F.when(is_text & (number != ""), F.concat_ws(" ", T.capitalized(F.regexp_extract(text, T.label_pattern(lex), 1)), number))
    figure = F.regexp_extract(text, T.figure_pattern(lex), 1)
    ends = ~is_text | text.rlike(T.stop_pattern(lex))
    rows = chunks.withColumns({"_at": F.row_number().over(reading_order()), "_start": started, "_figure": F.when(is_figure & (figure != ""), F.concat_ws(" ", F.lit(lex.figure_noun), figure))})
    event = F.when(F.col("_start").isNotNull() | ends, F.struct("_at", F.col("_start").alias("label")))
    rows = rows.withColumn("_event", F.last(event, ignorenulls=True).over(reading_order().rowsBetween(Window.unboundedPreceding, 0)))
    inherited = F.when(is_text & (F.col("_at") - F.col("_event._at") <= lex.max_continuation), F.col("_event.label"))
    return rows.withColumn("content_label", F.coalesce("_figure", inherited, F.lit(""))).drop("_at", "_start", "_figure", "_event")


def anchors(labelled: DataFrame) -> DataFrame:
    """doc_id, label, chunk_ids (reading order): all chunks of a label, the same label of several chapters together."""
    found = labelled.where(F.col("content_label") != "").groupBy("doc_id", F.col("content_label").alias("label"))
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
