"""Layout blocks to chunks: furniture, exercise regions and fragments go, math is delimited, chunks are numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import markup
from folioflow.functions import text as T
from folioflow.lexicon import FURNITURE, HEADER, MATH_BLOCKS, STRICT, Lexicon


def reading_order(doc: str = "doc_id", seq: str = "seq"):
    return Window.partitionBy(doc).orderBy(seq)


def with_text(blocks: DataFrame, html: str = "html") -> DataFrame:
    """Text of rendered blocks: formulas to TeX, markup gone."""
    return blocks.withColumn("text", markup.block_text(F.col(html))).drop(html)


def with_region_state(blocks: DataFrame, lex: Lexicon = STRICT) -> DataFrame:
    """Adds ``opens`` (starts an exercise region) and ``skipped`` (lies in one).

    A region ends at a header that names no exercise. The state machine is one window: each row's signal sets or clears
    the state, the last signal before a row is its state.
    """
    head, text = F.col("block_type") == HEADER, F.col("text")
    item = head & T.strip(text).rlike(rf"(?U)^(?:{'|'.join(lex.exercise_items)})\s*\d+(\.\d+)?")
    titled = F.lit(False)
    for word in lex.exercise_titles:
        titled = titled | text.contains(word)
    opens = F.coalesce(head & titled & (F.char_length(text) <= lex.max_title), F.lit(False))
    signal = F.when(opens, True).when(head & ~item, False)
    state = F.coalesce(F.last(signal, ignorenulls=True).over(reading_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return blocks.withColumns({"opens": opens, "skipped": F.coalesce(state & (~head | item), F.lit(False))})


def parse_blocks(blocks: DataFrame, lex: Lexicon = STRICT, min_length: int = 3, fix_encoding: bool = False) -> DataFrame:
    """Blocks (doc_id, seq, block_type, page, text) -> the chunks that stay, with chunk_id ``page-k``, k counting kept chunks of the document.

    A null text counts as empty. One shuffle by document serves all windows.
    """
    rows = with_region_state(blocks.withColumn("text", F.coalesce("text", F.lit(""))), lex)
    kept = rows.where(~F.col("skipped") & ~F.col("opens") & ~F.col("block_type").isin(*FURNITURE)).drop("skipped", "opens")
    kept = kept.withColumn("text", T.wrap_math(F.col("block_type"), F.col("text"), MATH_BLOCKS)).where(F.char_length("text") > min_length)
    kept = kept.withColumn("chunk_id", F.concat_ws("-", "page", (F.row_number().over(reading_order()) - 1).cast("string")))
    return kept.withColumn("text", markup.repair(F.col("text"))) if fix_encoding else kept


def parse_stats(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, total_pages (of all blocks), total_chunks."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages"))
    kept = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return pages.join(kept, "doc_id", "left").select("doc_id", "total_pages", F.coalesce("total_chunks", F.lit(0)).cast("long").alias("total_chunks"))
