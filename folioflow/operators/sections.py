"""Section paths: numbered headers form a stack per document, read off with window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.lexicon import HEADER

from .blocks import reading_order

MAX_DEPTH = 10


def with_section_path(chunks: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Adds section_path (titles joined by ``" > "``, else empty); headers without a number become Text.

    A header of depth d takes all deeper or equal ones off the stack. So the header last seen at depth d is on the stack
    exactly if it stands after the last ones of all lesser depths. Headers with more parts than ``max_depth`` count as that
    deep: they replace one another at the end of the path.
    """
    head = (F.col("block_type") == HEADER) & T.is_section(F.col("text"))
    depth = F.when(head, F.size(T.section_key(F.col("text"))))
    depth = F.when(depth > max_depth, max_depth).otherwise(depth)
    w = reading_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumns({"_depth": depth, "_title": F.when(head, T.section_title(F.col("text")))})
    last = {f"_h{d}": F.last(F.when(F.col("_depth") == d, F.struct(F.col("seq").alias("at"), F.col("_title").alias("title"))), ignorenulls=True).over(w) for d in range(1, max_depth + 1)}
    rows = rows.withColumns(last)
    titles, before = [], F.lit(-1)
    for d in range(1, max_depth + 1):
        at = F.coalesce(F.col(f"_h{d}.at"), F.lit(-1))
        titles.append(F.when(at > before, F.col(f"_h{d}.title")))
        before = F.greatest(before, at)
    out = rows.withColumn("section_path", F.array_join(F.array_compact(F.array(*titles)), " > "))
    demoted = F.when((F.col("block_type") == HEADER) & F.col("_depth").isNull(), "Text").otherwise(F.col("block_type"))
    return out.withColumn("block_type", demoted).drop("_depth", "_title", *last)
