"""Layout blocks derived from plain documents: every line is a block whose type and text follow from its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derived_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, block_path, block_type, page, text) from ``documents``: gives every operator something to act on.

    Null texts have no lines. Line order is kept in ``seq``; nothing is shuffled.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    m, c = F.col("seq") % 20, F.floor(F.col("seq") / 20).cast("int")
    n, dep = (c + 1).cast("string"), 1 + c % 3
    third = F.col("doc_id") % 3 == 0
    kind = (
        F.when(m == 1, "SectionHeader").when(m == 7, "PageFooter").when(m == 8, "Equation").when(m == 12, "FigureGroup")
        .when(m.isin(15, 17) & third, "SectionHeader").otherwise("Text")
    )
    line, cat = F.col("line"), F.concat
    text = (
        F.when(m == 1, cat(n, F.when(dep == 1, " ").when(dep == 2, ".1 ").otherwise(".1.1 "), line))
        .when(m == 2, cat(F.lit("Определение "), n, F.lit(". "), line)).when(m == 5, cat(F.lit("Теорема "), n, F.lit(". "), line))
        .when(m == 9, cat(line, F.lit(" по теореме "), n, F.lit(" и лемме "), (c + 7).cast("string"))).when(m == 10, cat(F.lit("Рассмотрим "), line))
        .when(m == 12, cat(F.lit("рис. "), n, F.lit(" "), line)).when((m == 15) & third, "Упражнения").when((m == 17) & third, cat(F.lit("Задача "), n)).otherwise(line)
    )
    page = F.floor(F.col("seq") / 8).cast("string")
    path = F.concat(F.lit("/page/"), page, F.lit("/"), kind, F.lit("/"), F.col("seq").cast("string"))
    return lines.select("doc_id", "seq", path.alias("block_path"), kind.alias("block_type"), page.alias("page"), text.alias("text"))
