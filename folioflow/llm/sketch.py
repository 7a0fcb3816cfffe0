"""Threshold-scaled document fingerprints: every word-shingle hash below a fixed share of the hash range is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import numpy as np

from .common import shuffle_parts, small_table, with_range

SCALE = 4  # one shingle in SCALE is kept
SHINGLE = 5
#: Rows of a range of neighbours, and ranges at most (their bounds are on the driver).
RANGE_ROWS, MAX_RANGES = 16_384, 16_384
#: Keys that are drawn for every bound.
DRAWN = 16


def sketch(text: Column, scale: int = SCALE, n: int = SHINGLE) -> Column:
    """Sorted distinct 32-bit heads of the kept hashes (array<bigint>) over words that white space parts, in lower case (all scripts).

    A shingle is the hash chain of ``n`` word hashes; fewer words make one shingle, none make none. Kept is every hash below
    the fraction 1/scale of the range; a text of which none is, keeps its least hash, so that only texts without words have an
    empty sketch. Lambda variables bind the arrays so that no expression is evaluated once per element.
    """
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of(x: Column) -> Column:
        places = F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(x) - n, F.lit(0))))
        return F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(x, i + k) for k in range(n)]), 32))

    shingles = F.element_at(F.transform(F.array(hashed), of), 1)
    return F.element_at(F.transform(F.array(shingles), lambda h: _below(h, scale)), 1)


def _below(hashes: Column, scale: int) -> Column:
    kept = F.filter(hashes, lambda h: h < F.lit((1 << 32) // scale))
    none = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).otherwise(none)), 1)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s kept hashes that ``b`` has: an estimate of how much of the one text stands in the other. Equal sketches: 1, also empty ones; an empty one and another: 0."""
    return F.when(a == b, F.lit(1.0)).when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def merged(sketches: Column, scale: int = SCALE) -> Column:
    """The sketch of several texts together, from an array of their sketches; least hashes that were kept for want of others go again."""
    return F.element_at(F.transform(F.array(F.flatten(sketches)), lambda h: _below(h, scale)), 1)


def with_next(docs: DataFrame, order: str, last: str, columns: list[str], derived: dict[str, Column]) -> DataFrame:
    """Adds ``derived`` and next_<column> of all ``columns``: the values of the row after this one by descending ``order`` (long, not null).

    Rows with ``last`` come after others of the same ``order``, then a hash of the row decides; after the last row comes the
    first. Rows are dealt into ranges of ``order`` at the quantiles of a sample, of RANGE_ROWS each at most (fewer if there are more shuffle partitions). Each range gets a
    copy of the first row of the range below it, so a window per range sees every neighbour; no window runs over the whole
    table. ``derived`` columns are worked out after the shuffle, once a row.
    """
    spark = docs.sparkSession
    rows = docs.count()
    n = max(16, min(MAX_RANGES, max(2 * shuffle_parts(spark), -(-rows // RANGE_ROWS))))
    share = min(1.0, n * DRAWN / max(rows, 1))
    drawn = docs.where(F.pmod(F.xxhash64(order, F.lit("drawn")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(order).toArrow().column(0).to_numpy()
    bounds = sorted(set(np.quantile(drawn, np.arange(1, n) / n, method="lower").tolist())) if len(drawn) else []
    ranged = with_range(docs, order, bounds, "_range").withColumn("_tie", F.xxhash64(*docs.columns))
    heads = sorted((r[0], r[1]) for r in with_range(docs.select(order), order, bounds, "_range").groupBy("_range").agg(F.max(order)).collect())
    if not heads:
        return ranged.drop("_range", "_tie").withColumns(derived).withColumns({f"next_{c}": F.col(c) for c in columns})
    above = [(heads[(i + 1) % len(heads)][0], v) for i, (_, v) in enumerate(heads)]
    first = Window.partitionBy("_range").orderBy(last, "_tie")
    copies = ranged.join(F.broadcast(small_table(spark, above, f"_to int, {order} bigint")), order).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    copies = copies.withColumns({"_range": F.col("_to"), "_copy": F.lit(1)}).drop("_to", "_n")
    both = ranged.withColumn("_copy", F.lit(0)).unionByName(copies).repartition("_range").withColumns(derived)
    w = Window.partitionBy("_range").orderBy("_copy", F.col(order).desc(), last, "_tie")
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_copy = 0").drop("_range", "_copy", "_tie")


def fingerprint_pairs(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    Null texts count as empty: no shingles, an empty fingerprint. Likeness is the containment of the document's own
    fingerprint in the other and follows from the two fingerprints alone. A null id sorts after all others; rows with equal
    ids sort by a hash, repeated rows are each other's next; all rows of one id lie in one range. A single row is its own
    next. Texts of any length are read whole. Other columns are ignored. No rows: no rows.
    """
    least = docs.agg(F.min(F.col("doc_id").cast("long"))).first()[0]
    after = max((least if least is not None else 0) - 1, -(1 << 63))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(after)).alias("_order"), F.col("doc_id").isNull().alias("_null"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, "_order", "_null", ["text", "_sketch"], {"_sketch": sketch(F.col("text"), scale)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_sketch", "next__sketch").withColumn("_esketch", sketch(F.col("_edited"), scale))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_esketch")).alias("edited_fingerprint"), containment(F.col("_sketch"), F.col("_esketch")).alias("near_edited"),
        containment(F.col("_sketch"), F.col("next__sketch")).alias("near_next"),
    )
