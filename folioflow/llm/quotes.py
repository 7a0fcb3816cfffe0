"""Chat formatting: quoted passages are parsed by nesting level, linked to the messages they come from, and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

_MARKS = "^[ \\t]*((?:>[ \\t]?)+)"
TURN_BLOCK = 1024


def with_lines(messages: DataFrame) -> DataFrame:
    """One row per line: conv_id, turn, at (0-based), level (number of leading '>'), words (the line without the marks in normal form, or null if blank)."""
    lines = messages.select("conv_id", "turn", "_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r\\n|\\n|\\r")).alias("at", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 1)
    lines = lines.withColumns({"level": F.length(F.regexp_replace(marks, "[^>]", "")), "line": F.regexp_replace("raw", _MARKS, "")})
    norm = normal(F.col("line"))
    return lines.select("conv_id", "turn", "_row", "at", "level", F.when(norm != "", norm).alias("words"))


def normal(text):
    return F.btrim(F.regexp_replace(F.lower(text), "(?U)\\s+", " "))


def _wanted(units: DataFrame, text: str) -> DataFrame:
    """Adds n (words), w and start (number and hash of the first words that are looked up) and passage (hash of all)."""
    units = units.withColumns({"_w": F.split(text, " "), "passage": F.xxhash64(F.col(text))}).withColumn("passage", F.when(F.col(text).isNotNull(), F.col("passage")))
    n = F.size("_w")
    units = units.withColumns({"n": n, "w": F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)})
    return units.withColumn("start", F.xxhash64(F.array_join(F.slice("_w", F.lit(1), F.col("w")), " "))).drop("_w", text)


def passages(quoted: DataFrame) -> DataFrame:
    """Two rows per quoted line: the passage it stands in (adjacent lines of one level, line ends as spaces; whole) and the line alone."""
    run = F.col("at") - F.row_number().over(Window.partitionBy("conv_id", "turn", "_row", "level").orderBy("at"))
    whole = quoted.withColumn("_run", run).groupBy("conv_id", "turn", "_row", "level", "_run").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("_lines"))
    text = F.array_join(F.col("_lines.words"), " ")
    whole = whole.select("conv_id", "turn", "_row", "level", "_lines", F.lit(True).alias("whole"), F.when(text != "", text).alias("_text"))
    one = quoted.select("conv_id", "turn", "_row", "level", "at", "words", F.lit(False).alias("whole"), F.col("words").alias("_text"))
    cols = ["conv_id", "turn", "_row", "level", "at", "words", "whole", "n", "w", "start", "passage"]
    whole = _wanted(whole, "_text").withColumn("_line", F.explode("_lines")).withColumns({"at": F.col("_line.at"), "words": F.col("_line.words")})
    return whole.select(cols).union(_wanted(one, "_text").select(cols))


def holders(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, passage, turn) of the messages whose own words hold a wanted passage in a row."""
    own = normal(F.regexp_replace("text", "(?m)^[ \\t]*>[^\\r\\n]*(?:\\r\\n|\\n|\\r|\\z)", " "))
    own = source.where("turn is not null").join(wanted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "_row", F.split(own, " ").alias("_own"))

    def starts(w: int):
        at = F.sequence(F.lit(1), F.greatest(F.size("_own") - w + 1, F.lit(1)))
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(w).alias("w"), F.xxhash64(F.array_join(F.slice("_own", i, F.lit(w)), " ")).alias("start")))

    hits = own.select("conv_id", "turn", "_row", F.explode(F.flatten(F.array(*map(starts, (1, 2, 4, 8))))).alias("s")).select("conv_id", "turn", "_row", "s.*").join(wanted, ["conv_id", "w", "start"])
    hits = hits.groupBy("conv_id", "turn", "_row").agg(F.collect_set(F.struct("i", "n", "passage")).alias("_hits"))
    found = F.filter("_hits", lambda h: F.xxhash64(F.array_join(F.slice(F.col("_own"), h["i"], h["n"]), " ")) == h["passage"])
    return own.join(hits, ["conv_id", "turn", "_row"]).select("conv_id", F.explode(F.array_distinct(F.transform(found, lambda h: h["passage"]))).alias("passage"), "turn").distinct()


def latest_before(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(conv_id, passage, turn) -> from_turn, the last smaller turn that holds the passage; by blocks of turns as in ``turn_order``."""
    rows = asked.withColumn("_h", F.lit(None).cast(asked.schema["turn"].dataType)).union(held.withColumn("_h", F.col("turn")))
    rows = rows.groupBy("conv_id", "passage", "turn").agg(F.max("_h").alias("_h")).withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "passage", "_block").agg(F.max("_h").alias("_h"))
    blocks = blocks.select("conv_id", "passage", "_block", F.max("_h").over(before(Window.partitionBy("conv_id", "passage").orderBy("_block"))).alias("_prev"))
    rows = rows.withColumn("_in", F.max("_h").over(before(Window.partitionBy("conv_id", "passage", "_block").orderBy("turn"))))
    return rows.join(blocks, ["conv_id", "passage", "_block"]).select("conv_id", "passage", "turn", F.coalesce("_in", "_prev").alias("from_turn"))


def turn_order(messages: DataFrame) -> DataFrame:
    """(conv_id, turn) -> position (messages of the conversation with a smaller turn) and prev_turn.

    Counts per turn are combined map-side. Running sums go by blocks of turns and then over blocks, so a conversation
    that holds a third of all messages is not one window's work.
    """
    per_turn = messages.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))
    blocks = per_turn.groupBy("conv_id", "_block").agg(F.sum("n").alias("_n"), F.max("turn").alias("_last"))
    over = Window.partitionBy("conv_id").orderBy("_block")
    blocks = blocks.select("conv_id", "_block", (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.lag("_last").over(over).alias("_prev"))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn")
    rows = per_turn.withColumns({"_in": F.sum("n").over(inside) - F.col("n"), "_lag": F.lag("turn").over(inside)})
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a._block").eqNullSafe(F.col("b._block"))
    rows = rows.alias("a").join(blocks.alias("b"), same)
    return rows.select("a.conv_id", "a.turn", (F.col("_in") + F.col("_before")).alias("position"), F.coalesce("_lag", "_prev").alias("prev_turn"))


def conversations_without_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (quotes removed), position, parent_turn, n_quoted, n_linked, depth for every message.

    A quoted passage (adjacent lines of one level, line ends as spaces) is hashed in normal form and joined to the latest
    preceding message of its conversation that holds its words in a row, unquoted; so is each of its lines alone, for
    passages that no message holds as a whole. parent_turn is the latest original among the least nested quoted passages
    that found one (lines only if no passage did), else the turn before. Parents have smaller turns, so the order by
    position is one that the parent links allow: a conversation in reply order is its rows by position: every message
    stands after its parent, and equal turns share a position. n_quoted counts quoted lines, n_linked those that found
    their original; depth is the deepest nesting. Attribution lines right above a quote go with it.

    Null texts count as empty and give empty text; a null conv_id or turn is a value of its own (null sorts first) and
    links no quotes; repeated rows stay repeated. Other columns are ignored. Quotes and originals of one passage meet in
    a running maximum over turns, so very common passages make no pairs.
    """
    spark = messages.sparkSession
    ws = Workspace(spark, "quotes")
    source = messages.select("conv_id", "turn", "role", "text").withColumn("_row", F.xxhash64("role", "text"))
    quoting = F.coalesce(F.col("text").rlike("(?m)^[ \\t]*>"), F.lit(False))
    lines = with_lines(source.where(quoting).distinct())
    units = ws.keep(passages(lines.where("level > 0")), "quoted")
    asked = units.where("passage is not null and conv_id is not null and turn is not null")
    held = holders(source, asked.select("conv_id", "w", "start", "n", "passage").distinct())
    latest = latest_before(asked.select("conv_id", "passage", "turn").distinct(), held)
    linked = units.join(latest, ["conv_id", "passage", "turn"], "left")
    found = F.col("from_turn").isNotNull()
    link = linked.groupBy("conv_id", "turn", "_row").agg(
        F.max(F.when(found, F.struct((-F.col("level")).alias("l"), "whole", "from_turn"))).alias("best"),
        F.countDistinct("at").alias("n_quoted"), F.countDistinct(F.when(found & F.col("words").isNotNull(), F.col("at"))).alias("n_linked"), F.max("level").alias("depth"),
    )
    order = turn_order(source)
    same = F.col("m.conv_id").eqNullSafe(F.col("o.conv_id")) & F.col("m.turn").eqNullSafe(F.col("o.turn"))
    quote = F.col("m.conv_id").eqNullSafe(F.col("q.conv_id")) & F.col("m.turn").eqNullSafe(F.col("q.turn")) & (F.col("m._row") == F.col("q._row"))
    rows = source.alias("m").join(order.alias("o"), same).join(link.alias("q"), quote, "left")
    return rows.select(
        "m.conv_id", "m.turn", "m.role", without_quotes(F.col("m.text")).alias("text"), "o.position",
        F.coalesce("q.best.from_turn", "o.prev_turn").alias("parent_turn"), F.coalesce("q.n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("q.n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("q.depth", F.lit(0)).alias("depth"),
    )


def without_quotes(text):
    """The text's unquoted lines, without attribution lines that stand right above a quote; outer white space goes only where a quote was cut."""
    whole = F.coalesce(text, F.lit(""))
    cut = F.regexp_replace(whole, "(?im)^[^\\r\\n]*\\b(?:wrote|writes|schrieb|a écrit|escribió)[ \\t]*:[ \\t]*(?:\\r\\n|\\n|\\r)(?=[ \\t]*>)", "")
    cut = F.regexp_replace(cut, "(?m)^[ \\t]*>[^\\r\\n]*(?:\\r\\n|\\n|\\r|\\z)", "")
    return F.when(whole.rlike("(?m)^[ \\t]*>"), F.btrim(cut, F.lit(" \t\r\n"))).otherwise(whole)
