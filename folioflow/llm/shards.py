"""Sharding by sampled splitters: size-weighted key sample, quantile boundaries, ranges of keys, overfull ranges cut again."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, small_table, with_range

RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 16
#: A range over this many mean ranges (a sixteenth of a shard) is overfull.
OVERFULL = RANGES_PER_SHARD // 16


def _deal(ranges: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Ranges (id, size, rows) -> shard, the largest first to the emptiest shard."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for i, size, _ in sorted(ranges, key=lambda r: (-r[1], r[0])):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard_by_size(rows: DataFrame, key: str, size: str, row: str, n_shards: int, per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Adds shard and slot (gapless from 0 within the shard) to a written table of narrow rows.

    ``key`` (long, not null) is sampled with a chance in proportion to ``size``; the sample's quantiles bound
    ``n_shards * per_shard`` ranges. Exact sizes of the ranges follow from one aggregation. A range of over OVERFULL mean
    sizes is subdivided by key: each key that alone has half of that many is cut by ``row`` (a number of its own for every row),
    the others go to parts by a hash of the key, so rows of one key stay together unless they are that many. Shards are unions of
    ranges and parts, dealt on the driver from their exact totals, which the parameters bound: a shard's size differs
    from the mean by about one small range (or the largest row).
    """
    spark = rows.sparkSession
    total, n = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    n_ranges = n_shards * per_shard
    chance = F.col(size) * float(n_ranges * SAMPLES_PER_RANGE) / float(max(total, 1))
    drawn = F.pmod(F.xxhash64(row, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30) < chance
    at = F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)])
    quantiles = rows.where(drawn).agg(F.percentile_approx(key, at, F.lit(n_ranges * 8)).alias("q")).first()[0] or []
    ranged = with_range(rows, key, sorted(set(quantiles)), "_range", cells=n_ranges)

    fair = max(1, -(-total // n_ranges))
    most = OVERFULL * fair
    sizes = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum(size)).collect()}
    over = [(r, s) for r, s in sizes.items() if s > most]
    full = small_table(spark, over or [(-1, 1)], "_range int, _size bigint")
    in_full = ranged.join(F.broadcast(full.select("_range")), "_range")
    heavy = [(r[0], r[1], r[2]) for r in in_full.groupBy("_range", key).agg(F.sum(size).alias("s")).where(F.col("s") > most // 2).collect()]  # at most 2 * total / most keys
    rest = dict(over)
    for r, _, s in heavy:
        rest[r] -= s
    parts = small_table(spark, [(r, max(1, -(-2 * s // most))) for r, s in rest.items()] or [(-1, 1)], "_range int, _parts bigint")
    first, used_parts = [], dict.fromkeys(rest, 0)
    for r, s in rest.items():
        used_parts[r] = max(1, -(-2 * s // most))
    for r, k, s in sorted(heavy):
        pieces = -(-2 * s // most)
        first.append((k, used_parts[r], pieces))
        used_parts[r] += pieces
    hot = small_table(spark, first or [(0, 0, 0)], f"{key} bigint, _from bigint, _pieces bigint").where("_pieces > 0")
    cut = ranged.join(F.broadcast(parts), "_range", "left").join(F.broadcast(hot), key, "left")
    by_row, by_key = F.col("_from") + F.pmod(F.xxhash64(row, F.lit("sub")), F.col("_pieces")), F.pmod(F.xxhash64(key, F.lit("sub")), F.col("_parts"))
    cut = cut.withColumn("_sub", F.coalesce(by_row, by_key, F.lit(0)).cast("int")).drop("_parts", "_from", "_pieces")
    totals = sorted((tuple(r[:2]), r[2], r[3]) for r in cut.groupBy("_range", "_sub").agg(F.sum(size), F.count(F.lit(1))).collect())
    shard_of = _deal([(i, s, c) for i, (_, s, c) in enumerate(totals)], n_shards)
    used = [0] * n_shards
    where = []
    for i, ((r, sub), _, c) in enumerate(totals):
        where.append((r, sub, shard_of[i], used[shard_of[i]]))
        used[shard_of[i]] += c
    placed = cut.join(F.broadcast(small_table(spark, where, "_range int, _sub int, shard int, _first bigint")), ["_range", "_sub"])
    w = Window.partitionBy("_range", "_sub").orderBy(key, row)
    return placed.withColumn("slot", F.col("_first") + F.row_number().over(w) - 1).drop("_range", "_sub", "_first")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document, under the law ``bytes``.

    The key is a hash of the text, so equal texts (and repeated rows) lie next to each other and share a shard unless
    they are too many for one. Null and empty texts have size 1; rows with a null id are dealt like others; every row counts, also
    one that repeats another in all columns. Other columns are ignored. Texts are read once; all further steps move narrow rows. No rows: no rows.
    """
    ws = Workspace(docs.sparkSession, "shards")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("_key"), F.monotonically_increasing_id().alias("_row"),
    )
    dealt = shard_by_size(ws.keep(narrow, "rows"), "_key", "size", "_row", n_shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
