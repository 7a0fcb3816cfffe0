"""Shared storage, small bounded tables and range lookups for the training-data operators.

Every intermediate that is read more than once is written to the folder all executors share
(``spark.checkpoint.dir``), so that a lost executor costs a task, not the lineage.
"""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests, local mode)."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_own_shared_folder", None)
    if own is None:
        own = spark.sparkContext._own_shared_folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return own


class Workspace:
    """Tables written for one operator call. ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        _ROOTS.setdefault(spark, []).append(self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._kept_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of tables that nothing refers to any more; it does so when its driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


_ROOTS: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def clean_up(spark: SparkSession) -> int:
    """Removes what this session's operators have written to the shared folder, once their results are read; how many folders."""
    roots = _ROOTS.pop(spark, [])
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(roots)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Driver rows of a bounded count as a table that the JVM builds (no Python on the executors)."""
    names = [x.strip().split()[0] for x in ddl.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(":".join(x.split()) for x in ddl.split(","))
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{kind}>>'))", args={"rows": text})


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_range(df: DataFrame, key: str, bounds: list[int], out: str, cells: int = 4096) -> DataFrame:
    """Adds the number of ``bounds`` (ascending, bounded count) that are <= ``key`` (a long, not null).

    The span of the bounds is cut into equal cells; a cell knows how many bounds lie below it and which lie inside,
    so a row compares itself with the few bounds of its cell. The cells table holds at most ``cells`` rows and all
    bounds once: its size follows from the parameters, not from the data, hence the broadcast.
    """
    if not bounds:
        return df.withColumn(out, F.lit(0))
    low, high = bounds[0], bounds[-1]
    width = max(1, -(-(high - low + 1) // cells))
    inside: dict[int, list[int]] = {}
    for b in bounds:
        inside.setdefault((b - low) // width, []).append(b)
    rows, below = [], 0
    for c in range((high - low) // width + 1):
        rows.append((c, below, inside.get(c, [])))
        below += len(inside.get(c, ()))
    table = small_table(df.sparkSession, rows, "_cell int, _below int, _inside array<bigint>")
    k = F.col(key)
    shifted = (k.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")
    cell = F.when(k < low, F.lit(-1)).when(k > high, F.lit(len(rows))).otherwise(F.floor(shifted).cast("int"))
    joined = df.withColumn("_cell", cell).join(F.broadcast(table), "_cell", "left")
    found = F.col("_below") + F.size(F.filter("_inside", lambda b: b <= k))
    return joined.withColumn(out, F.when(k < low, F.lit(0)).when(k > high, F.lit(len(bounds))).otherwise(found)).drop("_cell", "_below", "_inside")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n
