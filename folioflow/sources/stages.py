"""Stage tables between parts of a plan: written once to the folder that all executors share, then read by column."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode alone a temporary folder where that is unset."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_stage_folder", None)
    if own is None:
        own = spark.sparkContext._stage_folder = "file://" + tempfile.mkdtemp(prefix="stages-")
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: what reads it several times, in several shapes, computes it once, and a lost executor costs a task.

    ``drop_stages`` removes the folders.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGES: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def drop_stages(spark: SparkSession) -> int:
    """Removes the folders of all stage tables of a session, once their readers are done; how many."""
    paths = _STAGES.pop(spark, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
