"""New documents as a stream: every file that arrives is processed whole and upserted under stable ids."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.document import PlanOptions, plan
from folioflow.sources.files import upserted

#: Parts of a target table by hash of the id; a batch writes those anew that it has rows for.
BUCKETS = 64


class Manifests:
    """Small files ``target/manifests/<batch>`` that say which folder holds each bucket. The newest one is the table."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.root = spark, f"{target}/manifests"
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self.hadoop.Path(self.root)
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def read(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.root}/{number:012d}", wholetext=True).first()[0])

    def before(self, number: int) -> dict[str, str]:
        older = [n for n in self.numbers() if n < number]
        return self.read(older[-1]) if older else {}

    def publish(self, number: int, buckets: dict[str, str]) -> None:
        """Written under another name and renamed: a reader sees all of it or none."""
        draft = self.hadoop.Path(f"{self.root}/_{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        self.fs.rename(draft, self.hadoop.Path(f"{self.root}/{number:012d}"))

    def forget(self, keep: int = 2) -> None:
        """Removes manifests but the newest ``keep``, and the folders that none of those names."""
        numbers = self.numbers()
        kept = {p.rsplit("/bucket=", 1)[0] for n in numbers[-keep:] for p in self.read(n).values()}
        gone = {p.rsplit("/bucket=", 1)[0] for n in numbers[:-keep] for p in self.read(n).values()} - kept
        for path in [*gone, *(f"{self.root}/{n:012d}" for n in numbers[:-keep])]:
            self.fs.delete(self.hadoop.Path(path), True)


def ingest_blocks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, options: PlanOptions = PlanOptions(), trigger: dict | None = None):
    """Starts a query that turns block files (parquet; a document's blocks in one file) under ``source`` into records under ``target``.

    A micro-batch reads the table as the batches before it left it, by number, writes the buckets its records fall into to a folder
    of its own attempt, and publishes them in one rename. A batch that is repeated after it was published does nothing, one that is
    repeated before leaves an unused folder: no attempt ever writes where another reads.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = Manifests(session, target)
        if number in known.numbers():
            return
        folder = f"{target}/data/{number:012d}-{uuid.uuid4().hex}"
        bucketed = plan(batch, options).records.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
        bucketed.write.parquet(f"{folder}-new")  # the batch's own records, computed once
        fresh = session.read.schema(bucketed.schema).parquet(f"{folder}-new")
        before = known.before(number)
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())
        old = [before[str(b)] for b in touched if str(b) in before]
        merged = fresh
        if old:
            stored = session.read.schema(bucketed.drop("bucket").schema).parquet(*old).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
            merged = upserted(stored, fresh)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        known.publish(number, before | {str(b): f"{folder}/bucket={b}" for b in touched})
        known.fs.delete(known.hadoop.Path(f"{folder}-new"), True)
        known.forget()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_records(spark: SparkSession, target: str) -> DataFrame | None:
    """The table as of the last published batch; None before the first, or if all were empty."""
    known = Manifests(spark, target)
    numbers = known.numbers()
    paths = sorted(known.read(numbers[-1]).values()) if numbers else []
    return spark.read.parquet(*paths) if paths else None
