"""WARC archives: written by Spark's own file writer, read back through a Python data source.

The reader plans one partition per archive file, takes filters on record headers, reads a record's header first and
jumps over the payload of records that no filter or option asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .common import Workspace

SCHEMA = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to long, payload_length long, payload_digest string, payload binary"
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page-ID", "payload_length": "X-Payload-Length", "payload_digest": "WARC-Payload-Digest"}
_LONGS = {"page_id", "refers_to", "payload_length"}
REVISIT_BYTES = 1000


def _open(path: str):
    """A seekable stream: the local file system for plain and file: paths, else the store that the scheme names."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names = schema.fieldNames()
        self.files = [x for x in (options.get("files") or options.get("path") or "").split("\n") if x]
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons on header fields; what it cannot decide from a header goes back to Spark."""
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "set", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            kind, at = kinds.get(type(f)), getattr(f, "attribute", ())
            if kind and len(at) == 1 and at[0] in _HEADERS:
                self.tests.append((at[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(x) for x in self.files]

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            got = row[name]
            if got is None:
                return False
            if not {"eq": lambda: got == value, "in": lambda: got in value, "set": lambda: True, "gt": lambda: got > value, "ge": lambda: got >= value, "lt": lambda: got < value, "le": lambda: got <= value}[kind]():
                return False
        return True

    def read(self, partition: _File) -> Iterator[tuple]:
        with _open(partition.path) as f:
            while True:
                line = f.readline()
                while line in (b"\r\n", b"\n"):
                    line = f.readline()
                if not line:
                    return
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record where one should begin in {partition.path}")
                head = {}
                while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                    name, _, value = line.decode().partition(":")
                    head[name.strip().lower()] = value.strip()
                length = int(head["content-length"])
                row = {k: head.get(h.lower()) for k, h in _HEADERS.items()}
                row |= {k: int(row[k]) for k in _LONGS if row[k] is not None}
                if row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].partition(":")[2] or row["payload_digest"]
                wanted = self._wanted(row)
                row["payload"] = None
                if wanted and self.with_payload and row["record_type"] != "revisit":
                    row["payload"] = f.read(length)
                else:
                    f.seek(length, 1)
                if wanted:
                    yield tuple(row[n] for n in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc_archive")``; options: files (newline-separated paths), payload (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "warc_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(schema, self.options)


def _listed(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return sorted(x.getPath().toString() for x in found if x.isFile() and not x.getPath().getName().startswith(("_", ".")) and x.getLen())


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    files = _listed(spark, path)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("warc_archive").option("files", "\n".join(files)).option("payload", str(payload).lower()).load()


def write_archives(ws: Workspace, pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> str:
    """One record per page in WARC/1.1 files under the shared folder; the path.

    Of records with equal payloads of at least REVISIT_BYTES, the one with the largest page_id (nulls last) is the
    response and the others revisit it; of rows that repeat that page_id, all are responses (and share the record id that the others refer to). Only digests are grouped, and only digests
    that occur again meet the pages: payloads are not shuffled unless those digests are many.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    narrow = ws.keep(rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null"), "repeated")
    rows = rows.join(narrow.select("digest", "kept"), "digest", "left")
    revisit = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    plain = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    urn = lambda c, extra: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", c.cast("string"), extra).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    own = F.when(revisit | F.col("kept").isNull(), F.monotonically_increasing_id().cast("string"))  # records that nothing refers to have an id of their row alone
    record = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"), F.concat_ws("|", "digest", own))), F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), plain)),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat_ws("\r\n", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("kept"), F.col("digest"))), F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("kept").cast("string")))),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
        F.lit(""), F.when(revisit, "").otherwise(F.col("html")),
    )
    path = ws.path("archives")
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives.

    A response's bytes and digest are taken from the payload read; a revisit's stand in its header. Null html is the
    empty payload; a null page_id is written without one; repeated rows each have a record. No rows: no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    back = read_archives(spark, write_archives(ws, pages))
    response = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


def digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()
