"""Files in and out: chunk arrays as JSON, stage tables, images, storage tables with upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import base64_text, file_name, stem

CHUNK_FIELDS = "id string, block_type string, page string, bbox array<double>, text string, image_path string"
#: The stages that write a table, in order, with the ending of their files.
STAGE_SUFFIX = {"layout": "_marker_processed_json.txt", "text": "_text_processed_json.txt", "image": "_images_processed_json.txt", "chunks": "_chunk_processed_json.txt", "storage": "_storage_processed_json.txt"}


def read_chunk_json(spark: SparkSession, path: str | Sequence[str], fields: str = CHUNK_FIELDS, suffix: str = "") -> DataFrame:
    """Chunk arrays, one JSON array a file: (doc_id, seq, fields..). doc_id is the file name without ``suffix`` and ending; seq the place in the array.

    The schema is given, so nothing is inferred; a file is read whole by one task, many files in parallel. A file that
    is no JSON array gives one row of nulls with seq null.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{', '.join(':'.join(x.strip().split(' ', 1)) for x in _split_fields(fields))}>>").alias("a"))
    name = F.regexp_replace(file_name(F.col("file")), f"{suffix.replace('.', chr(92) + '.')}$", "") if suffix else stem(F.col("file"))
    return raw.select(F.url_decode(name).alias("doc_id"), F.posexplode_outer("a").alias("seq", "c")).select("doc_id", "seq", "c.*")


def _split_fields(fields: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, cur = [], 0, ""
    for ch in fields:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A stage's table: parquet to read on, or JSON lines to hand out."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_documents_json(df: DataFrame, path: str, order: str = "seq") -> None:
    """One JSON array a document, in reading order, under ``doc_id=..`` folders."""
    fields = [c for c in df.columns if c not in ("doc_id", order)]
    first = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)  # noqa: E731  # maps inside have no order
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, *fields)), first), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    df.groupBy("doc_id").agg(F.to_json(rows).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def resume(spark: SparkSession, root: str, wanted: Sequence[str]) -> DataFrame | None:
    """The table that the first wanted stage goes on from: that of the stage before it. None if that is the first of all."""
    names = list(STAGE_SUFFIX)
    at = names.index(next(n for n in names if n in wanted))
    return spark.read.parquet(f"{root}/{names[at - 1]}") if at else None


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, base64) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", file_name(F.col("path")).alias("file_name"), base64_text(F.col("content")).alias("base64"))


def ensure_collection(spark: SparkSession, path: str, ddl, recreate: bool = False) -> None:
    """An empty table where there is none; ``recreate`` empties one that exists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if recreate or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], ddl).write.mode("overwrite").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new``: a key of ``new`` replaces that of ``old``. One row per key of ``new`` (repeats: one of them)."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: Nested parents as the chunk stage dumps them.
PARENT_FIELDS = (
    "id string, section_path string, chunk_ids array<string>, mini_chunk_count int, content_labels array<string>, linked_chunks map<string,array<string>>, unresolved_refs array<string>, "
    "chunks array<struct<chunk_id:string,block_type:string,page:string,bbox:array<double>,text:string,section_path:string,content_label:string,linked_chunks:map<string,array<string>>,unresolved_refs:array<string>>>"
)


def read_parents(spark: SparkSession, path: str | Sequence[str], suffix: str = "") -> DataFrame:
    """Parent arrays, one JSON array a file: (doc_id, seq, parent fields..)."""
    return read_chunk_json(spark, path, PARENT_FIELDS, suffix)


def unpacked_parents(parents: DataFrame) -> DataFrame:
    """Nested parents (doc_id, id, chunks: array of structs with ``seq`` or in reading order) back to chunks with parent_group: what the storage stage takes."""
    fields = parents.schema["chunks"].dataType.elementType.fieldNames()
    rows = parents.select("doc_id", F.col("id").alias("parent_group"), F.posexplode("chunks").alias("_at", "c"))
    if "seq" in fields:
        return rows.select("doc_id", "parent_group", "c.*")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("parent_group").cast("int"), "_at")) - 1
    return rows.select("doc_id", number.alias("seq"), "parent_group", "c.*")


def delete_images(spark: SparkSession, folder: str, doc: str, described: bool = False) -> tuple[int, list[str]]:
    """Removes a document's region pictures under ``folder``: how many went, and the names of those that could not be removed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    quoted = "".join(f"\\{c}" if c in "*?[]{}\\," else c for c in doc)
    pattern = hadoop.Path(f"{folder}/chunk*_{quoted}{'_image' if described else ''}.png")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    gone, left = 0, []
    for f in fs.globStatus(pattern) or []:
        try:
            gone += bool(fs.delete(f.getPath(), False))
        except Exception:  # one file that cannot be removed does not keep the others
            left.append(f.getPath().getName())
    return gone, left
