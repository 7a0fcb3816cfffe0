"""Whole plans: blocks to chunks to annotated chunks to parents to records, and their statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.lexicon import STRICT, Lexicon
from folioflow.operators import models
from folioflow.operators.blocks import parse_blocks, parse_stats
from folioflow.operators.grouping import parent_chunks, with_parent_group
from folioflow.operators.labels import with_content_label
from folioflow.operators.refs import with_links
from folioflow.operators.sections import with_section_path
from folioflow.logs import timed
from folioflow.operators.storage import storage_records, vector_documents
from folioflow.sources.files import STAGE_SUFFIX, ensure_collection, read_parents, unpacked_parents, upserted, write_stage


@dataclass(frozen=True)
class PlanOptions:
    """Which stages run, and what they run with."""

    lexicon: Lexicon = STRICT
    fix_encoding: bool = True
    strict_links: bool = False
    text_model: Callable | None = None
    image_model: Callable | None = None
    model: models.ModelOptions = models.ModelOptions()


@dataclass(frozen=True)
class StorageOptions:
    """The storage stage: where it reads, what it embeds with, where and how it writes."""

    input_dir: str | None = None
    suffix: str = STAGE_SUFFIX["chunks"]
    dense_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    sparse_model: str = "bm25"
    dense_size: int = 384
    batch: int = 100
    target: str = "chunks"
    dense_name: str = "dense"
    sparse_name: str = "sparse"
    images_dir: str | None = None
    save_intermediate: bool = True
    recreate: bool = False
    strict_links: bool = False


@dataclass(frozen=True)
class Plan:
    """Lazy tables of one run; nothing is computed before one is read. A stage that is off passes its input on."""

    parsed: DataFrame
    repaired: DataFrame | None
    described: DataFrame | None
    annotated: DataFrame
    grouped: DataFrame
    parents: DataFrame
    records: DataFrame
    documents: DataFrame
    stats: DataFrame


def annotate(chunks: DataFrame, lex: Lexicon = STRICT) -> DataFrame:
    """Section paths first (headers that are none become text), then labels, then links to all of the document's labels."""
    return with_links(with_content_label(with_section_path(chunks), lex), lex)


def plan(blocks: DataFrame, options: PlanOptions = PlanOptions()) -> Plan:
    parsed = parse_blocks(blocks, options.lexicon, fix_encoding=options.fix_encoding)
    repaired = models.repair_texts(parsed, options.text_model, options.model) if options.text_model else None
    described = models.describe_images(repaired if repaired is not None else parsed, options.image_model, options.model) if options.image_model else None
    chunks = next(x for x in (described, repaired, parsed) if x is not None)
    annotated = annotate(chunks.select(parsed.columns), options.lexicon)
    grouped = with_parent_group(annotated, options.lexicon)
    records = storage_records(grouped, strict_links=options.strict_links)
    return Plan(parsed, repaired, described, annotated, grouped, parent_chunks(grouped), records, vector_documents(records), stats(blocks, parsed, repaired, described))


def stats(blocks: DataFrame, parsed: DataFrame, repaired: DataFrame | None = None, described: DataFrame | None = None) -> DataFrame:
    """One row a document over all stages; a stage that did not run counts zero and is ``not done``."""
    out = parse_stats(blocks, parsed).withColumns({"marker_status": F.lit("done"), "text_status": F.lit("done" if repaired is not None else "not done"), "image_status": F.lit("done" if described is not None else "not done")})
    parts = {("total_chunks_checked", "total_corrected", "total_failed"): repaired is not None and models.text_stats(repaired), ("total_images", "described_images", "failed_images"): described is not None and models.image_stats(described)}
    for names, part in parts.items():
        out = out.join(part.select("doc_id", *names), "doc_id", "left") if part else out.withColumns({n: F.lit(None).cast("long") for n in names})
        out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    return out


def run(blocks: DataFrame, folder: str, options: PlanOptions = PlanOptions()) -> DataFrame:
    """Runs the stages, each written under ``folder`` and read by the next; the statistics, with the seconds of each stage, which is returned."""
    spark, seconds = blocks.sparkSession, {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        with timed(seconds, name):
            write_stage(df, f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    parsed = keep(parse_blocks(blocks, options.lexicon, fix_encoding=options.fix_encoding), "layout")
    repaired = keep(models.repair_texts(parsed, options.text_model, options.model), "text") if options.text_model else None
    described = keep(models.describe_images(repaired.select(parsed.columns) if repaired is not None else parsed, options.image_model, options.model), "image") if options.image_model else None
    chunks = next(x for x in (described, repaired, parsed) if x is not None)
    annotated = keep(annotate(chunks.select(parsed.columns), options.lexicon), "annotated")
    grouped = keep(with_parent_group(annotated, options.lexicon), "grouped")
    keep(parent_chunks(grouped), "chunks")
    keep(storage_records(grouped, strict_links=options.strict_links), "storage")
    taken = {f"{k}_seconds": F.lit(float(v)) for k, v in seconds.items()}
    return stats(blocks, parsed, repaired, described).withColumns(taken)


def store(spark: SparkSession, options: StorageOptions, parents: DataFrame | None = None) -> DataFrame:
    """The storage stage alone: nested parents (given, or read from ``input_dir``) to records, upserted into the table ``target``. Returns one row a document: total_chunks."""
    nested = parents if parents is not None else read_parents(spark, f"{options.input_dir}/*{options.suffix}", options.suffix)
    records = storage_records(unpacked_parents(nested), strict_links=options.strict_links)
    ensure_collection(spark, f"{options.target}/current", records.schema, options.recreate)
    merged = upserted(spark.read.schema(records.schema).parquet(f"{options.target}/current"), records)
    merged.write.mode("overwrite").parquet(f"{options.target}/next")
    spark.read.schema(records.schema).parquet(f"{options.target}/next").write.mode("overwrite").parquet(f"{options.target}/current")
    return records.groupBy("file_name").agg(F.count(F.lit(1)).alias("total_chunks"))
