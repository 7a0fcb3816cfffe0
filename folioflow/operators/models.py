"""Outside models behind interfaces: text repair and image description, with prompts, parameters and retries per chunk.

A model is made by a picklable factory, which gets the options (name, temperature, ..) and the prompt; every Python worker
makes its own once a task, feeds it whole Arrow batches of the rows that need work, and closes it. Chunks do not depend
on each other, so the rounds over remaining chunks of a sequential program become tries per row.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import answers, latex
from folioflow.functions import text as T
from folioflow.lexicon import IMAGE_BLOCKS, IMAGE_TYPES

from .blocks import reading_order

#: What the models are told. {format} is the form of the answer, {caption} and {context} are the chunk's.
TEXT_PROMPT = (
    "Перед тобой фрагмент страницы учебника. Перепиши его без изменений: те же слова, тот же порядок. Русские буквы оставь русскими, даже если они набраны курсивом. "
    "Формулы и отдельные символы записывай в LaTeX, скобки — того же вида, что на изображении. Ответ: {format}"
)
IMAGE_PROMPT = (
    "Перед тобой рисунок из учебника. Опиши его по-русски в нескольких предложениях: что это за рисунок, из чего он состоит, что на нём выделено и зачем он нужен. "
    "Формулы записывай в LaTeX. Подпись: {caption}. Текст рядом: {context}. Ответ: {format}"
)
TEXT_FORMAT = '{"text": "..."}'
IMAGE_FORMAT = '{"description": "...", "image_type": "...", "key_elements": ["..."]}'


@dataclass(frozen=True)
class ModelOptions:
    """Handed to the factory as they are; ``tries`` in each of ``rounds`` bound the calls for one chunk."""

    name: str = "vision-model"
    temperature: float = 0.0
    repeat_penalty: float = 1.5
    max_tokens: int = 10_000
    keep_alive: str = "60m"
    tries: int = 3
    rounds: int = 3
    prompt: str | None = None


#: one chunk's inputs -> the model's raw answer
AskText = Callable[[str, bytes | None], str]
AskImage = Callable[[str, str, bytes | None], str]


def text_prompt(options: ModelOptions = ModelOptions()) -> str:
    return (options.prompt or TEXT_PROMPT).replace("{format}", TEXT_FORMAT)


def image_prompt(caption: Column, context: Column, options: ModelOptions = ModelOptions()) -> Column:
    """The prompt for one image, as it is sent."""
    out: Column = F.lit((options.prompt or IMAGE_PROMPT).replace("{format}", IMAGE_FORMAT))
    for name, value in (("{caption}", caption), ("{context}", context)):
        out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    return out


def made(factory: Callable, options: ModelOptions, prompt: str):
    """A factory's model: factories take (options, prompt), (options) or nothing."""
    n = len([p for p in inspect.signature(factory).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty])
    return factory(*(options, prompt)[:n])


def parameters(options: ModelOptions) -> dict:
    """What a factory gets, as plain values."""
    return asdict(options)


def _tried(ask: Callable[[], str], check: Callable[[str], bool], tries: int) -> str | None:
    for _ in range(tries):
        try:
            got = ask()
            if check(got):
                return got
        except Exception:  # an answer that cannot be had or read is asked for again
            continue
    return None


def repair_texts(chunks: DataFrame, make: Callable[[], AskText], options: ModelOptions = ModelOptions()) -> DataFrame:
    """Adds needs_work, fixed_text (null: not needed or failed) and sets text to it. ``chunks`` may carry ``image``."""
    rows = chunks.withColumn("needs_work", F.coalesce(T.needs_text_work(F.col("block_type"), F.col("text")), F.lit(False)))
    image = F.col("image") if "image" in chunks.columns else F.lit(None).cast("binary")

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = made(make, options, text_prompt(options))

        def good(raw):
            got = answers.cleaned(raw)
            return got is not None and latex.formulas_ok(_text(got))

        for text, picture in parts:
            out = [None if t is None else _tried(lambda t=t, p=p: model(t, p), good, options.tries * options.rounds) for t, p in zip(text, picture, strict=True)]
            yield pd.Series([None if x is None else _text(answers.cleaned(x)) for x in out], dtype=object)
        getattr(model, "close", lambda: None)()

    todo = F.when(F.col("needs_work"), F.col("text"))  # null in, null out: rows without work cost no call
    rows = rows.withColumn("fixed_text", ask(todo, image))
    return rows.withColumn("was_text", F.col("text")).withColumn("text", F.coalesce("fixed_text", "text"))


def _text(cleaned: str) -> str:
    return json.loads(cleaned)["text"]


def text_stats(repaired: DataFrame) -> DataFrame:
    """doc_id, total_chunks_checked, total_corrected, total_failed, failed_chunks."""
    work, ok = F.col("needs_work"), F.col("fixed_text").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    failed = F.array_sort(F.collect_list(F.when(work & ~ok, F.col("chunk_id"))))
    return repaired.groupBy("doc_id").agg(count(work).alias("total_chunks_checked"), count(ok & (F.col("fixed_text") != F.col("was_text"))).alias("total_corrected"), count(work & ~ok).alias("total_failed"), failed.alias("failed_chunks"))


def with_image_context(chunks: DataFrame) -> DataFrame:
    """Adds context: the texts before and after the chunk in its document, as they were before any image was described."""
    near = lambda f: F.coalesce(f("text", 1).over(reading_order()), F.lit(""))
    return chunks.withColumn("context", F.concat(F.lit("До изображения:\n"), near(F.lag), F.lit("\nПосле изображения:\n"), near(F.lead)))


def describe_images_in_order(chunks: DataFrame, make: Callable, options: ModelOptions = ModelOptions()) -> DataFrame:
    """As ``describe_images``, but an image that directly follows a described one sees its new text as context.

    The context of the n-th image of a row of adjacent images depends on the answer for the one before it, so a row of images is read in order. Only images
    go to Python, with the texts beside them, in the order of their documents; the window keeps the rows of a document in one partition.
    """
    names = chunks.columns
    need = F.coalesce(F.col("block_type").isin(*IMAGE_BLOCKS), F.lit(False))
    near = lambda f: F.coalesce(f("text", 1).over(reading_order()), F.lit(""))
    follows = F.coalesce(F.lag(need, 1).over(reading_order()), F.lit(False))
    beside = chunks.withColumns({"_need": need, "_before": near(F.lag), "_after": near(F.lead), "_follows": follows})
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made(make, options, (options.prompt or IMAGE_PROMPT).replace("{format}", IMAGE_FORMAT))

        def good(raw):
            got = json.loads(answers.cleaned(raw) or "{}")
            return 50 <= len(got.get("description", "")) <= 1200 and got.get("image_type") in IMAGE_TYPES and latex.formulas_ok(got["description"])

        last = None  # the text of the image before, as it is now
        for batch in batches:
            texts, done = [], []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("text", "_before", "_after", "_follows")]
            pictures = batch.column(batch.schema.get_field_index("image")) if "image" in names else [None] * batch.num_rows
            for (text, before, after, follows), picture in zip(zip(*(c.to_pylist() for c in columns), strict=True), pictures, strict=True):
                context = "До изображения:\n" + (last if follows else before) + "\nПосле изображения:\n" + after
                image = picture if picture is None else picture.as_py()
                raw = _tried(lambda t=text or "", c=context, p=image: model(t, c, p), good, options.tries * options.rounds)
                if raw is not None:
                    got = json.loads(answers.cleaned(raw))
                    tail = f". Ключевые слова: {', '.join(got['key_elements'])}" if got["key_elements"] else ""
                    texts.append(f"![{got['image_type']}][{text or ''}]({got['description']}{tail})")
                else:
                    texts.append(text)
                done.append(raw is not None)
                last = texts[-1] or ""
            kept = [pa.array(texts, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(done)], names=[*names, "described"])
        getattr(model, "close", lambda: None)()

    images = beside.where("_need").drop("_need").sortWithinPartitions("doc_id", "seq").mapInArrow(run, f"{ddl}, described boolean")
    others = chunks.where(~need).withColumn("needs_description", F.lit(False)).withColumn("described", F.lit(False))
    return images.select(*names, F.lit(True).alias("needs_description"), "described").union(others)


def describe_images(chunks: DataFrame, make: Callable[[], AskImage], options: ModelOptions = ModelOptions()) -> DataFrame:
    """Adds needs_description, described; the text of a described image becomes caption, type, description and key words."""
    rows = with_image_context(chunks).withColumn("needs_description", T.needs_image_work(F.col("block_type")))
    image = F.col("image") if "image" in chunks.columns else F.lit(None).cast("binary")

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = made(make, options, (options.prompt or IMAGE_PROMPT).replace("{format}", IMAGE_FORMAT))

        def good(raw):
            got = answers.cleaned(raw)
            return got is not None and '"description"' in got and latex.formulas_ok(json.loads(got)["description"])

        for caption, context, picture in parts:
            out = [None if t is None else _tried(lambda t=t, c=c, p=p: model(t, c, p), good, options.tries * options.rounds) for t, c, p in zip(caption, context, picture, strict=True)]
            yield pd.Series([None if x is None else answers.cleaned(x) for x in out], dtype=object)
        getattr(model, "close", lambda: None)()

    got = F.from_json(ask(F.when(F.col("needs_description"), F.coalesce("text", F.lit(""))), F.col("context"), image), "description string, image_type string, key_elements array<string>")
    rows = rows.withColumn("_answer", got)
    good = T.image_answer_ok(F.col("_answer.description"), F.col("_answer.image_type"), F.col("_answer.key_elements"))
    put = T.image_text(F.col("_answer.image_type"), F.col("text"), F.col("_answer.description"), F.col("_answer.key_elements"))
    return rows.withColumn("described", good).withColumn("text", F.when(F.col("described"), put).otherwise(F.col("text"))).drop("_answer")


def image_stats(described: DataFrame) -> DataFrame:
    """doc_id, total_images, described_images, failed_images, failed_chunks."""
    need, ok = F.col("needs_description"), F.col("described")
    return described.groupBy("doc_id").agg(F.count_if(need).alias("total_images"), F.count_if(need & ok).alias("described_images"), F.count_if(need & ~ok).alias("failed_images"), F.array_sort(F.collect_list(F.when(need & ~ok, F.col("chunk_id")))).alias("failed_chunks"))
