"""One query per operator over whole tables. Arrays and maps are rendered as text so that results compare by value."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import answers, latex, markup
from folioflow.functions import text as T
from folioflow.lexicon import INTENDED
from folioflow.operators import blocks, grouping, labels, layout, models, raster, refs, sections, storage
from folioflow.sources.derived import derived_blocks
from folioflow.sources.files import unpacked_parents, upserted
from folioflow.sources.stages import staged

from . import document

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark, sf_dir):
    return derived_blocks(table(spark, sf_dir, "documents"))


def _parsed(spark, sf_dir):
    return blocks.parse_blocks(_blocks(spark, sf_dir))


def _sections(spark, sf_dir):
    return sections.with_section_path(_parsed(spark, sf_dir))


def _labelled(spark, sf_dir):
    return labels.with_content_label(_sections(spark, sf_dir))


def _labelled_stage(spark, sf_dir):
    """For what reads labels more than once: written, as between the stages of a run."""
    return staged(_labelled(spark, sf_dir), "labelled")


def _linked(spark, sf_dir):
    return refs.with_links(_labelled_stage(spark, sf_dir))


def _grouped(spark, sf_dir):
    return staged(grouping.with_parent_group(_linked(spark, sf_dir)), "grouped")


def _join(c: Column | str, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def _render(links: Column | str) -> Column:
    """label=id,id;label=.. by label."""
    e = F.array_sort(F.transform(F.map_entries(links), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ","))))
    return F.array_join(e, ";")


@query
def flagship_paths(spark, sf_dir):
    """Chunks per section path: blocks, filters, numbering and section stack in one plan."""
    return _sections(spark, sf_dir).groupBy("section_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


@query
def src_derived_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query
def prj1_page_from_path(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "seq", T.page_of(F.col("block_path")).alias("page"))


@query
def win1_exercise_region(spark, sf_dir):
    return blocks.with_region_state(_blocks(spark, sf_dir)).select("doc_id", "seq", "opens", "skipped")


@query
def flt_kept_chunks(spark, sf_dir):
    """FLT1 to FLT4, WIN1, PRJ2, PRJ6 together."""
    return _parsed(spark, sf_dir).select("doc_id", "seq", "chunk_id", "block_type", "page", "text")


@query
def agg7_parse_stats(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return blocks.parse_stats(b, blocks.parse_blocks(b))


@query
def prj8_section_key(spark, sf_dir):
    heads = _parsed(spark, sf_dir).where((F.col("block_type") == "SectionHeader") & T.is_section(F.col("text")))
    return heads.select("doc_id", "seq", _join(T.section_key(F.col("text")).cast("array<string>"), ".").alias("section_key"), T.section_title(F.col("text")).alias("section_title"))


@query
def win2_section_path(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "seq", "block_type", "section_path")


@query
def win3_content_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "seq", "content_label")


@query
def agg1_anchors(spark, sf_dir):
    return labels.anchors(_labelled(spark, sf_dir)).select("doc_id", "label", _join("chunk_ids").alias("chunk_ids"))


@query
def fn10_references(spark, sf_dir):
    return refs.extract_references(_labelled(spark, sf_dir))


@query
def prj13_reference_nouns(spark, sf_dir):
    return refs.extract_references(_labelled(spark, sf_dir), INTENDED).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def jn1_resolved(spark, sf_dir):
    x = _labelled_stage(spark, sf_dir)
    return refs.resolved(refs.extract_references(x), labels.anchors(x)).select("doc_id", "seq", "chunk_id", "label", "pos", _join("chunk_ids").alias("chunk_ids"))


@query
def jn2_unresolved(spark, sf_dir):
    x = _labelled_stage(spark, sf_dir)
    return refs.unresolved(refs.extract_references(x), labels.anchors(x)).select("doc_id", "seq", "chunk_id", "label", "pos")


@query
def agg2_linked_map(spark, sf_dir):
    return _linked(spark, sf_dir).select("doc_id", "seq", _render("linked_chunks").alias("linked_chunks"), _join("unresolved_refs").alias("unresolved_refs"))


@query
def win5_parent_group(spark, sf_dir):
    return grouping.with_parent_group(_labelled_stage(spark, sf_dir)).select("doc_id", "seq", "chunk_id", "parent_group")


@query
def agg3_parent_chunks(spark, sf_dir):
    """AGG3 to AGG6."""
    p = grouping.parent_chunks(_grouped(spark, sf_dir))
    return p.select("doc_id", "id", "section_path", _join("chunk_ids").alias("chunk_ids"), "mini_chunk_count", _join("content_labels").alias("content_labels"), _render("linked_chunks").alias("linked_chunks"), _join("unresolved_refs").alias("unresolved_refs"))


@query
def agg11_chunk_stats(spark, sf_dir):
    x = staged(_linked(spark, sf_dir).drop("text", "linked_chunks"), "linked")
    return grouping.chunk_stats(x, grouping.with_parent_group(x))


@query
def jn4_children_with_parents(spark, sf_dir):
    g = _grouped(spark, sf_dir)
    p = grouping.parent_chunks(g).select("doc_id", F.col("id").alias("parent_group"), F.col("section_path").alias("parent_path"), "mini_chunk_count")
    return g.select("doc_id", "parent_group", "chunk_id").join(p, ["doc_id", "parent_group"])


@query
def jn7_split_links(spark, sf_dir):
    return storage.split_links(_grouped(spark, sf_dir)).select("doc_id", "seq", "chunk_id", "label", "place", "target", "external")


@query
def fn12_stable_ids(spark, sf_dir):
    return _grouped(spark, sf_dir).select("doc_id", "chunk_id", storage.chunk_uuid(F.col("doc_id"), F.col("chunk_id")).alias("id"), storage.parent_uuid(F.col("doc_id"), F.col("parent_group")).alias("parent_group_id"))


@query
def prj14_storage_records(spark, sf_dir):
    """PRJ14 to PRJ17, JN3: the flat record, links rendered."""
    boxed = _grouped(spark, sf_dir).withColumn("bbox", F.array(*(F.col("seq") * k + 0.5 for k in range(4))))
    r = storage.storage_records(boxed, F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return r.withColumns({"bbox": _join(F.col("bbox").cast("array<string>")), "external_links": _render("external_links"), "internal_links": _render("internal_links")})


@query
def prj18_vector_documents(spark, sf_dir):
    d = storage.vector_documents(storage.storage_records(_grouped(spark, sf_dir)))
    return d.select("id", "page_content", "metadata.type", "metadata.section_path", "metadata.parent_id", "metadata.file_name")


@query
def agg12_storage_stats(spark, sf_dir):
    return storage.storage_records(_grouped(spark, sf_dir)).groupBy("file_name").agg(F.count(F.lit(1)).alias("total_chunks"))


@query
def snk7_upsert(spark, sf_dir):
    """Customers of some nations replaced, some added under new keys, all new rows sent twice: new rows win, others stay, each key once."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    added = c.where(F.col("nation") == 7).withColumn("id", F.col("id") + 10_000_000)
    new = c.where(F.col("nation") < 5).withColumn("name", F.upper("name")).union(added)
    return upserted(c, new.union(new))


@query
def src1_layout_scan(spark, sf_dir):
    """SRC1 with a stand-in for the layout model: each line of a document's bytes is a block on a page of eight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    b = layout.scan_layout(docs, _line_layout)
    return b.select("doc_id", "seq", "block_path", "block_type", "page", _join(F.col("bbox").cast("array<int>").cast("array<string>")).alias("bbox"), "html")


def _line_layout(options):
    class Lines:
        def blocks(self, content, name):
            for i, line in enumerate(content.decode().split("\n")):
                yield f"/page/{i // 8}/Text/{i}", "Text", [0, 12 * i, 500, 12 * i + 10], f"<p>{line}</p>" if options.force_ocr else line

    return Lines()


@query
def src5_parent_scan(spark, sf_dir):
    """Nested parents read back to chunks."""
    return unpacked_parents(grouping.parent_chunks(_grouped(spark, sf_dir))).select("doc_id", "seq", "chunk_id", "block_type", "parent_group", "section_path", _render("linked_chunks").alias("linked_chunks"))


def _boxed(spark, sf_dir):
    s = F.col("seq")
    x, y = s % 7 * 10.5, s * 3 % 500 + 0.25
    return _parsed(spark, sf_dir).withColumn("bbox", F.array(x, y, x + 50 + s * 37 % 600, y + 5 + s % 60))


@query
def src6_region_rasters(spark, sf_dir):
    """Pixels of each region: scaled, at most 600 wide, padded to 32."""
    return _boxed(spark, sf_dir).select("doc_id", "seq", raster.image_name(F.col("doc_id"), F.col("chunk_id")).alias("file"), raster.geometry(F.col("bbox")).alias("g")).select("doc_id", "seq", "file", "g.*")


@query
def src7_drawn_regions(spark, sf_dir):
    """As drawn, for descriptions: no limit, no padding."""
    x = _boxed(spark, sf_dir).where(T.needs_image_work(F.col("block_type")))
    return x.select("doc_id", "seq", raster.image_name(F.col("doc_id"), F.col("chunk_id"), described=True).alias("file"), raster.geometry(F.col("bbox"), raster.AS_DRAWN).alias("g")).select("doc_id", "seq", "file", "g.*")


@query
def src8_record_images(spark, sf_dir):
    """At index time: pictures under their records' ids."""
    x = _boxed(spark, sf_dir).where(F.col("block_type").isin("PictureGroup", "FigureGroup"))
    name = raster.image_name(F.col("doc_id"), F.col("chunk_id"), ident=storage.chunk_uuid(F.col("doc_id"), F.col("chunk_id")))
    return x.select(name.alias("file"), raster.geometry(F.col("bbox")).alias("g")).select("file", "g.width", "g.height")


@query
def jn6_page_regions(spark, sf_dir):
    """What each document's file is opened for, once."""
    r = raster.page_regions(_boxed(spark, sf_dir))
    return r.select("doc_id", F.array_join(F.transform("regions", lambda x: F.concat_ws(":", x["seq"], x["page"])), ",").alias("regions"))


@query
def win4_image_context(spark, sf_dir):
    x = models.with_image_context(_parsed(spark, sf_dir))
    return x.where(T.needs_image_work(F.col("block_type"))).select("doc_id", "seq", "context")


@query
def flt5_needs_text_work(spark, sf_dir):
    """Each document's lines, with a TeX command or a mixed word put in by place."""
    m = F.col("seq") % 7
    text = F.when(m == 1, F.concat("text", F.lit(" \\alpha"))).when(m == 2, F.concat("text", F.lit(" графG"))).when(m == 3, F.concat("text", F.lit(" $графG$"))).when(m == 4, F.concat("text", F.lit(" n-вершинный"))).otherwise(F.col("text"))
    return _parsed(spark, sf_dir).withColumn("text", text).select("doc_id", "seq", T.needs_text_work(F.col("block_type"), F.col("text")).alias("needs_work"))


@query
def flt6_needs_description(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "seq", T.needs_image_work(F.col("block_type")).alias("needs_description"))


def _delimited(text: Column) -> Column:
    n = F.col("seq") % 4
    return F.concat(F.when(n == 0, r"\[ x \] и \( y \) ").when(n == 1, r"\\[a  b\\]  и  \\( c\\)").when(n == 2, "$ x  y $ $$ z $$   ").otherwise("  "), text)


@query
def fn3_tidy_delimiters(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", "seq", T.tidy_delimiters(_delimited(F.col("text"))).alias("text"))


@query
def fn7_bracket_state(spark, sf_dir):
    raw = F.concat(F.when(F.col("seq") % 3 == 0, "(").when(F.col("seq") % 3 == 1, ")").otherwise(""), F.col("text"))
    return _parsed(spark, sf_dir).select("doc_id", "seq", T.bracket_state(raw, "(", ")").alias("state"))


@query
def prj12_capitalized(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.capitalized(F.col("p_name")).alias("kind"))


@query
def prj16_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_name(F.col("url")).alias("file_name"), T.stem(F.col("url")).alias("stem"))


@query
def prj5_html_text(spark, sf_dir):
    """Exact text of whole pages by the parser (no SQL form)."""
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


@query
def prj5_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


@query
def prj3_math_blocks(spark, sf_dir):
    """PRJ3, PRJ4, FN11: inline and block formulas, doubled backslashes, row breaks, entities."""
    n = F.col("seq") % 4
    math = (
        F.when(n == 0, '<math display="inline" class="k"> x &lt; \\\\alpha </math>').when(n == 1, '<math display="block">a \\\\ \\begin{b} &amp; \\\\end</math>')
        .when(n == 2, '<math display="inline">a\\\\\\\\b</math> и <math  display="block">c</math>').otherwise('<math>y</math>')
    )
    html = F.concat(F.lit("<p>"), F.translate("text", "<>&", ""), F.lit(" "), math, F.lit("</p>"))
    return _blocks(spark, sf_dir).select("doc_id", "seq", markup.block_text(html).alias("text"))


@query
def prj7_repair_encoding(spark, sf_dir):
    n = F.col("doc_id") % 4
    broken = F.when(n == 0, " cafÃ© Ð´Ð°").when(n == 1, " “q” ‘r’ ﬁn ﬂ").when(n == 2, "\r\nx\u0001\ry").otherwise(" e\u0301")
    return table(spark, sf_dir, "documents").select("doc_id", markup.repair(F.concat("text", broken)).alias("text"))


@query
def prj19_image_text(spark, sf_dir):
    x = _parsed(spark, sf_dir).where(T.needs_image_work(F.col("block_type")))
    keys = F.when(F.col("seq") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return x.select("doc_id", "seq", T.image_text(F.lit("граф"), F.col("text"), F.lit("D"), keys).alias("text"))


@query
def flt9_answer_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "граф").otherwise("рисунок")
    return d.select("doc_id", T.image_answer_ok(F.col("text"), kind, F.array(F.lit("a"))).alias("valid"))


@query
def fn2_answer_text(spark, sf_dir):
    raw = F.concat(F.lit('Ответ: {"text": "'), F.col("text"), F.lit('"}'))
    return _parsed(spark, sf_dir).select("doc_id", "seq", T.answer_text(raw).alias("text"))


def _bare() -> Column:
    """A chunk's text without the characters that the rules for formulas look at."""
    return F.translate("text", "$\\()[]{}\"", "")


def _with_formula(text: Column) -> Column:
    n = F.col("seq") % 4
    return F.when(n == 1, F.concat(text, F.lit(" \\\\alpha + x"))).when(n == 2, F.concat(F.lit("$x_1$, "), text)).when(n == 3, F.concat(text, F.lit(" \\\\beta(z слово) дальше"))).otherwise(text)


@query
def fn1_clean_answers(spark, sf_dir):
    """FN1, FN2, FN14: an answer found in chatter, its text put right."""
    raw = F.concat(F.lit('Вот: {"text" : "'), _with_formula(_bare()), F.lit('"} готово'))
    return _parsed(spark, sf_dir).select("doc_id", "seq", answers.as_text_answer(raw)["text"].alias("text"))


@query
def fn4_escape(spark, sf_dir):
    n = F.col("seq") % 5
    tail = F.when(n == 0, r" \alpha x").when(n == 1, r" \\beta \\\\\gamma;").when(n == 2, r" a \\ b \n c \nu \\new").when(n == 3, r" \"q\\' \{z").otherwise("")
    return _parsed(spark, sf_dir).select("doc_id", "seq", latex.escape(F.concat(_bare(), tail)).alias("text"))


@query
def fn5_wrap_formulas(spark, sf_dir):
    """FN5, FN6: spans grow over mathematical words, close their brackets and are wrapped."""
    return _parsed(spark, sf_dir).select("doc_id", "seq", latex.wrap(_with_formula(_bare())).alias("text"))


@query
def fn9_formulas_valid(spark, sf_dir):
    n = F.col("doc_id") % 6
    tail = (
        F.when(n == 0, r" $x^{2}$ и $$\{a\}$$").when(n == 1, r" $\frac{a}{b$").when(n == 2, r" $\left( x$").when(n == 3, r" $\begin{m} a \end{m}$ $\left(x\right)$")
        .when(n == 4, r" $\begin{m} a \end{k}$").otherwise(" $}{$")
    )
    return table(spark, sf_dir, "documents").select("doc_id", latex.valid(F.concat(F.translate("text", "$\\{}", ""), tail)).alias("valid"))


def _fake_text_model():
    """Fails on texts whose length is a multiple of five."""
    return lambda text, image: json.dumps({"text": text.replace("\\alpha", "alpha")}, ensure_ascii=False) if len(text) % 5 else "no answer"


def _fake_image_model():
    """Fails on captions whose length is a multiple of three."""
    return lambda caption, context, image: json.dumps({"description": "Схема, на которой вершины соединены рёбрами; подпись дана в тексте." if len(caption) % 3 else "коротко", "image_type": "диаграмма", "key_elements": ["схема"]}, ensure_ascii=False)


def _marked(spark, sf_dir):
    return _parsed(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 7 == 1, F.concat("text", F.lit(" \\alpha"))).otherwise(F.col("text")))


@query
def agg8_text_stats(spark, sf_dir):
    """MDL1, MDL6, PRJ20, AGG8 with a deterministic stand-in for the model, which fails on some."""
    s = models.text_stats(models.repair_texts(_marked(spark, sf_dir), _fake_text_model))
    return s.withColumn("failed_chunks", _join("failed_chunks"))


@query
def mdl1_repaired_texts(spark, sf_dir):
    """MDL1, MDL3, FLT7, PRJ20: accepted answers replace the text, failed chunks keep theirs."""
    rows = _marked(spark, sf_dir).where(F.col("block_type") == "Text").withColumn("text", F.translate("text", "$", ""))
    return models.repair_texts(rows, _fake_text_model).select("doc_id", "seq", "text", F.col("fixed_text").isNotNull().alias("fixed"))


@query
def agg9_image_stats(spark, sf_dir):
    """MDL2, AGG9 with a deterministic stand-in for the model, which fails on some."""
    s = models.image_stats(models.describe_images(_parsed(spark, sf_dir), _fake_image_model))
    return s.withColumn("failed_chunks", _join("failed_chunks"))


@query
def mdl2_described_images(spark, sf_dir):
    """MDL2, FLT8, PRJ19: accepted descriptions replace the caption."""
    return models.describe_images(_parsed(spark, sf_dir), _fake_image_model).where("needs_description").select("doc_id", "seq", "text", "described")


def _chain_model():
    """Tells a tree from a diagram by whether the image before was described."""
    return lambda caption, context, image: json.dumps({"description": "Ещё один рисунок с вершинами и рёбрами, описанный достаточно длинно.", "image_type": "дерево" if context.startswith("До изображения:\n![") else "диаграмма", "key_elements": []}, ensure_ascii=False)


@query
def mdl7_descriptions_in_order(spark, sf_dir):
    """MDL7: the context of an image sees the new text of the image before it."""
    x = _parsed(spark, sf_dir).withColumn("block_type", F.when(F.col("seq") % 20 == 13, "Figure").otherwise(F.col("block_type")))
    return models.describe_images_in_order(x, _chain_model).where("needs_description").select("doc_id", "seq", "text")


@query
def mdl4_parameters(spark, sf_dir):
    """MDL4: what the factory is handed, as the model reports it."""
    o = models.ModelOptions(name="m", temperature=0.25, repeat_penalty=1.5, max_tokens=77, prompt="P {format}")
    told = models.repair_texts(_marked(spark, sf_dir), lambda options, prompt: lambda text, image: json.dumps({"text": f"{options.name} {options.temperature} {options.repeat_penalty} {options.max_tokens} {prompt[:2]}"}), o)
    return told.where("needs_work").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query
def mdl5_image_prompts(spark, sf_dir):
    """MDL5: what is asked about each image, after the fixed words."""
    x = models.with_image_context(_parsed(spark, sf_dir)).where(T.needs_image_work(F.col("block_type")))
    return x.select("doc_id", "seq", F.substring_index(models.image_prompt(F.col("text"), F.col("context")), "Подпись: ", -1).alias("asked"))


@query
def agg10_document_stats(spark, sf_dir):
    """All stages' figures in one row a document."""
    b, p = _blocks(spark, sf_dir), staged(_marked(spark, sf_dir), "parsed")
    return document.stats(b, p, models.repair_texts(p, _fake_text_model), models.describe_images(p, _fake_image_model))


@query
def agg13_remaining_work(spark, sf_dir):
    x = _marked(spark, sf_dir).withColumn("w", T.needs_text_work(F.col("block_type"), F.col("text")))
    return x.groupBy("doc_id").agg(F.count_if("w").alias("remaining"), F.every(~F.col("w")).alias("all_done"))


@query
def src9_base64(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.base64_text(F.col("html").cast("binary")).alias("base64"))


@query
def mdl9_dense_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page_content"))
    v = storage.embed(docs, storage.hashing_embedder())
    return v.select("doc_id", F.size("dense").alias("dim"), F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query
def mdl10_sparse_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return storage.sparse_terms(docs, "doc_id", "text").select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


