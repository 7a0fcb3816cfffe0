import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import answers, latex, markup
from folioflow.functions import text as T
from folioflow.lexicon import INTENDED, STRICT
from folioflow.operators import blocks, grouping, labels, layout, models, raster, refs, sections, storage
from folioflow.plans.document import PlanOptions, annotate, plan
from folioflow.sources import files
from tests import models as M

DDL = "doc_id long, seq int, block_type string, page string, text string"


def frame(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, k, str(i // 8), t) for i, (k, t) in enumerate(rows)], DDL)


def chunks(spark, docs):
    rows = [(d, i, k, "0", t, f"0-{i}") for d, doc in enumerate(docs) for i, (k, t) in enumerate(doc)]
    return spark.createDataFrame(rows, DDL + ", chunk_id string")


def value(spark, expr, *args, ddl="x string"):
    return spark.createDataFrame([args], ddl).select(expr(*[F.col(c.split()[0]) for c in ddl.split(", ")])).first()[0]


POOL = [
    ("SectionHeader", "1. Графы"), ("SectionHeader", "1.1 Пути"), ("SectionHeader", "1.1.1 Циклы"), ("SectionHeader", "2 Деревья"), ("SectionHeader", "Справка"), ("SectionHeader", "3.2.1 Лес"),
    ("SectionHeader", "Упражнения"), ("SectionHeader", "Задача 1"), ("Text", "Теорема 2.1. Пусть"), ("Text", "лемма 3 о путях"), ("Text", "Доказательство 3"), ("Text", "Доказательство очевидно"),
    ("Text", "Рассмотрим граф"), ("Text", "просто текст"), ("Text", "по теореме 2.1 и лемме 7, см. рис. 3"), ("Equation", "x = y"), ("FigureGroup", "Рис. 3 дерево"), ("FigureGroup", "без номера"),
    ("PageFooter", "стр"), ("Text", "abc"), ("Equation", ""), ("Text", ""),
]


@pytest.fixture(scope="module")
def random_docs():
    r = random.Random(7)
    return [[r.choice(POOL) for _ in range(r.randint(1, 60))] for _ in range(150)]


def test_regions_against_sequential_model(spark, random_docs):
    rows = [(d, i, k, "0", t) for d, doc in enumerate(random_docs) for i, (k, t) in enumerate(doc)]
    got = sorted((r[0], r[1], r[2]) for r in blocks.parse_blocks(spark.createDataFrame(rows, DDL)).select("doc_id", "seq", "chunk_id").collect())
    want = sorted((d, i, f"0-{k}") for d, doc in enumerate(random_docs) for k, i in enumerate(M.regions(doc)))
    assert got == want


def test_paths_labels_groups_against_sequential_models(spark, random_docs):
    s = labels.with_content_label(sections.with_section_path(chunks(spark, random_docs)))
    got = {(r["doc_id"], r["seq"]): r for r in s.collect()}
    grouped = {(r["doc_id"], r["seq"]): r["parent_group"] for r in grouping.with_parent_group(s).collect()}
    for d, doc in enumerate(random_docs):
        path = M.paths(doc)
        kinds = [("Text" if k == "SectionHeader" and not t[:1].isdigit() else k, t) for k, t in doc]
        label = M.labels(kinds)
        assert [got[d, i]["section_path"] for i in range(len(doc))] == path
        assert [got[d, i]["content_label"] for i in range(len(doc))] == label
        body = [i for i, (k, _) in enumerate(kinds) if k != "SectionHeader"]
        assert [grouped[d, i] for i in body] == [str(g) for g in M.packed([(path[i], label[i]) for i in body])]


@pytest.mark.parametrize(("units", "sizes"), [([("", 25)], [10, 10, 5]), ([("", 3), ("A", 7), ("", 1)], [11]), ([("", 9), ("A", 7), ("", 1)], [9, 8]), ([("A", 14)], [14])])
def test_group_sizes(units, sizes):
    labels_ = [label for label, n in units for _ in range(n)]
    got = [g for _, _, g in grouping.numbered(((1, "", label, i) for i, label in enumerate(labels_)), 10)]
    assert [got.count(k) for k in range(len(sizes))] == sizes


def test_golden_paths(spark):
    rows = [("Text", "Введение"), ("SectionHeader", "1. Графы"), ("SectionHeader", "1.1 Пути"), ("SectionHeader", "1.1.1 Циклы"), ("SectionHeader", "2 Деревья"), ("SectionHeader", "Справка"), ("SectionHeader", "3.2.1 Лес")]
    got = sections.with_section_path(frame(spark, rows)).orderBy("seq").collect()
    assert [r["section_path"] for r in got] == ["", "Графы", "Графы > Пути", "Графы > Пути > Циклы", "Деревья", "Деревья", "Деревья > Лес"]
    assert got[5]["block_type"] == "Text"


def test_deep_sections(spark):
    number = lambda n: ".".join(str(i) for i in range(1, n + 1))
    rows = [("SectionHeader", f"{number(n)} T{n}") for n in (1, 9, 10, 11, 12, 2)]
    got = [r["section_path"] for r in sections.with_section_path(frame(spark, rows)).orderBy("seq").collect()]
    assert got == ["T1", "T1 > T9", "T1 > T9 > T10", "T1 > T9 > T11", "T1 > T9 > T12", "T1 > T2"]


def test_references_and_links(spark):
    doc = [("Text", "Теорема 2.1. Пусть"), ("Text", "ещё"), ("Text", "Рассмотрим: по теореме 2.1 и лемме 7, см. рис. 3; алгоритм 4; лемме 7"), ("FigureGroup", "Рис. 3 дерево")]
    a = annotate(chunks(spark, [doc]))
    r = a.where("seq = 2").first()
    assert r["linked_chunks"] == {"Теорема 2.1": ["0-0", "0-1"], "Рисунок 3": ["0-3"]}
    assert r["unresolved_refs"] == ["Лемма 7"]
    assert value(spark, lambda x: T.references(x, STRICT), "По теореме 2.1 и лемме 7, см. рис. 3; алгоритм 4") == ["Теорема 2.1", "Лемма 7", "Рисунок 3"]
    assert value(spark, lambda x: T.references(x, INTENDED), "утверждение 5, рисунок 2") == ["Утверждение 5", "Рисунок 2"]
    found = refs.extract_references(labels.with_content_label(sections.with_section_path(chunks(spark, [doc]))))
    assert [(x["pos"], x["label"]) for x in found.orderBy("pos").collect() if x["seq"] == 2] == [(0, "Теорема 2.1"), (1, "Лемма 7"), (2, "Рисунок 3"), (3, "Лемма 7")]


def test_parents_and_records(spark):
    doc = [("Text", "Теорема 1. A"), ("SectionHeader", "1 Один"), ("Text", "по теореме 1"), ("FigureGroup", "Рис. 3"), ("Text", "см. рис. 3 и лемме 9")]
    g = grouping.with_parent_group(annotate(chunks(spark, [doc])))
    p = {r["id"]: r for r in grouping.parent_chunks(g).collect()}
    assert p["0"]["chunk_ids"] == ["0-0"] and p["1"]["chunk_ids"] == ["0-2", "0-3", "0-4"]
    assert p["1"]["linked_chunks"] == {"Теорема 1": ["0-0"]} and p["1"]["content_labels"] == ["Рисунок 3"] and p["1"]["unresolved_refs"] == ["Лемма 9"]
    sides = {(r["seq"], r["label"]): r["external"] for r in storage.split_links(g).collect()}
    assert sides == {(2, "Теорема 1"): True, (4, "Рисунок 3"): False}
    assert not any(r["external"] for r in storage.split_links(g, strict=True).collect())
    rec = storage.storage_records(g, F.lit("/a/b.pdf"))
    assert tuple(rec.columns) == storage.RECORD
    one = rec.where("type = 'picture'").first()
    assert one["file_name"] == "b.pdf" and one["search_text"] == "Глава: Один. Рис. 3"
    assert sorted(r["id"] for r in rec.collect()) == sorted(r["id"] for r in storage.storage_records(g).collect())
    d = storage.vector_documents(rec).first()
    assert d["page_content"].startswith("Глава") and len(d["metadata"]) == 10


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "id string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4), ("c", 4)]))
    assert sorted(map(tuple, files.upserted(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]


@pytest.mark.parametrize(("text", "work"), [("граф G", False), ("графG", True), ("n-вершинный", False), ("$x$", False), ("\\alpha", True), ("$графG$ да", False), ("$$графG$$ да", False), ("г1G", True)])
def test_needs_text_work(spark, text, work):
    assert value(spark, lambda k, t: T.needs_text_work(k, t), "Text", text, ddl="k string, t string") is work
    assert value(spark, lambda k, t: T.needs_text_work(k, t), "Figure", text, ddl="k string, t string") is False


@pytest.mark.parametrize("text", [r"\(a\) и $$ x $$", r"\\[ a \\]  b", "a  b\n   c", "$ x $ и $$ y $$", r"\[ \alpha \]"])
def test_delimiters_native_equals_python(spark, text):
    assert value(spark, T.tidy_delimiters, text) == latex.delimiters(text)


def test_latex_goldens():
    assert latex.delimiters(r"\(a\) и $$ x $$") == "$a$ и $$x$$"
    assert latex.backslashes(r"\alpha \\\beta \n \nu \" x") == r"\\alpha \\beta \n \\nu \" x"
    assert latex.backslashes("a \\\\ b") == "a \\\\\\\\ b"
    assert latex.dollars(r"пусть \\alpha + x тогда") == r"пусть $\\alpha + x$ тогда"
    assert latex.dollars("нет формул") == "нет формул"
    assert latex.dollars("$$a$$ и (b") == "$a$ и (b"
    assert latex.dollars("(см. $x_1$) тут") == "(см. $x_1$) тут"
    assert latex.united([(5, 6), (0, 2), (2, 4)]) == [(0, 4), (5, 6)]
    assert latex.Depths("(]{").states() == [1, -1, 1] and latex.closed("a(b)c", 2, 4) == (1, 4)
    assert latex.well_formed(r"\begin{a}{x}\end{a}") and not latex.well_formed("{x") and not latex.well_formed(r"\begin{a}\end{b}") and not latex.well_formed(r"\left( x") and latex.well_formed(r"\leftarrow \{")


def test_bracket_state(spark):
    for t in ("()", ")(", "((", "", "(()"):
        got = value(spark, lambda x: T.bracket_state(x, "(", ")"), t)
        low = min([0, *(t[: i + 1].count("(") - t[: i + 1].count(")") for i in range(len(t)))])
        assert got == (-1 if low < 0 else int(t.count("(") > t.count(")")))


def test_answers(spark):
    assert answers.parsed('{"text": "abc "q" d"}') == {"text": 'abc "q" d'}
    assert answers.parsed("nothing") is None and answers.parsed("{}") is None
    raw = 'x {"description": "D", "image_type": "граф", "key_elements": ["a", \'b\', c]} y'
    assert answers.parsed(raw) == {"description": "D", "image_type": "граф", "key_elements": ["a", "b", "c"]}
    assert value(spark, T.answer_text, '{"text": "abc "q" d"}') == 'abc "q" d'
    keys = lambda k: F.array(*map(F.lit, k)).cast("array<string>")
    assert value(spark, lambda x: T.image_text(F.lit("граф"), x, F.lit("D"), keys(["a", "b"])), "Рис. 1") == "![граф][Рис. 1](D. Ключевые слова: a, b)"
    assert value(spark, lambda x: T.image_text(F.lit("граф"), x, F.lit("D"), keys([])), "Рис. 1") == "![граф][Рис. 1](D)"


def test_markup():
    assert markup.math_to_tex('a <math display="inline" x="y"> x &lt; \\\\alpha </math>') == "a $x < \\alpha$"
    assert markup.math_to_tex('<math display="block">a \\\\ \\begin{b}</math>') == "$$a \\\\ \\begin{b}$$"
    assert markup.text_of_html("<p>a &amp; <b>b</b><script>no</script><!-- no --></p>") == "a & b"
    assert markup.repaired("cafÃ© “x”\r\n") == 'café "x"\n' and markup.repaired("naïve É» ﬁn") == "naïve É» fin"
    assert markup.repaired("текст".encode().decode("latin-1")) == "текст" and markup.repaired("é".encode().decode("cp1252").encode().decode("cp1252")) == "é"


def test_models_with_retries(spark):
    x = chunks(spark, [[("Text", "\\alpha раз"), ("Text", "просто"), ("FigureGroup", "Рис. 1"), ("Text", "\\beta")]])

    def flaky():
        calls = {}

        def ask(text, image):
            calls[text] = calls.get(text, 0) + 1
            if calls[text] < 3 or "beta" in text:
                raise ValueError
            return '{"text": "готово"}'

        return ask

    r = models.repair_texts(x, flaky)
    assert [t[0] for t in r.orderBy("seq").select("text").collect()] == ["готово", "просто", "Рис. 1", "\\beta"]
    s = models.text_stats(r).first()
    assert (s["total_chunks_checked"], s["total_corrected"], s["total_failed"], s["failed_chunks"]) == (2, 1, 1, ["0-3"])
    d = models.describe_images(x, lambda: lambda caption, context, image: '{"description": "' + "д" * 60 + '", "image_type": "граф", "key_elements": ["a"]}')
    assert d.where("seq = 2").first()["text"] == "![граф][Рис. 1](" + "д" * 60 + ". Ключевые слова: a)"
    assert models.with_image_context(x).where("seq = 2").first()["context"] == "До изображения:\nпросто\nПосле изображения:\n\\beta"


def drawn():
    class Drawn:
        """A stand-in for an opened file: pages are grey, a region is its size in pixels."""

        def __init__(self, content):
            if content == b"bad":
                raise ValueError("unreadable")
            self.grey = len(content)

        def draw(self, page, bbox, zoom):
            import math

            import numpy as np

            high, wide = (math.ceil(bbox[i + 2] * zoom - 1e-3) - math.floor(bbox[i] * zoom + 1e-3) for i in (1, 0))
            return np.full((high, wide, 3), self.grey + page, np.uint8)

    return Drawn


def test_rasters_fail_alone(spark):
    import struct

    Drawn = drawn()  # made here, so that workers get the class itself
    box = [0.0, 0.0, 400.0, 5.0]
    x = spark.createDataFrame([("a", 0, "0", box), ("a", 1, "x", box), ("a", 2, "1", [10.0, 10.0, 20.0, 50.0]), ("b", 0, "0", box), ("c", 0, "0", box), ("a", 3, "0", None)], "doc_id string, seq int, page string, bbox array<double>")
    f = spark.createDataFrame([("a", bytearray(b"pdf")), ("b", bytearray(b"bad"))], "doc_id string, content binary")
    got = {(r["doc_id"], r["seq"]): r["image"] for r in raster.with_rasters(x, f, Drawn).collect()}
    assert len(got) == 6 and [k for k, v in sorted(got.items()) if v] == [("a", 0), ("a", 2)]
    size = lambda b: struct.unpack(">II", bytes(b)[16:24])
    assert size(got["a", 0]) == (600, 32) and size(got["a", 2]) == (22, 85)
    g = x.where("bbox is not null").select("doc_id", "seq", raster.geometry(F.col("bbox")).alias("g")).collect()
    assert {(r["doc_id"], r["seq"]): (r["g"]["width"], r["g"]["height"]) for r in g if (r["doc_id"], r["seq"]) in (("a", 0), ("a", 2))} == {("a", 0): (600, 32), ("a", 2): (22, 85)}
    whole = {r["seq"]: size(r["image"]) for r in raster.with_rasters(x.where("seq = 0 and doc_id = 'a'"), f, Drawn, raster.AS_DRAWN).collect()}
    assert whole == {0: (834, 11)}
    import zlib

    import numpy as np

    px = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    raw = raster.png(px)
    at = raw.index(b"IDAT")
    assert zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]]) == b"".join(b"\0" + r.tobytes() for r in px)
    assert raster.finished(np.full((10, 1200, 3), 7, np.uint8), raster.RasterOptions()).shape == (32, 600, 3)


def test_layout_scan(spark, tmp_path):
    class Fake:
        def __init__(self, options):
            self.options = options

        def blocks(self, content, name):
            for i, line in enumerate(content.decode().split("\n")):
                yield f"/page/{i}/Text/{i}", "Text", [0, 0, 1, 1], f"<p>{line}{'' if self.options.force_ocr else '!'}</p>"

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "один.pdf").write_bytes("x\ny".encode())
    (tmp_path / "two.pdf").write_bytes(b"\xff")
    (tmp_path / "three.txt").write_bytes(b"no")
    docs = layout.read_documents(spark, str(tmp_path))
    got = sorted((tuple(r) for r in layout.scan_layout(docs, Fake).select("doc_id", "seq", "page", "html").collect()), key=str)
    assert got == sorted([("two", None, None, None), ("один", 0, "0", "<p>x</p>"), ("один", 1, "1", "<p>y</p>")], key=str)
    assert "UnicodeDecodeError" in layout.scan_layout(docs, Fake).where("seq is null").first()["error"]


def test_prompts_and_parameters_reach_the_model(spark):
    x = chunks(spark, [[("Text", "\\alpha"), ("FigureGroup", "Рис. 1"), ("FigureGroup", "Рис. 2")]])
    o = models.ModelOptions(name="m", temperature=0.5, max_tokens=7, prompt="p {format}")
    told = models.repair_texts(x, lambda options, prompt: lambda text, image: '{"text": "' + f"{options.name} {options.temperature} {options.max_tokens} {prompt[:1]}" + '"}', o)
    assert told.where("seq = 0").first()["text"] == "m 0.5 7 p"
    assert models.text_prompt().endswith(models.TEXT_FORMAT)
    shown = spark.range(1).select(models.image_prompt(F.lit("c"), F.lit("t"))).first()[0]
    assert "Подпись: c. Текст рядом: t." in shown and "{" not in shown.replace(models.IMAGE_FORMAT, "")
    answer = '{"description": "' + "д" * 60 + '", "image_type": "граф", "key_elements": []}'
    seen = models.describe_images_in_order(x, lambda: lambda caption, context, image: answer if caption == "Рис. 1" or "![граф][Рис. 1]" in context else "no")
    assert [r["described"] for r in seen.orderBy("seq").collect()] == [False, True, True]
    plain = models.describe_images(x, lambda: lambda caption, context, image: answer if caption == "Рис. 1" or "![граф][Рис. 1]" in context else "no")
    assert [r["described"] for r in plain.orderBy("seq").collect()] == [False, True, False]


def test_run_store_and_clean_up(spark, tmp_path, random_docs):
    from folioflow import logs
    from folioflow.plans.document import StorageOptions, run, store

    logs.set_up(tmp_path / "logs")
    rows = [(d, i, k, "0", t) for d, doc in enumerate(random_docs[:10]) for i, (k, t) in enumerate(doc)]
    s = run(spark.createDataFrame(rows, DDL), str(tmp_path / "out")).collect()
    assert len(s) == 10 and all(r["layout_seconds"] > 0 and r["storage_seconds"] > 0 for r in s)
    assert "storage took" in next((tmp_path / "logs").glob("*.log")).read_text()
    logs.set_up()
    parents = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    want = spark.read.parquet(str(tmp_path / "out" / "storage"))
    for recreate in (False, False, True):
        store(spark, StorageOptions(target=str(tmp_path / "t"), recreate=recreate), parents).collect()
        got = spark.read.parquet(str(tmp_path / "t" / "current"))
        assert sorted(r["id"] for r in got.select("id").collect()) == sorted(r["id"] for r in want.select("id").collect())
    files.write_documents_json(parents.select("doc_id", F.col("id").cast("int").alias("seq"), *[c for c in parents.columns if c != "doc_id"]), str(tmp_path / "j"))
    text = next((tmp_path / "j" / "doc_id=3").glob("part*")).read_text()
    (tmp_path / "3_chunk_processed_json.txt").write_text(text)
    back = files.unpacked_parents(files.read_parents(spark, str(tmp_path / "*_chunk_processed_json.txt"), "_chunk_processed_json.txt"))
    flat = spark.read.parquet(str(tmp_path / "out" / "grouped")).where("doc_id = 3")
    assert sorted((r["chunk_id"], r["parent_group"]) for r in back.collect()) == sorted((r["chunk_id"], r["parent_group"]) for r in flat.collect())
    for name in ("chunk0-1_a.png", "chunk0-2_a.png", "chunk0-1_a_image.png", "chunk0-1_b.png"):
        (tmp_path / name).write_bytes(b"x")
    assert files.delete_images(spark, str(tmp_path), "a") == (2, []) and (tmp_path / "chunk0-1_a_image.png").exists() and (tmp_path / "chunk0-1_b.png").exists()
    assert files.delete_images(spark, str(tmp_path), "a", described=True) == (1, [])


def test_whole_plan_and_empty_input(spark, random_docs):
    rows = [(d, i, k, "0", t) for d, doc in enumerate(random_docs[:20]) for i, (k, t) in enumerate(doc)]
    p = plan(spark.createDataFrame(rows, DDL), PlanOptions(text_model=lambda: lambda t, i: '{"text": "' + t.replace("\\", "") + '"}'))
    assert p.documents.count() == p.grouped.count() > 0 and p.stats.count() == 20
    assert p.records.select("id").distinct().count() == p.records.count()
    e = plan(spark.createDataFrame([], DDL))
    assert e.documents.count() == 0 and e.parents.count() == 0 and e.stats.count() == 0


def test_chunk_json_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("b", 1, "0-1", "зя"), ("b", 0, "0-0", "a"), ("c", 0, "0-0", None)], "doc_id string, seq int, id string, text string")
    files.write_documents_json(x, str(tmp_path / "j"))
    got = spark.read.text(str(tmp_path / "j")).orderBy("doc_id").collect()
    assert got[0]["value"] == '[{"id":"0-0","text":"a"},{"id":"0-1","text":"зя"}]'
    (tmp_path / "книга_processed.txt").write_text(got[0]["value"])
    (tmp_path / "bad_processed.txt").write_text("not json")
    back = files.read_chunk_json(spark, str(tmp_path / "*_processed.txt"), "id string, text string", "_processed.txt").orderBy("doc_id", "seq").collect()
    assert [tuple(r) for r in back] == [("bad", None, None, None), ("книга", 0, "0-0", "a"), ("книга", 1, "0-1", "зя")]
    files.write_stage(x, str(tmp_path / "s" / "layout"))
    assert files.resume(spark, str(tmp_path / "s"), ["text", "image"]).count() == 3 and files.resume(spark, "x", ["layout"]) is None
    col = str(tmp_path / "col")
    files.ensure_collection(spark, col, "id string")
    assert spark.read.parquet(col).count() == 0
    spark.createDataFrame([("a",)], "id string").write.mode("append").parquet(col)
    files.ensure_collection(spark, col, "id string")
    assert spark.read.parquet(col).count() == 1
    files.ensure_collection(spark, col, "id string", recreate=True)
    assert spark.read.parquet(col).count() == 0


def test_stream_ingest_survives_replays(spark, tmp_path, random_docs):
    from folioflow.streaming.ingest import current_records, ingest_blocks

    def put(docs):
        rows = [(d, i, k, "0", t) for d in docs for i, (k, t) in enumerate(random_docs[d])]
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def ingest():
        ingest_blocks(spark, str(tmp_path / "in"), DDL, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    def ids():
        return sorted(r["id"] for r in current_records(spark, str(tmp_path / "out")).select("id").collect())

    assert current_records(spark, str(tmp_path / "out")) is None
    for docs in ([0, 1], [1, 2], [3]):
        put(docs)
        ingest()
    rows = [(d, i, k, "0", t) for d in (0, 1, 2, 3) for i, (k, t) in enumerate(random_docs[d])]
    want = sorted(r["id"] for r in plan(spark.createDataFrame(rows, DDL)).records.select("id").collect())
    assert ids() == want
    (tmp_path / "cp" / "commits" / "2").unlink()  # the batch was published, but its commit was lost: it runs again
    (tmp_path / "cp" / "commits" / ".2.crc").unlink(missing_ok=True)
    ingest()
    assert ids() == want
    (tmp_path / "cp" / "commits" / "2").unlink()
    (tmp_path / "cp" / "commits" / ".2.crc").unlink(missing_ok=True)
    (tmp_path / "out" / "manifests" / "000000000002").unlink()  # lost before it was published
    ingest()
    assert ids() == want
    assert len(list((tmp_path / "out" / "manifests").glob("0*"))) <= 2


def test_dense_and_sparse(spark):
    d = spark.createDataFrame([("1", "граф и дерево"), ("2", "граф"), ("3", None)], "id string, page_content string")
    assert all(len(r["dense"]) == 384 for r in storage.embed(d, storage.hashing_embedder()).collect())
    w = {(r["id"], r["term"]): r["weight"] for r in storage.sparse_terms(d).collect()}
    assert w["1", "дерево"] > w["1", "граф"] > 0 and len(w) == 4


def test_plans_scan_stages_once(spark):
    """The records of whole documents: one fold, one scan of each stage a branch that reads it, no text in the joins of links."""
    from folioflow.plans.queries import QUERIES

    plan_ = QUERIES["prj14_storage_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan_.count("FileScan") <= 3 and plan_.count("MapInArrow") == 0 and plan_.count("Window [") == 0
    plan_ = QUERIES["agg11_chunk_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan_.count("FileScan") <= 3 and plan_.count("MapInArrow") <= 1
    plan_ = QUERIES["mdl10_sparse_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan_


def test_stage_folders(spark, tmp_path):
    from folioflow.sources import stages

    kept = stages.staged(spark.range(5), "t")
    assert kept.count() == 5 and stages.drop_stages(spark) >= 1 and stages.drop_stages(spark) == 0

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):  # no local folder on a cluster
        stages.shared_folder(Session())
