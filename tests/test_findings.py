"""Small cases of what reviews found."""

import json
import tracemalloc

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from folioflow.functions import answers, latex, markup
from folioflow.functions import text as T
from folioflow.operators import layout, models, storage
from tests.test_engine import chunks


def test_quotes_of_a_json_answer_are_quotes(spark):
    assert answers.parsed(json.dumps({"text": 'a "b" c'})) == {"text": 'a "b" c'}
    assert answers.parsed('{"text": "abc "q" \\nu"}') == {"text": 'abc "q" \\nu'}
    assert answers.parsed(json.dumps({"description": 'D "e"', "image_type": "g", "key_elements": ['"k" l']}))["description"] == 'D "e"'
    x = chunks(spark, [[("Text", 'token = "7f" \\alpha')]])
    got = models.repair_texts(x, lambda: lambda text, image: json.dumps({"text": text.replace("\\alpha", "alpha")})).first()
    assert got["text"] == 'token = "7f" alpha'


def test_cut_off_references_of_pages_are_text(spark):
    page = "<p>a &amp;&amp<b>b</b> &copy; &#39;c&#x41; &am</p><p>&notit; & &;</p>"
    got = spark.createDataFrame([(1, page), (2, None), (3, "")], "i int, h string").select("i", markup.html_text(F.col("h"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["a &&ampb © 'cA &am&notit; & &;", None, ""]


def test_slices_of_a_batch_keep_their_order(spark):
    texts = [None if i % 5 == 0 else str(i) * (i * 300) for i in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", markup.repair(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == texts


def test_a_batch_is_not_held_as_python_strings():
    batch = pa.array([f"{i} " * 30_000 for i in range(300)])  # 30 MB
    for run in (markup.batched(str.lower), markup.batched(lambda t: len(t) > 5, "boolean")):
        tracemalloc.start()
        out = run.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == len(batch) and peak < 8e6


def test_words_that_cancel_out_have_a_vector():
    bucket = lambda w: (xxhash.xxh64_intdigest(w) % 4, xxhash.xxh64_intdigest(w) >> 63)
    words = [f"w{i}" for i in range(100)]
    a, b = next((a, b) for a in words for b in words if bucket(a)[0] == bucket(b)[0] and bucket(a)[1] != bucket(b)[1])
    lengths = [round(sum(x * x for x in v), 3) for v in storage.hashing_embedder(4)([f"{a} {b}", a, "", " \n", "\u00a0"])]
    assert lengths == [1, 1, 0, 0, 1]


def test_layout_blocks_leave_in_few_batches(spark, monkeypatch):
    sizes = []

    class Lines:
        def __init__(self, options):
            pass

        def blocks(self, content, name):
            for i, line in enumerate(content.decode().split("\n")):
                yield f"/page/0/Text/{i}", "Text", [0, i, 1, 1], line

    class Documents:
        """Stands for a DataFrame: hands out the function that Python workers run."""

        select = lambda self, *c: self
        mapInArrow = lambda self, run, ddl: run

    run = layout.scan_layout(Documents(), Lines)
    docs = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(3000)] + ["bad", "none"]), pa.array([f"a{i}\nb".encode() for i in range(3000)] + [b"\xff", None], pa.binary())], names=["doc_id", "content"])
    rows = []
    for batch in run([docs]):
        sizes.append(batch.num_rows)
        rows += batch.to_pylist()
    assert sizes == [2048, 2048, 1906]
    assert [(r["doc_id"], r["seq"], r["html"]) for r in rows[:6000]] == [(str(i), k, t) for i in range(3000) for k, t in enumerate((f"a{i}", "b"))]
    assert [(r["doc_id"], r["seq"], r["error"].split(":")[0]) for r in rows[6000:]] == [("bad", None, "UnicodeDecodeError"), ("none", None, "TypeError")]


def test_only_brackets_are_folded(spark):
    texts = ["", "abc", "a(b)c", ")x(", "((y)", None, "[(]", "x\n(\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for opening, closing, want in (("(", ")", [0, 0, 0, -1, 1, 0, 1, 1]), ("[", "]", [0, 0, 0, 0, 0, 0, 0, 0]), ("{", "}", [0] * 8)):
        got = frame.select("i", T.bracket_state(F.col("t"), opening, closing).alias("s"))
        assert [r["s"] for r in got.orderBy("i").collect()] == want
    assert "regexp_replace" in got._jdf.queryExecution().optimizedPlan().toString()


def test_images_are_described_in_order_without_other_rows(spark):
    docs = [[("FigureGroup", "a"), ("Figure", "b"), ("Figure", "no"), ("Picture", "d"), ("Text", "e"), ("Figure", None), ("Text", "g")], [("Figure", "h"), ("Text", "i")]]
    answer = lambda kind: json.dumps({"description": "д" * 60, "image_type": kind, "key_elements": []}, ensure_ascii=False)
    made = models.describe_images_in_order(chunks(spark, docs), lambda: lambda caption, context, image: "" if caption == "no" else answer("дерево" if context.startswith("До изображения:\n![") else "граф"))
    got = {(r["doc_id"], r["seq"]): (r["text"], r["needs_description"], r["described"]) for r in made.collect()}
    put = lambda kind, t: (f"![{kind}][{t}]({'д' * 60})", True, True)
    assert got == {
        (0, 0): put("граф", "a"), (0, 1): put("дерево", "b"), (0, 2): ("no", True, False), (0, 3): put("граф", "d"), (0, 4): ("e", False, False), (0, 5): put("граф", ""),
        (0, 6): ("g", False, False), (1, 0): put("граф", "h"), (1, 1): ("i", False, False),
    }
    plan = made.where("needs_description").select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Union" not in plan


def test_words_far_from_formulas_are_not_looked_at(monkeypatch):
    seen, real = [], latex.Runs.mathematical
    monkeypatch.setattr(latex.Runs, "mathematical", lambda self, a, z: seen.append(a) or real(self, a, z))
    far = "слово и ещё " * 500
    assert latex.dollars(far + "a b \\\\alpha c, d слово " + far) == far + "$a b \\\\alpha c, d$ слово " + far
    assert len(seen) < 20
