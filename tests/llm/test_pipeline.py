"""The corpus pipeline's stages against brute force on a small folder of tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    clean = [f"plain text number {i} " + " ".join(f"w{(i * 7919 + k * k * 31 + k) % 997}" for k in range(40)) for i in range(120)]  # no two alike
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(1000 + i, f"you idiot scum {t}") for i, t in enumerate(clean[:60:2])]
    rows += [(2000, clean[3]), (2001, clean[3] + " x"), (3000, "before the secret exam question asks what nine plus nine makes in total after")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in rows if i < 2000], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "the secret exam question asks what nine plus nine makes in total")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages(spark, folder):
    at, rows = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        path = f"{at}/{name}"
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert seen[names[0]] == {i for i, _ in rows if not 1000 <= i < 2000}
    assert 2000 not in seen[names[1]] and 3 in seen[names[1]]
    assert seen[names[1]] - seen[names[2]] == {3000}
    assert seen[names[3]] == seen[names[2]]


def test_stages_take_any_rows(spark, folder):
    """Nulls in every column, empty and very long texts, repeated rows, columns of clashing names, and no rows."""
    at, rows = folder
    ddl = "doc_id long, text string, lang string, source string, n_chars long, spans string, _toxic string, _key string, label string, n_words string"
    some = [(i, t, "en", "s", len(t), "a", "b", "c", "d", "e") for i, t in rows[:20]]
    clean = rows[40][1]
    odd = [(None, None, None, None, None, "a", "b", "c", "d", "e"), (7_000, None, None, None, None, None, None, None, None, None), (7_001, "", None, None, 0, "a", "b", "c", "d", "e"), (7_002, clean, "en", "s", 1, "a", "b", "c", "d", "e"), (7_002, clean, "en", "s", 1, "a", "b", "c", "d", "e"), (7_002, "another text of quite different words under one id", "en", "s", 1, "a", "b", "c", "d", "e"), (7_003, "long " * 200_000, "en", "s", 1, "a", "b", "c", "d", "e")]
    docs = spark.createDataFrame([*some, *odd], ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and out.schema["spans"].dataType.simpleString() == "string"
        got = out.collect()
        assert all(r["spans"] in ("a", None) and r["_toxic"] in ("b", None) and r["_key"] in ("c", None) for r in got)
        if name != "simhash_near_dedup":
            assert len(got) == len(some) + len(odd)
        else:
            ids = [r["doc_id"] for r in got]
            assert ids.count(None) == 1 and ids.count(7_000) == 1 and ids.count(7_001) == 0 and ids.count(7_002) == 2 and ids.count(7_003) == 1
            assert len(got) == len(some) + 5
        assert stage(spark, docs.limit(0), at).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert len([r for r in packed if r["doc_id"] is None]) == 1 and max(r["piece"] for r in packed if r["doc_id"] == 7_003) > 100


def test_run_is_the_stages(spark, folder):
    at, _ = folder
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100 and out.agg({"length": "max"}).first()[0] <= 1024


def test_near_copies_by_shingles(spark, monkeypatch):
    """Against brute force: groups are the closure of 3 bits or a likeness of 0.8 over five words."""
    import random

    from folioflow.llm import jaccard, simhash

    r = random.Random(7)
    line = "one very common line that stands at the end of all these texts here"
    base = [[f"v{r.randrange(400)}" for _ in range(r.randint(20, 90))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for _ in range(3):
            c = list(w)
            for _ in range(r.randint(1, 2)):
                c[r.randrange(len(c))] = f"x{r.randrange(9999)}"
            texts.append(" ".join(c))
    crowd = [f"c{i}" for i in range(100)]
    texts += [" ".join([*crowd[:k], f"y{k}", *crowd[k + 1 :]]) for k in range(10, 50)]  # one large group
    texts += [f"z{k} z{k + 1} {line}" for k in range(30)] + [line, None, "", "one two"]
    fp, sets = [simhash.fingerprint(t.encode() if t else None) for t in texts], [set(jaccard.shingles(t.encode() if t else None).tolist()) for t in texts]
    label, linked = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]) > 0
            close = (fp[i] ^ fp[j]).bit_count() <= 3
            linked += alike and not close
            if alike or close:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert linked > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(set(label))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    monkeypatch.setattr(jaccard, "TOLD_KEYS", 0)  # keys are joined, not told
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_sets_alike_share_a_key():
    """At the very threshold, by any differences: also where the segments that no difference touches are empty, or many shingles are left out of keys."""
    import numpy as np

    from folioflow.llm import jaccard

    rng = np.random.default_rng(8)
    for _ in range(4000):
        union = int(rng.integers(5, 60)) * 5
        every = np.unique(rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2))
        gone = len(every) // 5
        places = np.argsort(every) if rng.random() < 0.3 else rng.permutation(len(every))
        out = rng.permutation(places[: len(every)])[:gone] if rng.random() < 0.5 else np.linspace(0, len(every) - 1, gone).astype(int)
        half = int(rng.integers(0, gone + 1))
        a, b = np.delete(every, out[:half]), np.delete(every, out[half:])
        if 9 * len(np.intersect1d(a, b)) < 4 * (len(a) + len(b)):
            continue
        (ka, ma), (kb, _) = jaccard.segment_keys(a), jaccard.segment_keys(b)
        assert len(np.intersect1d(ka, kb)) > 0
        for mark in np.unique(ma):  # as many as the mark promises
            sure = int(mark) >> 6 & 4095
            number = int(mark) & 63
            if number and any(int(m) & 63 == number for m in jaccard.segment_keys(b)[1]):
                assert len(np.intersect1d(ka[ma == mark], kb)) >= sure


def test_near_copies_beside_many_partners(spark, monkeypatch):
    """Pairs that no round names: each text of a chain is alike to the next alone, while many unlike texts share its keys; every key hot or none."""
    import random

    from folioflow.llm import jaccard

    r = random.Random(11)
    texts = []
    for _ in range(30):  # chains of five, each a step of likeness over 0.8 from the one before
        w = [f"v{r.randrange(5000)}" for _ in range(120)]
        for step in range(5):
            w = [*w[: 24 * step], f"q{r.randrange(99999)}", f"q{r.randrange(99999)}", *w[24 * step + 2 :]]
            texts.append(" ".join(w))
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = sorted(set(label))
    assert len(want) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)  # what one round leaves, the exhaustive search finds
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    monkeypatch.setattr(jaccard, "HOT", 1)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want


def _rows_joined(spark):
    """Rows that every join of this session's queries has made."""
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    each = lambda x: [x.apply(i) for i in range(x.size())]
    for e in each(store.executionsList()):
        values = store.executionMetrics(e.executionId())
        for node in each(store.planGraph(e.executionId()).allNodes()):
            for m in each(node.metrics()) if "Join" in node.name() else ():
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    out[e.executionId(), m.accumulatorId()] = int(v.get().replace(",", ""))
    return out


def test_a_family_is_not_paired_by_rows(spark):
    """Texts of one family, most of them too far apart: all links are found, and no join makes more rows than some times the texts' shingles."""
    import random

    from folioflow.llm import jaccard, simhash

    r = random.Random(5)
    base, texts = [f"v{i}" for i in range(140)], []
    for _ in range(500):
        w = list(base)
        for _ in range(r.randint(3, 5)):
            w[r.randrange(140)] = f"x{r.randrange(999999)}"
        texts.append(" ".join(w))
    fp, sets = [simhash.fingerprint(t.encode()) for t in texts], [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) or (fp[i] ^ fp[j]).bit_count() <= 3:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = sorted(set(label))
    assert 300 < len(want) < 499
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = _rows_joined(spark)
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    made = [v for k, v in _rows_joined(spark).items() if k not in before]
    assert made and max(made) <= 4 * sum(map(len, sets))


def test_shingles_of_no_other_text(spark, monkeypatch):
    """A text's own shingles are counted over all texts, whatever the chunks."""
    import random
    from collections import Counter

    from folioflow.llm import jaccard
    from folioflow.llm.common import Workspace

    r = random.Random(6)
    texts = sorted({" ".join(f"v{r.randrange(6)}" for _ in range(r.randint(0, 60))) for _ in range(200)})
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    count = Counter(x for s in sets for x in s)
    want = sorted((len(s), sum(count[x] == 1 for x in s)) for s in sets)
    assert any(own for _, own in want) and any(own < n for n, own in want)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for chunk in (1 << 19, 1000):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        assert sorted((x["n"], x["own"]) for x in jaccard.prints(Workspace(spark, "test"), docs, "text").collect()) == want


def test_tiles():
    """Links of a tile against brute force: one side or two, equal and very unequal sizes."""
    import numpy as np
    import pyarrow as pa

    from folioflow.llm import jaccard

    rng = np.random.default_rng(9)
    for case in range(60):
        sets, k = [], int(rng.integers(1, 40))
        for _ in range(int(rng.integers(1, 4))):
            base = rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 200)))
            for _ in range(k):
                kept = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.2])]
                sets.append(np.unique(np.append(kept, rng.integers(0, 50, int(rng.integers(0, 9))))))
        sets = [x for x in sets if len(x)]
        side = rng.integers(0, 2, len(sets)) if case % 2 else np.zeros(len(sets), int)
        side[0] = 0
        label = rng.integers(0, len(sets), len(sets))
        got = jaccard._tile_links(pa.table({"side": side, "label": label, "tokens": [x.tolist() for x in sets]})).to_pylist()
        alike = {(int(a), int(b)) for i, a in enumerate(label) for j, b in enumerate(label) if (side[i] < side[j] or not side.any()) and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j])) and a != b}
        assert {(x["a"], x["b"]) for x in got} <= alike | {(b, a) for a, b in alike}

        def closure(links):
            root = list(range(len(sets)))
            for a, b in links:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
            return len(set(root))

        assert closure(alike) == closure([(x["a"], x["b"]) for x in got]) == len(sets) - len(got)


def test_registered():
    import __spark_entry__ as e

    assert {f"op{i}" for i in range(1, 11)} == {q.split("_")[0] for q in e.queries() if q.startswith("op")} and "pipeline" in e.queries()
