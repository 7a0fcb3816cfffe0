"""Toxicity with a counterfactual penalty: a sparse logistic model over words and word beginnings.

Features are presences of whole words and of word beginnings of 3 to 7 letters. For each training text that names a
group, a twin with the group terms swapped inside their list is made; the loss adds the squared difference of the two
logits, so that naming one group rather than another, or any at all, moves the score little.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, remainder

#: Bounds on what a fit may take: labelled rows, and features of the model.
MAX_TRAIN_ROWS, MAX_FEATURES = 20_000, 4096
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6, 7)
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("immigrant", "citizen", "refugee", "foreigner"), ("immigrants", "citizens", "refugees", "foreigners"),
    ("deaf", "blind", "disabled"), ("old", "young"),
    ("musulman", "chrétien", "juif"), ("femme", "homme"), ("femmes", "hommes"),
    ("muslime", "christen", "juden"), ("frau", "mann"), ("frauen", "männer"),
    ("musulmán", "cristiano", "judío"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(found: set[str]) -> set[str]:
    """Whole words (``word``) and beginnings (``begin*``), the latter of longer words only."""
    out = set(found)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in found if len(w) > n])
    return out


def swapped(found: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> set[str] | None:
    """The words with every group term replaced by the next of its list; None if there is none."""
    after = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    return {after.get(w, w) for w in found} if found & after.keys() else None


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.whole = {w: v for w, v in weights.items() if not w.endswith("*")}
        self.begin = {n: {w[:-1]: v for w, v in weights.items() if w.endswith("*") and len(w) == n + 1} for n in PREFIXES}

    def score(self, text: str | None) -> float:
        found = words(text)
        z = self.bias + sum(sorted(self.whole[w] for w in found & self.whole.keys()))
        for n, table in self.begin.items():
            if table:
                z += sum(sorted(table[p] for p in {w[:n] for w in found if len(w) > n} & table.keys()))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def descend(features_of: tuple[np.ndarray, np.ndarray], twins_of: tuple[np.ndarray, np.ndarray], base: np.ndarray, y: np.ndarray, n_features: int, fairness: float, l2: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Minimises log loss + l2 |w|^2 + fairness * mean (logit - twin's logit)^2 by Adam.

    Rows are given as (feature numbers of all rows one behind the other, how many each has); ``base``: the row a twin belongs to.
    """
    (col, size), (tcol, tsize) = features_of, twins_of
    rows, twins = y, base
    row, trow = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(tsize)), tsize)
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        gw = np.bincount(col, g[row], n_features) + 2 * l2 * w
        if len(twins):
            d = 2 * fairness * (z[base] - (np.bincount(trow, w[tcol], len(twins)) + b)) / len(twins)
            per_row = np.bincount(base, d, len(rows))
            gw += np.bincount(col, per_row[row], n_features) - np.bincount(tcol, d[trow], n_features)
        step = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, fairness: float = 1.0, l2: float = 1e-4, min_count: int = 4, min_z: float = 4.0, max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_FEATURES, groups=IDENTITY_TERMS) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod 4 is not 2.

    At most ``max_rows`` labelled rows train the model, chosen by a hash of the id; repeated labels count once, the
    highest; null labels and labels without a document not at all. Without both classes the score is the share of toxic
    labels (no labels: 0).
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    spark = docs.sparkSession
    chosen = (
        labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(remainder("doc_id", 4) != 2)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    train = ws.keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    counts = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), sum(v for k, v in counts.items() if k)
    if not n0 or not n1:
        ws.drop(ws.root)
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model({}, math.log((share or 1e-9) / (1 - share or 1e-9)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            got = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)]
            return pa.RecordBatch.from_arrays(got, names=["feature", "clean", "toxic"])

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update(features(words(text.as_py())))
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield out()
                    seen = [Counter(), Counter()]
        yield out()

    total = train.select("text", "toxic").mapInArrow(tally, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p = (F.col("c") + F.col("t")) / (n0 + n1)
    z = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    best = total.where(F.col("c") + F.col("t") >= min_count).withColumn("z", z).where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "feature").limit(max_features)
    names = sorted({r[0] for r in best.select("feature").collect()} | features({t for g in groups for t in g}))
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for b in batches:
            own, twin = [], []
            for text in b.column(0):
                found = words(text.as_py())
                own.append(sorted(at[f] for f in features(found) & at.keys()))
                other = swapped(found, groups)
                twin.append(None if other is None else sorted(at[f] for f in features(other) & at.keys()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(twin, pa.list_(pa.int32()))], names=["y", "own", "twin"])

    rows = train.select("text", "toxic", "doc_id").orderBy("doc_id").select("text", "toxic").mapInArrow(encode, "y int, own array<int>, twin array<int>").toArrow().combine_chunks()

    def packed(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(rows.column(name).drop_null().chunks or [pa.array([], pa.list_(pa.int32()))])
        return lists.flatten().to_numpy(zero_copy_only=False), np.array(pc.list_value_length(lists), np.int64)

    y = np.array(pc.not_equal(rows.column("y"), 0), float)
    base = np.flatnonzero(np.array(rows.column("twin").is_valid()))
    w, b = descend(packed("own"), packed("twin"), base, y, len(names), fairness, l2)
    ws.drop(ws.root)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, b)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus the score of the whole text; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kept = docs.drop(out)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                got = pa.array([own.score(t.as_py()) for t in b.column(at)], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, out])

    return kept.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, `{out}` double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. Repeated rows come back repeated; no rows: no rows."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents below the threshold, all columns as they were, whatever their names. Null and empty texts have the score of no words; repeated rows share their fate; no rows: no rows."""
    out = "_toxic"
    while out in docs.columns:
        out = f"_{out}"
    return with_scores(docs, fit(docs, labels, **options), out=out).where(F.col(out) < threshold).select(docs.columns)
