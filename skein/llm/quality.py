"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 low quality, 2 good. One weight vector over hashed text features is shared by
all grades; ordered thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). The fit
minimises the mean negative log-likelihood plus an L1 penalty by accelerated proximal gradient, so
that only features that really move the grade keep a weight.

Features of a text, each present or not: its words (lower case, outer punctuation dropped) and its
shapes (the kinds of characters in a word, with punctuation kept, repeats collapsed), a shape
counted by the power of two of its share of the text's words. All are hashed to 64 bits.

Bounds: the model is fitted on at most ``sample_rows`` labelled documents, those with the smallest
hash of ``doc_id``. Everything else covers all documents and whole texts.

Cases: a null or empty text has no feature and gets the score 0; labels with null or unknown values
are left out; several labels of one document count as the lowest grade; without labels every grade
is as probable as in the uniform model and every document is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, read_table, slices

GRADES = 3
SAMPLE_ROWS = 8000
MIN_DOCS = 4
L1 = 5e-4
KEEP_TAIL = 0.5
CACHE = 100_000  # words of at most CACHE_CHARS characters that a task remembers: about 30 MB
CACHE_CHARS = 48

_inner = re.compile(r"[^\W_]")
_classes = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1")]


def _bare(word: str) -> str:
    """The word without its outer punctuation; each end is scanned once."""
    first = _inner.search(word)
    return word[first.start() : len(word) - _inner.search(word[::-1]).start()] if first else ""


def _shape(word: str) -> str:
    upper = "A" if word.isupper() and len(word) > 3 else ""
    for rx, to in _classes:
        word = rx.sub(to, word)
    return upper + word[:12]


def features(text: str | None, cache: dict[str, tuple[int, str]] | None = None) -> set[int]:
    """The 64-bit hashes of the features that a whole text has."""
    cache = {} if cache is None else cache
    found, shapes, n = set(), Counter(), 0
    for word, times in Counter((text or "").split()).items():
        got = cache.get(word)
        if got is None:
            if word.isalpha():
                got = (xxhash.xxh64_intdigest("w " + word.lower()), "Aa" if len(word) > 3 and word.isupper() else "a")
            else:
                got = (xxhash.xxh64_intdigest("w " + _bare(word.lower())), _shape(word))
            if len(cache) < CACHE and len(word) <= CACHE_CHARS:
                cache[word] = got
        found.add(got[0])
        shapes[got[1]] += times
        n += times
    for shape, times in shapes.items():
        share = int(-np.log2(times / n))  # 0: over half of the words
        found.update(xxhash.xxh64_intdigest(f"s {shape} {k}") for k in range(share, 7))
    return found


@dataclass
class OrdinalModel:
    """Shared weights by feature hash (sorted) and ordered thresholds."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.log(np.arange(1, GRADES) / (GRADES - np.arange(1, GRADES))))
    fitted: bool = False

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score and k = 0 .. grades - 2."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))

    def expected_grade(self, scores: np.ndarray) -> np.ndarray:
        return (1 - self.at_most(scores)).sum(axis=1)

    def tail(self, scores: np.ndarray, grade: int = GRADES - 1) -> np.ndarray:
        """P(grade >= ``grade``)."""
        return 1 - self.at_most(scores)[:, grade - 1]


def fit(docs: list[np.ndarray], grades: np.ndarray, l1: float = L1, min_docs: int = MIN_DOCS, steps: int = 300) -> OrdinalModel:
    """Fit on the feature hashes of each document and its grade."""
    if not len(docs):
        return OrdinalModel()
    lengths = np.array([len(d) for d in docs])
    flat = np.concatenate(docs) if lengths.sum() else np.empty(0, np.uint64)
    keys, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(docs)), lengths)
    use = count[index] >= min_docs
    kept = np.flatnonzero(count >= min_docs)
    at = np.searchsorted(kept, index[use])
    rows, keys, n = rows[use], keys[kept], len(docs)
    # Features shared by most texts say little and slow the steps down: their columns are scaled by the root of their count.
    scale = 1 / np.sqrt(count[kept] / n + 0.01)
    grades = np.asarray(grades)

    def grad(w: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.bincount(rows, (w * scale)[at], n)
        cum = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(th[None] - s[:, None], -40, 40))), np.ones((n, 1))], axis=1)
        slope = cum * (1 - cum)
        hi, lo = grades + 1, grades
        p = np.maximum(cum[np.arange(n), hi] - cum[np.arange(n), lo], 1e-12)
        d_hi, d_lo = slope[np.arange(n), hi] / p, slope[np.arange(n), lo] / p
        ds = (d_hi - d_lo) / n  # of the negative log-likelihood by the score
        dth = np.zeros(GRADES + 1)
        np.add.at(dth, hi, -d_hi / n)
        np.add.at(dth, lo, d_lo / n)
        return np.bincount(at, ds[rows], len(kept)) * scale, dth[1:-1]

    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    th = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    w = np.zeros(len(kept))
    # The largest singular value of the scaled columns bounds the step.
    v = np.ones(len(kept)) / max(1, len(kept)) ** 0.5
    top = 1.0
    for _ in range(20):
        u = np.bincount(at, np.bincount(rows, (v * scale)[at], n)[rows], len(kept)) * scale
        top = np.linalg.norm(u) or 1.0
        v = u / top
    step = 1 / (0.5 * top / n + 1)
    y, t, old_w = w.copy(), 1.0, w
    yth, old_th = th.copy(), th
    for _ in range(steps):
        gw, gth = grad(y, yth)
        w = y - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        th = yth - step * gth
        th[1:] = np.maximum(th[1:], np.maximum.accumulate(th)[:-1] + 1e-3)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yth = w + (t - 1) / t2 * (w - old_w), th + (t - 1) / t2 * (th - old_th)
        old_w, old_th, t = w, th, t2
    on = w != 0
    return OrdinalModel(keys[on], (w * scale)[on], th, True)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 low quality, 2 good; the lowest of several."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna()
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _to_features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    cache: dict = {}
    for batch in slices(batches):
        data = [np.fromiter(sorted(features(t, cache)), np.uint64).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(data, pa.binary())], names=["grade", "data"])


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on a bounded sample of the labelled documents; only their feature hashes reach the driver."""
    # At most sample_rows ids: their size is bounded whatever the tables hold.
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = id_text(docs).join(F.broadcast(sample), "doc_id").select("grade", "text")
    got = texts.mapInArrow(_to_features, "grade int, data binary").toPandas()
    order = np.argsort([bytes(x) for x in got.data], kind="stable") if len(got) else []
    got = got.iloc[order]
    return fit([np.frombuffer(x, np.uint64) for x in got.data], got.grade.to_numpy(int))


def score_texts(docs: DataFrame, model: OrdinalModel, keep_tail: float = KEEP_TAIL, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (default: doc_id) plus expected_grade, tail_probability and keep."""
    import pyspark.sql.types as T

    columns = ["doc_id"] if columns is None else columns
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    table = dict(zip(model.keys.tolist(), model.weights.tolist()))
    least = keep_tail if model.fitted else 0.0
    shared = docs.sparkSession.sparkContext.broadcast((table, model.thresholds))  # as large as the fitted sample allows

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, thresholds = shared.value
        m, cache = OrdinalModel(thresholds=thresholds), {}
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            scores = np.array([sum(table[f] for f in features(x, cache) if f in table) for x in texts], float)
            tail = m.tail(scores)
            made = [batch.column(c) for c in columns] + [pa.array(m.expected_grade(scores)), pa.array(tail), pa.array(tail >= least)]
            yield pa.RecordBatch.from_arrays(made, names=[*columns, "expected_grade", "tail_probability", "keep"])

    return given.mapInArrow(run, schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the top grade and the decision for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, fit_on(docs, read_table(spark, sf_dir, "labels")))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps, their columns unchanged."""
    model = fit_on(docs, read_table(spark, sf_dir, "labels"))
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = score_texts(docs.toDF(*names), model, columns=names).where("keep").select(*names)
    return kept.toDF(*docs.columns)
