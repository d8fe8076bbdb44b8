import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from skein.llm import quality as q
from skein.llm.common import read_table
from tests.llm.fixtures import docs, table

LABELS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("quality", T.IntegerType()), ("toxic", T.IntegerType()))])


def toy(n=120):
    texts, rows = [], []
    for i in range(n):
        body = f"plain words about topic {i % 7} and more"
        kind = i % 3
        texts.append([body + " idiot", body.upper() + "!! " + "##% " * 9, body][kind])
        rows.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return texts, rows


def test_gradient_lowers_the_likelihood_and_thresholds_stay_ordered():
    texts, rows = toy()
    x = [np.fromiter(q.features(t), np.uint64) for t in texts]
    y = np.array([[0, 1, 2][i % 3] for i in range(len(texts))])
    m = q.fit(x, y)
    assert m.thresholds[0] < m.thresholds[1]
    w = dict(zip(m.keys.tolist(), m.weights.tolist()))
    s = np.array([sum(w.get(int(f), 0) for f in d) for d in x])
    assert s[y == 0].max() < s[y == 1].min() < s[y == 2].min() or (m.tail(s)[y == 2].min() > 0.5 > m.tail(s)[y < 2].max())
    assert np.allclose(m.expected_grade(s), (1 - m.at_most(s)).sum(axis=1))


def test_query_and_awkward_rows(spark, tmp_path):
    texts, rows = toy()
    odd = [None, "", " \n ", "word " * 50000, "same", "same"]
    sf = table(spark, tmp_path, "documents", docs(spark, texts + odd, [*range(len(texts)), *range(900, 905), None]))
    rows = rows + [(None, 1, 0), (5, None, None), (7, 1, 1), (12345, 0, 0)]
    table(spark, tmp_path, "labels", spark.createDataFrame(rows, LABELS))
    got = q.op3_quality_classifier(spark, sf).toPandas()
    assert len(got) == len(texts) + len(odd)
    assert got.expected_grade.between(0, 2).all() and got.tail_probability.between(0, 1).all()
    by = got.dropna().set_index("doc_id")
    assert not by.loc[[i for i in range(120) if i % 3 < 2], "keep"].any()
    assert by.loc[[i for i in range(120) if i % 3 == 2], "keep"].all()
    assert by.loc[900, "expected_grade"] == by.loc[901, "expected_grade"]


def test_without_labels_or_documents(spark, tmp_path):
    table(spark, tmp_path, "labels", spark.createDataFrame([], LABELS))
    sf = table(spark, tmp_path, "documents", docs(spark, ["a", None]))
    assert [r.expected_grade for r in q.op3_quality_classifier(spark, sf).collect()] == pytest.approx([1.0, 1.0]) and q.op3_quality_classifier(spark, sf).where("keep").count() == 2
    table(spark, tmp_path, "documents", docs(spark, []))
    assert q.op3_quality_classifier(spark, sf).count() == 0


def test_scores_do_not_depend_on_the_partitions(spark, sf):
    d, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    a = q.score_texts(d, q.fit_on(d, labels)).toPandas().set_index("doc_id").sort_index()
    b = q.score_texts(d.repartition(7), q.fit_on(d.repartition(5), labels)).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(a.expected_grade, b.expected_grade)


def test_held_out_labels(spark, sf):
    d, labels = read_table(spark, sf.replace("sf0.001", "sf0.1"), "documents"), read_table(spark, sf.replace("sf0.001", "sf0.1"), "labels")
    fold = labels.where("pmod(xxhash64(doc_id), 4) > 0")
    got = q.score_texts(d, q.fit_on(d, fold)).toPandas().merge(labels.where("pmod(xxhash64(doc_id), 4) = 0").toPandas(), on="doc_id")
    good = (got.quality == 1) & (got.toxic == 0)
    assert got[good].keep.mean() > 0.98
    assert got[got.toxic == 1].keep.mean() < 0.1


def test_stage_keeps_columns(spark, sf):
    d = read_table(spark, sf, "documents")
    out = q.quality_stage(spark, d, sf)
    assert out.columns == d.columns and 0 < out.count() < d.count()


def test_long_words_take_linear_time():
    began = time.perf_counter()
    q.features("a" + "=" * 1_000_000 + "b " + "x" * 1_000_000 + " " + "a-" * 500_000 + " " + "=" * 1_000_000)
    assert time.perf_counter() - began < 20


@given(st.text(alphabet="a1_=.é中-B", max_size=9))
@settings(max_examples=300, deadline=None)
def test_outer_punctuation_goes(word):
    assert q._bare(word) == re.sub(r"^[\W_]+|[\W_]+$", "", word)


def brute_features(text):
    """Names of the features that a text has, from their description."""
    found, shapes = set(), {}
    words = (text or "").split()
    for w in words:
        found.add("w " + re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()))
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", w)))[:12]
        shape = ("A" if len(w) > 3 and w.isupper() else "") + shape
        shapes[shape] = shapes.get(shape, 0) + 1
    for shape, n in shapes.items():
        found |= {f"s {shape} {k}" for k in range(7) if n / len(words) > 2.0 ** -(k + 1)}
    return found


def test_query_equals_a_plain_fit(spark, tmp_path):
    """The query against another minimiser of the same objective, over named features in a dense matrix."""
    texts, rows = toy(90)
    rng = np.random.default_rng(2)
    texts = [t + " " + " ".join(rng.choice(["alpha", "Beta!", "7-x", "gamma,", "delta"], 3)) for t in texts]
    sf = table(spark, tmp_path, "documents", docs(spark, texts))
    table(spark, tmp_path, "labels", spark.createDataFrame(rows, LABELS))
    got = q.op3_quality_classifier(spark, sf).toPandas().sort_values("doc_id")
    grades = np.array([0 if tox else 1 if not quality else 2 for _, quality, tox in rows])
    sets = [brute_features(t) for t in texts]
    names = sorted(f for f in set().union(*sets) if sum(f in s for s in sets) >= q.MIN_DOCS)
    x = np.array([[f in s for f in names] for s in sets], float)
    x /= np.sqrt(x.mean(axis=0) + 0.01)
    w, th = np.zeros(x.shape[1]), np.array([-0.7, 0.7])
    sig = lambda z: 1 / (1 + np.exp(-z))
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + 1)
    for _ in range(60_000):  # plain steps, so many more than the accelerated ones
        cum = np.column_stack([np.zeros(len(x)), sig(th[None] - (x @ w)[:, None]), np.ones(len(x))])
        slope, at = cum * (1 - cum), np.arange(len(x))
        p = cum[at, grades + 1] - cum[at, grades]
        hi, lo = slope[at, grades + 1] / p, slope[at, grades] / p
        gth = np.array([((grades == k + 1) * lo - (grades == k) * hi).mean() for k in range(2)])
        w = w - step * x.T @ ((hi - lo) / len(x))
        w = np.sign(w) * np.maximum(np.abs(w) - step * q.L1, 0)
        th = th - step * gth
    tail = 1 - sig(th[1] - x @ w)
    grade = 2 - sig(th[0] - x @ w) - sig(th[1] - x @ w)
    assert np.abs(got.tail_probability.to_numpy() - tail).max() < 0.02 and np.abs(got.expected_grade.to_numpy() - grade).max() < 0.03
    assert (got.keep.to_numpy() == (tail >= q.KEEP_TAIL)).all()
