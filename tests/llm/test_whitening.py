import math

import numpy as np
import pytest
from pyspark.sql import types as T

from skein.llm import whitening
from tests.llm.fixtures import table

ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()), T.StructField("n", T.StringType())])


def brute(rows, most=32):
    """Covariance of all vectors at once, by plain eigen-decomposition."""
    kept = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    d = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], object)
    centred = (d / n).astype(float)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(most, len(e))
    white = centred @ axes[:, :k] / np.sqrt(e[:k])
    return [(kept[i][0], n, sum(int(v) ** 2 for v in d[i]), white[i]) for i in range(n)], e[:k] / e.sum()


def check(df, rows):
    want, shares = brute(rows)
    got = {}
    for r in df.collect():
        assert r.n == len(want) and r.identity_error <= 1e-4
        assert abs(r.explained / shares[r.component - 1] - 1) <= 1e-4
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    assert len(got) == len({(i, d) for i, _, d, _ in want})
    signs = None
    for i, _, d, white in want:
        mine = np.array([got[i, d][c + 1] for c in range(len(white))])
        signs = np.sign(mine * white) if signs is None else signs
        assert np.allclose(mine, signs * white, rtol=1e-5, atol=1e-5)


def test_query_equals_plain_covariance(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(whitening.op12_whitening(spark, sf), rows)


def test_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * [3, 1, 1, 0.5, 0.2] + 7).astype(np.float32).tolist()) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, rows[3][1]), rows[5], (105, [])]
    other = [(104, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows + odd + other], ROW).repartition(7)
    check(whitening.op12_whitening(spark, table(spark, tmp_path, "embeddings", df)), rows + odd)


def test_parts_and_rounds_lose_nothing(spark, tmp_path, monkeypatch):
    """Many small parts, some of a single vector, merged two at a time; a large mean takes no digits."""
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) @ rng.normal(size=(6, 6)) + 5000).astype(np.float32).tolist()) for i in range(80)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], ROW).repartition(40)
    check(whitening.op12_whitening(spark, table(spark, tmp_path, "embeddings", df)), rows)


@pytest.mark.parametrize("vectors", [[], [None, []]])
def test_no_vectors(spark, tmp_path, vectors):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in enumerate(vectors)], ROW)
    assert whitening.op12_whitening(spark, table(spark, tmp_path, "embeddings", df)).collect() == []


def test_no_spread(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 2.0, 3.0], "a", "b") for i in range(4)] + [(9, [0.0, 2.0, 3.0], "a", "b")], ROW)
    got = whitening.op12_whitening(spark, table(spark, tmp_path, "embeddings", df)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert len(got) == 15 and max(r.identity_error for r in got) < 1e-9
    same = spark.createDataFrame([(1, [1.0, 2.0], "a", "b")] * 3, ROW)
    got = whitening.op12_whitening(spark, table(spark, tmp_path / "b", "embeddings", same)).collect()
    assert [(r.whitened, r.deviation, r.explained) for r in got] == [(None, 0, 0.0)] * 6


def test_deviation_beyond_64_bits():
    assert whitening._squares(np.array([[3_037_000_500], [2]])) == [None, 4]
    assert whitening._squares(np.array([[2_000_000_000, 2_000_000_000]])) == [8 * 10**18]


def test_huge_entries_stay_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 2.0**36).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], ROW)
    x = whitening.whole_numbers(df, "vec_id", "embedding")
    found = whitening.summary(x)
    assert found.n == 2000 and found.sums == [sum(math.floor(64 * v[k]) + 1_000_000 for _, v in rows) for k in range(3)]
    made = whitening.Whitener(whitening.Summary(1 << 20, [s << 10 for s in found.sums], found.scatter), 2)
    v = np.array([[math.floor(64 * c) + 1_000_000 for c in rows[0][1]]])
    assert made.deviations(v).tolist() == [[(a << 20) - (s << 10) for a, s in zip(v[0].tolist(), found.sums)]]
    assert np.isfinite(made(v)).all()
