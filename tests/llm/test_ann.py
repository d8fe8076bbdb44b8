import heapq

import numpy as np
import pandas as pd

from skein.llm import ann as q
from tests.llm.fixtures import table

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i, tuple(np.float32(v).astype(float))] = np.float32(v).astype(float)
    out = {}
    for (i, _), v in ok.items():
        if i % 100 == 0:
            near = heapq.nsmallest(k, ((float(np.sqrt(((w - v) ** 2).sum())), j) for (j, _), w in ok.items() if j != i))
            out[i] = near
    return out


def test_multi_sequence_is_sorted_and_complete():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    pairs = list(q.multi_sequence(a, b))
    sums = [a[i] + b[j] for i, j in pairs]
    assert len(set(pairs)) == 63 and sums == sorted(sums)


def test_all_cells_give_the_exact_answer(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]  # one vector many times, two queries among them
    rows += [(1100, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), rows[3], rows[100]]
    rows += [(500, None), (600, []), (700, [0.0] * 6), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (901, [float("inf")] * 6), (902, [1.0, 2.0]), (None, [1.0] * 6)]
    rows = [(i, v) for i, v in rows]
    want = brute([r for r in rows if r[1] is None or len(r[1]) != 2])
    sf = table(spark, tmp_path, "embeddings", frame(spark, rows))
    for block in (4096, 7):
        monkeypatch.setattr(q, "BLOCK", block)
        index = q.Index(q.usable(spark.read.parquet(f"{sf}/embeddings.parquet")), 11, centroids=5)
        got = index.search(q.usable(spark.read.parquet(f"{sf}/embeddings.parquet")).where("vec_id % 100 = 0"), share=1.0).toPandas()
        assert set(got.query_id) == set(want)
        for i, near in want.items():
            mine = got[got.query_id == i].sort_values("rank")
            assert mine["rank"].tolist() == list(range(1, 11))
            assert mine.vec_id.tolist() == [j for _, j in near]
            assert np.allclose(mine.score, [d for d, _ in near], rtol=0, atol=1e-12)


def test_recall(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    pdf = pd.read_parquet(f"{sf}/embeddings.parquet")
    want = brute(list(zip(pdf.vec_id.tolist(), [v.tolist() for v in pdf.embedding])))
    got = q.op4_nearest_neighbours(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    assert len(got) == len(want)
    assert np.mean([len(got[i] & {j for _, j in near}) / len(near) for i, near in want.items()]) >= 0.9


def test_few_or_no_rows(spark, tmp_path):
    sf = table(spark, tmp_path, "embeddings", frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]))
    assert [(r.query_id, r["rank"], r.vec_id) for r in q.op4_nearest_neighbours(spark, sf).collect()] == [(0, 1, 1)]
    sf = table(spark, tmp_path, "embeddings", frame(spark, []))
    assert q.op4_nearest_neighbours(spark, sf).count() == 0


def test_clustered_vectors_need_a_small_share(spark):
    """Recall at several shares: with clusters a fifth of the cells is enough."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 4
    x = np.float32(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)))
    rows = q.usable(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    index, asked = q.Index(rows, 11), rows.where("vec_id % 100 = 0")
    want = {i: set(np.argsort(((x - x[i]).astype(float) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for i in range(0, 6000, 100)}
    recall = {}
    for share in (0.02, 0.2):
        got = index.search(asked, share=share).toPandas().groupby("query_id").vec_id.apply(set)
        recall[share] = np.mean([len(got[i] & w) / 10 for i, w in want.items()])
    assert recall[0.2] >= 0.95 and recall[0.02] > 0.5, recall
