"""Approximate nearest neighbours with an inverted multi-index.

Each vector's two halves are quantised with a codebook of their own (k-means); the pair of codes is
the vector's cell. For a query the pairs of centroids are traversed in order of summed squared
distance with a heap (multi-sequence order), until the cells met hold at least ``share`` of the
entries.
Their vectors are re-ranked by the exact Euclidean distance of the original vectors in double precision.

``share`` trades work for recall. The default suits vectors without clusters, whose tenth neighbour is hardly
nearer than the rest: recall 0.9 needs about half of the cells there. Clustered vectors need far less.

Bounds: the codebooks are fitted on at most ``sample_rows`` distinct vectors, those with the smallest
hash; every vector is indexed. Codebooks have about 2 * n ** 0.25 centroids (32 to 1,024), so a cell holds
about the root of n; one count for each cell is broadcast.

Equal vectors are one index entry that carries their k + 1 smallest ids: no answer needs more. A query travels once to
each row of cells (one left code) that it visits, with the right codes it wants there. Rows of cells with many vectors or
queries are cut into blocks, and each pair of blocks is compared on its own; only its k best a query leave it.

Cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, neither as queries nor as candidates; rows that repeat an id and its vector
are one row; a query is never its own neighbour; equal distances go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import discard, read_table, written

K = 10
SHARE = 0.6
SAMPLE_ROWS = 20_000
BLOCK = 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``, at most ``k``; the same for the same rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, centres)
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows of ``x`` by centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def multi_sequence(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of codes by ascending left + right distance, generated with a heap."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for p, r in ((i + 1, j), (i, j + 1)):
            if p < len(a) and r < len(b) and (p, r) not in seen:
                seen.add((p, r))
                heapq.heappush(heap, (left[a[p]] + right[b[r]], p, r))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double): the rows that take part, each once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    # One row for each length that occurs.
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0)).dropDuplicates(["vec_id", "v"])


class Index:
    """Codebooks of both halves, the counts of their cells, and the entries by cell."""

    def __init__(self, rows: DataFrame, keep_ids: int, sample_rows: int = SAMPLE_ROWS, centroids: int | None = None):
        spark = rows.sparkSession
        # Partial limits run before the shuffle, so a very common vector sends a few rows a task.
        order = Window.partitionBy("v").orderBy("vec_id")
        few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep_ids)
        entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        entries = written(entries, "vectors")
        sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).toPandas()
        self.n = entries.count()
        x = np.stack(sample.v.to_list()) if len(sample) else np.zeros((1, 2))
        half = x.shape[1] // 2
        k = centroids or int(min(1024, max(32, 2 * self.n**0.25)))
        self.left, self.right, self.half = kmeans(x[:, :half], k), kmeans(x[:, half:], k, seed=1), half
        books = spark.sparkContext.broadcast((self.left, self.right, half))  # at most 1,024 centroids each

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left, right, half = books.value
            for pdf in batches:
                if len(pdf):
                    v = np.stack(pdf.v.to_list())
                    yield pdf.assign(left=nearest(v[:, :half], left), right=nearest(v[:, half:], right))

        self.books = books
        self.entries = written(entries.mapInPandas(code, "v array<double>, ids array<long>, left int, right int"), "cells")
        discard(entries)
        # One count for each of at most centroids ** 2 cells.
        self.counts = {(r.left, r.right): r.n for r in self.entries.groupBy("left", "right").agg(F.count("*").alias("n")).collect()}

    def search(self, queries: DataFrame, k: int = K, share: float = SHARE) -> DataFrame:
        """query_id, rank, vec_id, score for ``queries(vec_id, v)``."""
        spark, books = queries.sparkSession, self.books
        counts, candidates = spark.sparkContext.broadcast(self.counts), int(np.ceil(share * self.n))

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (left, right, half), sizes = books.value, counts.value
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.stack(pdf.v.to_list())
                d_left, d_right = distances(v[:, :half], left), distances(v[:, half:], right)
                for i, (query, vector) in enumerate(zip(pdf.vec_id, pdf.v)):
                    rows, got = {}, 0
                    for a, b in multi_sequence(d_left[i], d_right[i]):
                        if n := sizes.get((a, b), 0):
                            rows.setdefault(a, []).append(b)
                            got += n
                            if got >= candidates:
                                break
                    yield pd.DataFrame({"query_id": query, "q": [vector] * len(rows), "left": np.array(list(rows), np.int32), "rights": list(rows.values())})

        # A query goes to each row of cells (one left code) that it visits once, with the right codes it wants there.
        asked = written(queries.mapInPandas(visit, "query_id long, q array<double>, left int, rights array<int>"), "visits")
        loads = self.entries.groupBy("left").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        asks = asked.groupBy("left").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ask_parts"))
        plan = F.broadcast(loads.join(asks, "left"))  # one row for each left code
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        stored = self.entries.join(plan, "left").select("left", one("v", "parts").alias("part"), every("ask_parts").alias("ask_part"), "right", "v", "ids")
        wanted = asked.join(plan, "left").select("left", every("parts").alias("part"), one("query_id", "ask_parts").alias("ask_part"), "query_id", "q", "rights")

        def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], "vec_id": [], "score": []}
            if len(asked) and len(held):
                held = held.sort_values("right", kind="stable")
                v, codes, ids = np.stack(held.v.to_list()), held.right.to_numpy(), held.ids.to_list()
                sizes = np.array([len(x) for x in ids])
                flat, first = np.concatenate(ids), np.cumsum(sizes) - sizes
                for query, q, rights in zip(asked.query_id, asked.q, asked.rights):
                    rows = np.flatnonzero(np.isin(codes, rights))
                    d = np.sqrt(((v[rows] - q) ** 2).sum(axis=1))
                    if len(d) > k + 1:
                        close = d <= np.partition(d, k)[k]
                        rows, d = rows[close], d[close]
                    times = sizes[rows]
                    at = np.repeat(first[rows] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    near, who = np.repeat(d, times), flat[at]
                    other = who != query
                    near, who = near[other], who[other]
                    best = np.lexsort((who, near))[:k]
                    out["query_id"].append(np.full(len(best), query))
                    out["vec_id"].append(who[best])
                    out["score"].append(near[best])
            return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        keys = ["left", "part", "ask_part"]
        found = wanted.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    rows = written(usable(read_table(spark, sf_dir, "embeddings")), "embeddings")
    index = Index(rows, K + 1)
    return index.search(rows.where("vec_id % 100 = 0"))
