"""Exact nearest neighbours, upserts and index statistics over vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions import vector as V
from skein.functions.embed import embed, embed_remote
from skein.sources.batches import slices
from skein.sources.clients import EmbeddingClient
from skein.sources.tables import settled

QUERY_BLOCK = 2048
CORPUS_BLOCK = 8192
AT_ONCE = 128  # queries whose products stand in memory together


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _best(q_ids: list, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, scores) -> Iterator[tuple]:
    """(query, ids, columns) of the k best rows of ``v`` for each query: smallest key first, ties to the smaller id."""
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    for lo in range(0, len(q), AT_ONCE):
        key, columns = scores(q[lo : lo + AT_ONCE], v)
        for i, query in enumerate(q_ids[lo : lo + AT_ONCE]):
            few = np.flatnonzero(key[i] <= np.partition(key[i], k - 1)[k - 1]) if len(ids) > k else np.arange(len(ids))
            top = few[np.lexsort((place[few], key[i][few]))[:k]]
            yield query, top, [m[i, top] for m in columns]


def _frame(found: list[tuple], best: list[str]) -> pd.DataFrame:
    """(query, ids, columns) as rows q_id, id and the columns."""
    if not found:
        return pd.DataFrame({"q_id": pd.Series([], dtype=object), "id": pd.Series([], dtype=object), **{b: np.empty(0) for b in best}})
    q_ids = pd.Series([q for q, _, _ in found]).repeat([len(ids) for _, ids, _ in found])
    columns = {b: np.concatenate([c[j] for _, _, c in found]) for j, b in enumerate(best)}
    return pd.DataFrame({"q_id": q_ids.to_numpy(), "id": np.concatenate([i for _, i, _ in found]), **columns})


def _blockwise(corpus: DataFrame, queries: DataFrame, k: int, scores, best: list[str], worst_first: bool, stack=None) -> DataFrame:
    """Top k for each query: q_id, rank, id and the columns ``best``. ``scores(q, v)`` gives (value to sort by ascending, columns).

    Up to QUERY_BLOCK queries are broadcast, and each task keeps k rows a query of the corpus rows it reads: the corpus is not
    shuffled. More queries meet the corpus in pairs of blocks of bounded size, each in a task of its own; k rows a query and
    block leave it. That shuffles the corpus once for each query block, the price of an exact answer.
    """
    stack = stack or (lambda c: np.stack(c.to_list()))
    q_kind, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "q_id"), (corpus, "id")))
    schema = f"q_id {q_kind}, id {kind}, " + ", ".join(f"{b} double" for b in best)

    asked = queries.select("q_id", "q").limit(QUERY_BLOCK + 1).toPandas()
    if len(asked) <= QUERY_BLOCK:
        shared = corpus.sparkSession.sparkContext.broadcast((asked.q_id.tolist(), np.stack(asked.q.to_list()) if len(asked) else np.zeros((0, 1))))

        def scan(batches: Iterator) -> Iterator:
            import pyarrow as pa

            (q_ids, q), kept = shared.value, {}
            # Few queries need no large blocks to keep numpy busy.
            for part in slices(batches, CORPUS_BLOCK if len(q) > AT_ONCE else CORPUS_BLOCK // 8):
                if len(q):
                    ids, v = part.column(0).to_pandas().to_numpy(), stack(part.column(1).to_pandas())
                    for n, (_, top, columns) in enumerate(_best(q_ids, q, ids, v, k, scores)):
                        kept[n] = _merged(kept.get(n), ids[top], columns, k, -1 if worst_first else 1)
            made = _frame([(q_ids[n], *kept[n]) for n in kept], best)
            yield pa.RecordBatch.from_pandas(made, schema=made_schema, preserve_index=False)

        made_schema = to_arrow_schema(T.StructType([T.StructField("q_id", queries.schema["q_id"].dataType), T.StructField("id", corpus.schema["id"].dataType), *(T.StructField(b, T.DoubleType()) for b in best)]))
        found = corpus.select("id", "v").mapInArrow(scan, schema)
    else:
        nq, nc = _blocks(queries.count(), QUERY_BLOCK), _blocks(corpus.count(), CORPUS_BLOCK)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = queries.select("q_id", "q", one("q_id", nq).alias("qb"), each(nc).alias("cb"))
        right = corpus.select("id", "v", each(nq).alias("qb"), one("id", nc).alias("cb"))

        def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return _frame([], best)
            ids = c.id.to_numpy()
            found = _best(q.q_id.tolist(), np.stack(q.q.to_list()), ids, stack(c.v), k, scores)
            return _frame([(query, ids[top], columns) for query, top, columns in found], best)

        found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(compare, schema)
    first = F.desc(best[-1]) if worst_first else F.col(best[-1])
    order = Window.partitionBy("q_id").orderBy(first, "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "rank", "id", *best)


def _merged(before: tuple | None, ids: np.ndarray, columns: list[np.ndarray], k: int, sign: int) -> tuple:
    """The k best of what a task has kept for a query and what one more block gives; the last column decides."""
    if before is not None:
        ids, columns = np.concatenate([before[0], ids]), [np.concatenate(pair) for pair in zip(before[1], columns)]
    top = np.lexsort((np.argsort(np.argsort(ids, kind="stable")), sign * columns[-1]))[:k]
    return ids[top], [c[top] for c in columns]


def _cosines(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None]
    sim = np.clip(np.round(np.divide(q @ v.T, n, out=np.zeros(n.shape), where=n > 0), 4), -1, 1)
    distance = np.round(np.maximum(0, 1 - sim), 4)
    return distance, [np.clip(np.round(1 - distance, 4), 0, 1), distance]


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """q_id, rank, id, similarity, distance: the k nearest of ``corpus(id, v)`` to ``queries(q_id, q)`` by cosine.

    Distance is 1 - cosine, rounded to 4 digits; ties go to the smaller id. Vectors have one length; ids are numbers or text.
    """
    return _blockwise(corpus, queries, k, _cosines, ["similarity", "distance"], False)


def _centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of the directions in ``x``, at most ``cells``; the same for the same rows."""
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    centres = x[np.random.default_rng(0).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + CORPUS_BLOCK] @ centres.T).argmax(1) for i in range(0, len(x), CORPUS_BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def approximate_knn(corpus: DataFrame, queries: DataFrame, k: int = 5, probes: int = 8, sample_rows: int = 20_000) -> DataFrame:
    """The same columns as ``knn``, over part of the corpus: for many queries against a large corpus.

    The corpus is dealt into about the root of its size of cells by direction (at most 4,096), each query looks into its ``probes``
    nearest cells, and into more until they hold k rows. So work and shuffle are about probes / cells of the exact plan's. The centres
    are fitted on at most ``sample_rows`` rows, those with the smallest hash; every row is in a cell, and large cells are cut into blocks.
    Distances are exact, recall depends on ``probes``: all cells give the exact answer.
    """
    spark = corpus.sparkSession
    sample = corpus.select("v").orderBy(F.xxhash64("v")).limit(sample_rows).toPandas()
    if not len(sample):
        return knn(corpus, queries, k)
    cells = int(min(4096, max(1, corpus.count() ** 0.5)))
    centres = spark.sparkContext.broadcast(_centres(np.stack(sample.v.to_list()), cells))
    kind, q_kind = corpus.schema["id"].dataType.simpleString(), queries.schema["q_id"].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=(np.stack(pdf.v.to_list()) @ centres.value.T).argmax(1).astype(np.int32))

    dealt = settled(corpus.select("id", "v").mapInPandas(deal, f"id {kind}, v array<double>, cell int"), "cells")
    counts = {r.cell: r.n for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most 4,096
    held = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q in pdf.q:
                taken, seen = [], 0
                for cell in np.argsort(-(centres.value @ np.asarray(q)), kind="stable").tolist():
                    if len(taken) >= probes and seen >= k:
                        break
                    if n := held.value.get(cell, 0):
                        taken.append(cell)
                        seen += n
                rows.append(taken)
            yield pdf.assign(cells=rows)

    plan = F.broadcast(spark.createDataFrame([(c, -(-n // CORPUS_BLOCK)) for c, n in counts.items()], "cell int, parts int"))
    asked = queries.select("q_id", "q").mapInPandas(probe, f"q_id {q_kind}, q array<double>, cells array<int>")
    asked = asked.select("q_id", "q", F.explode("cells").alias("cell")).join(plan, "cell")
    # Queries of one cell are cut into blocks as well; each pair of blocks is a group of its own.
    load = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("ask_parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asked.join(load, "cell").select("cell", every("parts").alias("part"), one("q_id", "ask_parts").alias("ask_part"), "q_id", "q")
    right = dealt.join(plan, "cell").join(load, "cell").select("cell", one("id", "parts").alias("part"), every("ask_parts").alias("ask_part"), "id", "v")
    best = ["similarity", "distance"]

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return _frame([], best)
        ids = c.id.to_numpy()
        found = _best(q.q_id.tolist(), np.stack(q.q.to_list()), ids, np.stack(c.v.to_list()), k, _cosines)
        return _frame([(query, ids[top], columns) for query, top, columns in found], best)

    keys = ["cell", "part", "ask_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"q_id {q_kind}, id {kind}, similarity double, distance double")
    order = Window.partitionBy("q_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "rank", "id", *best)


def quantized(vectors: DataFrame) -> DataFrame:
    """id, v: codes and residual bits of ``vectors(id, v)``, in 9/8 bytes a component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, codes, bits = V.quantize(np.stack(pdf.v.to_list()))
                yield pd.DataFrame({"id": pdf.id, "v": V.pack_codes(codes, bits)})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInPandas(run, f"id {kind}, v binary")


def quantized_search(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """q_id, rank, id, score: the k highest estimated products over quantised vectors, queries as given. Each row is quantised once."""
    import types

    def scores(q: np.ndarray, v) -> tuple[np.ndarray, list[np.ndarray]]:
        s = V.estimate(q, *V.unpack_codes(v.rows, q.shape[1]))
        return -s, [s]

    return _blockwise(quantized(corpus), queries, k, scores, ["score"], True, lambda c: types.SimpleNamespace(rows=c.to_list()))


def insert(index: DataFrame, rows: DataFrame, client: EmbeddingClient | None = None) -> DataFrame:
    """``index(id, text, vector)`` with ``rows(id, seq, text)`` embedded and put in; an id that is there already is replaced.

    Of several rows with one id the last by ``seq`` counts. Without a client the hash embedder makes the vectors.
    """
    last = upsert_latest(rows, "id", "seq", "text").select("id", "text")
    new = embed(last) if client is None else embed_remote(last, client)
    return index.join(last.select("id"), "id", "left_anti").unionByName(new.select("id", "text", "vector"))


def compress(vectors: DataFrame, dimensions: int) -> DataFrame:
    """id, data, residual_bits, norm, original_kb, compressed_kb, ratio for ``vectors(id, v)``.

    Codes take four bits, the even place in the high half of a byte, in base64; residual signs are a string of 0 and 1.
    """
    import base64

    size = dimensions * 4, dimensions // 2 + dimensions // 8

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            norms, codes, bits = V.quantize(np.array([V.fit(v, dimensions) for v in pdf.v]))
            half = (codes + 8).astype(np.uint8)
            packed = (half[:, 0::2] << 4) | np.pad(half[:, 1::2], ((0, 0), (0, dimensions % 2)))
            yield pd.DataFrame({
                "id": pdf.id,
                "data": [base64.b64encode(p.tobytes()).decode() for p in packed],
                "residual_bits": ["".join("01"[int(b)] for b in row) for row in bits],
                "norm": np.round(norms, 6),
            })

    made = vectors.select("id", "v").mapInPandas(run, "id long, data string, residual_bits string, norm double")
    kb = lambda b: F.round(F.lit(b / 1024), 2)
    ratio = F.format_string("%.1fx", F.lit(size[0] / size[1]))
    return made.select("*", kb(size[0]).alias("original_kb"), kb(size[1]).alias("compressed_kb"), ratio.alias("ratio"))


def upsert_latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last row by ``order`` for each key (ties: the largest values). One aggregate that combines before it shuffles."""
    last = F.max(F.struct(order, *values)).alias("x")
    return rows.groupBy(key).agg(last).select(key, f"x.{order}", *(f"x.{v}" for v in values))


def index_level(key: Column) -> Column:
    """A level 0 to 5 for a key, with the odds of 1 to 16 a step, drawn from its MD5 hash."""
    u = (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return F.least(F.lit(5), F.floor(-F.ln(u) / F.ln(F.lit(16.0)))).cast("int")


def level_counts(keys: DataFrame, key: str) -> DataFrame:
    """layer, node_count: a key is in every layer up to its level."""
    layers = keys.select(F.explode(F.sequence(F.lit(0), index_level(F.col(key)))).alias("layer"))
    return layers.groupBy("layer").agg(F.count("*").alias("node_count"))
