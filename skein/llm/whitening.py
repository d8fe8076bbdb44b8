"""Embedding whitening by hierarchical SVD merging.

A summary of some vectors is their number, their sums, and the right singular vectors of the centred vectors scaled by the
singular values, all of them: a square matrix at most. Each task sums up what it reads, batch by batch; summaries are merged FAN at a
time, in rounds, until one is left. A merge stacks both matrices and one row more, the difference of the means times
the root of n1 n2 / (n1 + n2), and decomposes again: the scatter of all vectors about their common mean, with nothing lost.

Entries c become whole numbers x = floor(64 c) + 1000000, so sums are exact and a mean never loses digits to its size.

Cases: vectors that are null, empty, or hold null, non-finite or huge entries (over 2**40) take no part and have no row; of vectors of
several lengths the most common one (ties: the longest) is fitted and returned; null ids and repeated rows each get their rows; a component
without spread (an eigenvalue below 1e-12 of the largest) has null in place of a whitened value; a deviation that does not fit into 64 bits is
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, read_table, tidy, written

COMPONENTS = 32
FAN = 16  # summaries that one task merges
ROWS = 2048  # vectors that are decomposed at once
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)
NO_SPREAD = 1e-12
_SUMMARY = "part long, n long, sums array<double>, wholes array<string>, scatter array<double>"


class Summary:
    """Number, sums (exact where the vectors are whole numbers) and scaled right singular vectors of some vectors."""

    def __init__(self, n: int, sums: list, scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        sums = [int(s) for s in x.sum(0)] if x.dtype == np.int64 else x.sum(0).tolist()
        # n x - sum is exact for whole numbers: no digits are lost to a large mean.
        centred = (x * len(x) - np.array(sums, x.dtype)) / len(x)
        return cls(len(x), sums, _squared_up(centred))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)], np.float64)
        stacked = np.vstack([self.scatter, other.scatter, apart * np.sqrt(self.n * (other.n / n))])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], _squared_up(stacked))


def _squared_up(rows: np.ndarray) -> np.ndarray:
    """Right singular vectors times singular values: as many rows as columns at most, with the same scatter."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _packed(part: int, s: Summary) -> pd.DataFrame:
    whole = all(isinstance(x, int) for x in s.sums)
    return pd.DataFrame({"part": [part], "n": [s.n], "sums": [[float(x) for x in s.sums]], "wholes": [[str(x) for x in s.sums] if whole else []], "scatter": [s.scatter.ravel()]})


def _opened(row) -> Summary:
    sums = [int(x) for x in row.wholes] or [float(x) for x in row.sums]
    return Summary(int(row.n), sums, np.asarray(row.scatter, np.float64).reshape(-1, len(sums)))


def _summed(vectors, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One summary of all vectors that a task reads."""
    from pyspark import TaskContext

    found = None
    for pdf in batches:
        for lo in range(0, len(pdf), ROWS):
            x = vectors(np.stack(pdf["x"].iloc[lo : lo + ROWS].to_list()))
            part = Summary.of(x)
            found = part if found is None else found.merged(part)
        del pdf
        tidy()
    if found is not None:
        yield _packed(TaskContext.get().partitionId(), found)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(pdf.itertuples(), key=lambda r: r.part)
    found = _opened(rows[0])
    for row in rows[1:]:
        found = found.merged(_opened(row))
    return _packed(int(rows[0].part) // FAN, found)


def _whole(x: np.ndarray) -> np.ndarray:
    return x


def summary(vectors: DataFrame, of=_whole) -> Summary | None:
    """The summary of all rows of vectors(x), or of what ``of`` makes of them: summaries of tasks, merged FAN at a time."""
    parts = written(vectors.select("x").mapInPandas(partial(_summed, of), _SUMMARY), "summaries")
    while parts.count() > 1:
        fewer = written(parts.groupBy(F.expr(f"part div {FAN}")).applyInPandas(_merged, _SUMMARY), "summaries")
        discard(parts)
        parts = fewer
    last = parts.collect()  # one row at most
    discard(parts)
    return _opened(last[0]) if last else None


class Whitener:
    """The unit eigenvectors of a summary's covariance by falling eigenvalue, and what they make of vectors."""

    def __init__(self, fitted: Summary, components: int = COMPONENTS):
        self.n, self.sums = fitted.n, np.array(fitted.sums, object)
        _, s, v = np.linalg.svd(fitted.scatter, full_matrices=True)
        e = np.zeros(len(v))
        e[: len(s)] = s * s / fitted.n
        self.trace = float(e.sum())
        k = min(components, len(e))
        self.values, self.axes = e[:k], v[:k]
        self.spread = self.values > NO_SPREAD * max(e[0], 1e-300)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sum, exact."""
        if float(np.abs(x).max(initial=0)) * self.n < 2.0**62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; components without spread give 0."""
        along = (self.deviations(x) / self.n).astype(np.float64) @ self.axes.T
        return np.divide(along, np.sqrt(self.values), out=np.zeros_like(along), where=self.spread)


def whole_numbers(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """vec_id, x: the vectors that take part, as whole numbers floor(64 c) + 1000000."""
    c = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    sound = c.where((F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST)))
    lengths = sound.groupBy(F.size("c").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return sound.where(F.size("c") == (lengths.length if lengths else 0)).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null beyond 64 bits."""
    if d.dtype == np.int64 and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in d.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def whitened(rows: DataFrame, id: str, vector: str, components: int = COMPONENTS) -> tuple[DataFrame, Whitener | None, float | None]:
    """(vec_id, deviation, whitened array<double> of each row that takes part; the whitener; identity error).

    The error is the largest absolute entry of the whitened vectors' covariance minus the identity, measured on what the
    whitener returns, over components with spread.
    """
    x = whole_numbers(rows, id, vector)
    fitted = summary(x)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, deviation long, whitened array<double>"), None, None
    made = Whitener(fitted, components)
    measured = summary(x, made)
    error = float(np.abs((measured.scatter.T @ measured.scatter / measured.n - np.eye(len(made.values)))[made.spread][:, made.spread]).max(initial=0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), ROWS):
                part = pdf.iloc[lo : lo + ROWS]
                v = np.stack(part["x"].to_list())
                values = made(v)
                values = list(values) if made.spread.all() else [[y if ok else None for y, ok in zip(row, made.spread)] for row in values.tolist()]
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "deviation": pd.array(_squares(made.deviations(v)), "Int64"), "whitened": values})

    return x.mapInPandas(run, "vec_id long, deviation long, whitened array<double>"), made, error


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """One row for each vector and component: whitened value, explained share, and how near the covariance is to the identity."""
    out, made, error = whitened(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    shares = [] if made is None else [float(e / made.trace) if made.trace else 0.0 for e in made.values]
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at") + 1)
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(made.n if made else 0).cast("long").alias("n"), "deviation",
        "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
