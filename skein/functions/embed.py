"""The hash embedder: words and trigrams hashed into a fixed number of dimensions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import NO_TOKEN
from skein.functions.vector import DIMENSIONS, TRIGRAM_WEIGHT, fnv1a_py, fnv1a_rows
from skein.sources.batches import slices
from skein.sources.clients import EmbeddingClient

_not_word = re.compile(NO_TOKEN)
LONG = 64  # longer words are hashed one by one
TEXTS = 128  # texts whose words are hashed together
CHARS = 200_000  # and about their characters: a task holds some 100 bytes of numbers for each


def runs(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of at most TEXTS texts with at most CHARS characters, one text at least."""
    lo = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if i > lo and (i - lo >= TEXTS or chars > CHARS):
            yield slice(lo, i)
            lo, chars = i, len(t or "")
    if lo < len(texts):
        yield slice(lo, len(texts))


class HashEmbedder:
    """Embeds texts; ``dtype`` float32 adds up in single precision, float64 in double.

    The distinct words of some texts are hashed together, all their trigrams with them; sums run in the order of the words.
    """

    def __init__(self, dimensions: int = DIMENSIONS, dtype: type = np.float64):
        self.dimensions, self.dtype = dimensions, dtype

    def _hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number of hashes of each word): every word's own hash, then those of its trigrams from left to right."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = 1 + np.maximum(sizes - 2, 0)
        starts, out = np.cumsum(counts) - counts, np.empty(counts.sum(), np.int64)
        for k in np.flatnonzero(sizes > LONG).tolist():
            w = words[k]
            out[starts[k] : starts[k] + counts[k]] = [fnv1a_py(w), *(fnv1a_py(w[i : i + 3]) for i in range(len(w) - 2))]
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            most = int(sizes[short].max())
            codes = np.array([words[k] for k in short], f"<U{most}").view(np.uint32).reshape(-1, most).astype(np.uint64)
            out[starts[short]] = fnv1a_rows(codes, sizes[short])
            for i in range(most - 2):
                has = sizes[short] > i + 2
                out[starts[short[has]] + 1 + i] = fnv1a_rows(codes[has, i : i + 3], np.full(has.sum(), 3))
        return out, counts

    def parts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, dimension, signed weight) of every word and trigram of some texts, in their order."""
        number: dict[str, int] = {}
        rows = [[number.setdefault(w, len(number)) for w in _not_word.split((t or "").lower()) if w] for t in texts]
        hashes, counts = self._hashes(list(number))
        starts = np.cumsum(counts) - counts
        signs = np.where(hashes > 0, TRIGRAM_WEIGHT, -TRIGRAM_WEIGHT)
        signs[starts] = np.where(hashes[starts] > 0, 1.0, -1.0)
        sizes = np.array([len(r) for r in rows], np.int64)
        words = np.fromiter((w for r in rows for w in r), np.int64, sizes.sum())
        places = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        times = counts[words] if len(words) else words
        at = np.repeat(starts[words] - (np.cumsum(times) - times), times) + np.arange(times.sum()) if len(words) else words
        weight = np.repeat(1 / np.sqrt(places + 1), times)
        return np.repeat(np.repeat(np.arange(len(texts)), sizes), times), np.abs(hashes[at]) % self.dimensions, signs[at] * weight

    def matrix(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(unit vectors with components rounded to 6 digits, whether a component was touched); zeros for a text without words."""
        row, dim, value = self.parts(texts)
        flat, size = row * self.dimensions + dim, len(texts) * self.dimensions
        if self.dtype is np.float64:
            v = np.bincount(flat, value, size)
        else:
            v = np.zeros(size, self.dtype)
            np.add.at(v, flat, value.astype(self.dtype))
        v = v.astype(np.float64).reshape(len(texts), -1)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.round(v / np.where(n == 0, 1.0, n), 6), np.bincount(flat, minlength=size).reshape(len(texts), -1) > 0

    def __call__(self, text: str | None) -> np.ndarray:
        """The vector of one text."""
        return self.matrix([text])[0][0]


def embed(texts: DataFrame, text: str = "text", out: str = "vector", dtype: type = np.float64) -> DataFrame:
    """``texts`` with the embedding of a text column added."""

    from pyspark.sql import types as T

    names = texts.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = HashEmbedder(dtype=dtype)
        for part in slices(batches, TEXTS):
            # Only the text becomes Python objects; the other columns pass as they came.
            column = part.column(names.index(text))
            for at in runs(column.to_pylist()):
                few = part.slice(at.start, at.stop - at.start)
                v = e.matrix(column.slice(at.start, at.stop - at.start).to_pylist())[0]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*few.columns, flat], names=[*names, out])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def embed_remote(texts: DataFrame, client: EmbeddingClient, text: str = "text", out: str = "vector", parallel: int | None = None) -> DataFrame:
    """``texts`` with ``out``, ``embedded_by`` (``client`` or ``hash``) and ``embed_error``: one call a row, and the hash embedding where it fails.

    A blank text gets zeros without a call. An answer is scaled to length one, its components rounded to 6 digits.
    ``parallel`` sets how many tasks, and so calls, run at a time.
    """
    from pyspark.sql import types as T

    more = [T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField("embedded_by", T.StringType()), T.StructField("embed_error", T.StringType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = HashEmbedder()
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                plain = (t or "").strip()
                made, by, error = None, "hash", None
                if plain:
                    try:
                        v = np.asarray(client.embed(plain), np.float64)
                        if not v.size or not np.isfinite(v).all():
                            raise ValueError("no vector in the answer")
                        made, by = np.round(v / (np.sqrt((v * v).sum()) or 1.0), 6), "client"
                    except Exception as failed:  # whatever a client raises is the row's error
                        error = f"{type(failed).__name__}: {failed}"
                rows.append((e(plain) if made is None else made, by, error))
            yield pdf.assign(**{f.name: [r[k] for r in rows] for k, f in enumerate(more)})

    dealt = texts.repartition(parallel) if parallel else texts
    return dealt.mapInPandas(run, T.StructType([*texts.schema.fields, *more]))


def embedding_rows(texts: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """key, dim, val: the components of the embedding that a word or trigram touched. Nothing is shuffled."""
    kind = texts.schema[key].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = HashEmbedder(dimensions)
        for few in slices(batches, TEXTS):
            for at in runs(few.column("text").to_pylist()):
                part = few.slice(at.start, at.stop - at.start)
                v, touched = e.matrix(part.column("text").to_pylist())
                row, dim = np.nonzero(touched)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(dim, pa.int32()), pa.array(v[row, dim] + 0.0)], names=["key", "dim", "val"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, dim int, val double").withColumnRenamed("key", key)
