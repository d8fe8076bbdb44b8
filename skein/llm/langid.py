"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from its code point, so any alphabet works).
A run of n letters is bound into one vector: the letters' vectors, rolled by n-1 .. 0 places, are
multiplied. A text is the bundle (sum) of its n-grams' vectors, a language the bundle of its texts
scaled to equal length; a text gets the language whose prototype has the largest cosine.

Texts become lower-case words of letters, each between blanks; n-grams do not span words' inner gaps
beyond that blank. Bundles are computed as (n-gram counts) x (n-gram vectors) for blocks of texts.

Cases: a null text or one without letters gets ``und`` with score 0; so does every text when nothing
can be learned. Rows without lang, text or letters teach nothing. Equal cosines go to the smaller
language name. Score: the cosine, clipped to 0..1. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import read_table

DIMENSIONS = 512
N = 3
SEED = 20240501
ROWS = 128
CHARS = 400_000
SLICE = 8192


@lru_cache(maxsize=1 << 16)  # more than an alphabet of Han letters in use
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random +1/-1 vector of a code point."""
    bits = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8)
    return bits * 2 - 1


def bind(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of n-grams; ``grams`` holds one row of code points for each."""
    n = grams.shape[1]
    codes, at = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c), dimensions) for c in codes])
    out = np.ones((len(grams), dimensions), np.int8)
    at = at.reshape(grams.shape)
    for k in range(n):
        out *= np.roll(letters, n - 1 - k, axis=1)[at[:, k]]
    return out


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams_of(text: str, n: int = N) -> np.ndarray:
    """The n-grams of a text as one int64 each (21 bits a letter)."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 32)[letter | np.concatenate([[True], letter[:-1]])].astype(np.int64)
    if len(codes) < n:
        return np.empty(0, np.int64)
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out = (out << 21) | codes[k : len(codes) - n + 1 + k]
    return out


class GramTable:
    """Float32 vectors of the n-grams met so far, at most ``rows`` of them; the rest are bound anew each time."""

    def __init__(self, n: int = N, dimensions: int = DIMENSIONS, rows: int = 20_000):
        self.n, self.dimensions, self.rows = n, dimensions, rows
        self.keys, self.at, self.made = np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.vectors = np.empty((rows, dimensions), np.float32)

    def _bind(self, keys: np.ndarray) -> np.ndarray:
        split = np.stack([(keys >> 21 * (self.n - 1 - k)) & 0x1FFFFF for k in range(self.n)], axis=1)
        return bind(split, self.dimensions)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct keys."""
        new = np.setdiff1d(keys, self.keys, assume_unique=True)[: self.rows - self.made]
        if len(new):
            self.vectors[self.made : self.made + len(new)] = self._bind(new)
            both, at = np.concatenate([self.keys, new]), np.concatenate([self.at, self.made + np.arange(len(new))])
            order = np.argsort(both)
            self.keys, self.at, self.made = both[order], at[order], self.made + len(new)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        out = self.vectors[self.at[place]]
        if not known.all():
            out[~known] = self._bind(keys[~known])
        return out


def bundles(texts: list[str], table: GramTable | None = None) -> np.ndarray:
    """One bundle for each text, float32; zero for a text without letters."""
    table = table or GramTable()
    grams = [grams_of(t, table.n) for t in texts]
    out = np.zeros((len(texts), table.dimensions), np.float32)
    keys, at = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.empty(0, np.int64), None)
    if not len(keys):
        return out
    rows = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    # Each (n-gram, text) that occurs, by n-gram; only a slice of the table texts x n-grams is ever dense.
    pairs, n = np.unique(at * len(texts) + rows, return_counts=True)
    gram, text = np.divmod(pairs, len(texts))
    for lo in range(0, len(keys), SLICE):
        some = slice(*np.searchsorted(gram, [lo, lo + SLICE]))
        counts = np.zeros((len(texts), min(SLICE, len(keys) - lo)), np.float32)
        counts[text[some], gram[some] - lo] = n[some]
        out += counts @ table(keys[lo : lo + SLICE])
    return out


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of at most ROWS texts and about CHARS letters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= ROWS or size + len(t) > CHARS):
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    table = GramTable()
    for pdf in batches:
        texts, langs = pdf.text.tolist(), pdf.lang.to_numpy()
        for part in _blocks(texts):
            # Rounded so that the sums below are exact whatever the order in which parts arrive.
            unit = np.rint(_unit(bundles(texts[part], table)) * 2**20).astype(np.int64)
            for lang in set(langs[part]):
                total[lang] = total.get(lang, 0) + unit[langs[part] == lang].sum(axis=0)
    for lang, v in total.items():
        yield pd.DataFrame({"lang": lang, "i": np.arange(len(v)), "v": v})


def prototypes(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes, from all rows of ``train(text, lang)``.

    Each task sums its rows into one vector a language; Spark adds those up, and a row for each
    language and dimension reaches the driver.
    """
    rows = train.select("text", "lang").dropna().mapInPandas(_learn, "lang string, i int, v long")
    got = rows.groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas().sort_values(["lang", "i"])
    got = {k: g.v.to_numpy(float) for k, g in got.groupby("lang")}
    langs = [k for k in sorted(got) if np.any(got[k])]
    return langs, _unit(np.stack([got[k] for k in langs])) if langs else np.empty((0, DIMENSIONS))


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, fold: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only ``text`` enters the prediction."""
    model = docs.sparkSession.sparkContext.broadcast((langs, profiles.astype(np.float32)))  # languages x dimensions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (langs, profiles), table = model.value, GramTable()
        for pdf in batches:
            texts = pdf.text.fillna("").tolist()
            best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for part in _blocks(texts):
                b = bundles(texts[part], table)
                some = np.any(b, axis=1)
                if langs and some.any():
                    cos = np.round((_unit(b) @ profiles.T).astype(float), 6)
                    top = cos.argmax(axis=1)
                    best[part] = np.where(some, np.array(langs, object)[top], "und")
                    score[part] = np.where(some, np.clip(cos.max(axis=1), 0, 1), 0)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "lang_pred": best, "score": score})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(fold: int = 5):
    """True where crc32 of the id as text leaves no remainder; null ids are held out of nothing and never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict for all."""
    docs = read_table(spark, sf_dir, "documents")
    langs, profiles = prototypes(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"))
    return predict(docs, langs, profiles)


def crc_fold(doc_id: int, fold: int = 5) -> bool:
    """The same rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % fold == 0
