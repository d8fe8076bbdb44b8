"""Passages of over 50 words that more than one document holds, whatever their bytes: by the triggers of ``repeats`` over words.

A window is ``WORDS`` words in a row, runs of bytes other than blanks, told apart by these bytes; how they are spaced does not count.
Its trigger is the word with the least hash of ``GRAM`` bytes among its first ``PLACES`` words (ties: the first), and the
``CONTEXT`` words from there on lie inside the window. Windows in a row with one trigger are a region, a phrase with what follows.

* A window that two documents hold has a context that two documents hold; other regions are dropped.
* A region whose whole bytes two documents hold is shared, at one go.
* The other regions are opened: their windows are counted by a 128-bit hash, together with those of one representative of each shared
  region of the same context, which stands for a document of its own (rid -1), as another document than the asked one holds it.

Contexts and windows are counted in packed rows (``recurring``). Regions that very many rows hold are a few rows of a count and meet their rows by a bounded broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, written
from skein.llm.recurring import PACKED, REGIONS, opened, opened_slices, packed, parts_for, recurring_places, recurring_ranges, region_rows, settled, slices_of, standing, text_slices, to_open, wide

WORDS = 51
GRAM = 16  # bytes of a word's hash, at most 9 words
PLACES = 32  # a power of two; PLACES + 8 and PLACES + CONTEXT - 1 are at most WORDS
CONTEXT = 20
SLICE = 1 << 20  # bytes of texts that are cut at once
PART = 1 << 23  # words whose least hashes are taken at once

_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def words(datas: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of all texts joined by single blanks; where each word begins, and the end beyond; each text's first word, and the end."""
    raw = np.frombuffer((b" ".join(datas) + b" ").translate(_BLANKS), np.uint8)
    blank = raw == 32
    before = np.concatenate([[True], blank[:-1]])
    begins = ~blank & before
    count = np.concatenate([[0], np.cumsum(begins)])
    firsts = count[np.cumsum([0, *(len(d) + 1 for d in datas)])]
    text = raw[~(blank & before)]
    starts = np.concatenate([[0], np.flatnonzero(text == 32) + 1])
    return text.tobytes(), starts, firsts


def word_triggers(text: bytes, starts: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The trigger of the window at each word, as far as there are ``places`` words."""
    n = len(starts) - places
    if n <= 0:
        return np.empty(0, np.int64)
    if n > PART:  # a place takes 24 bits below: in parts that overlap
        return np.concatenate([word_triggers(text, starts[lo : lo + PART + places], places) + lo for lo in range(0, n, PART)])
    padded = np.frombuffer(text + b" " * GRAM, np.uint8)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, GRAM)[starts[:-1]]).view("<u8")
    h = grams[:, 0] * _MIX[0]
    h = (h ^ (h >> np.uint64(29)) ^ grams[:, 1]) * _MIX[1]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    low = np.uint64((1 << 24) - 1)
    h = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < places:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return (h & low).astype(np.int64)


def word_regions(datas: list[bytes]) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, where they begin, each text's first one; and first window, last window and trigger, by number of word, of all regions."""
    text, starts, firsts = words(datas)
    of = np.repeat(np.arange(len(datas)), np.diff(firsts))
    at = np.flatnonzero(of[: len(of) - WORDS + 1] == of[WORDS - 1 :]) if len(of) >= WORDS else np.empty(0, np.int64)
    trigger = word_triggers(text, starts)[at] if len(at) else at
    cut = np.flatnonzero((trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])[: len(at)]
    return memoryview(text), starts, firsts, at[first], at[np.append(cut - 1, len(at) - 1)[: len(at)]], trigger[first]


def _hashes(view: memoryview, starts: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """64-bit hashes of the contexts; used to prune only."""
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[trigger].tolist(), (starts[trigger + CONTEXT] - 1).tolist())], np.uint64)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in slices of about SLICE bytes."""
    return slices_of([batch], lambda b: b.column("size").to_numpy().astype(np.int64), SLICE)


def _contexts(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        base, keys, owner, at = 0, [], [], []
        for part in _cut(batch):
            view, starts, firsts, lo, _, trigger = word_regions(part.column("data").to_pylist())
            of = np.searchsorted(firsts, lo, side="right") - 1
            keys.append(_hashes(view, starts, trigger))
            owner.append(of + base)
            at.append(np.arange(len(of)) - np.searchsorted(of, of))
            base += part.num_rows
        keys = np.concatenate(keys).reshape(-1, 1)
        yield packed(parts, batch.column("rid").to_numpy(), keys, np.concatenate(owner), np.concatenate(at), np.zeros(len(keys), bool), True)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _cut(batch):
            view, starts, firsts, lo, hi, trigger = word_regions(part.column("data").to_pylist())
            again = [np.frombuffer(p, "<u4").astype(np.int64) for p in part.column("places").to_pylist()]
            keep = np.concatenate([a + n for a, n in zip(again, np.searchsorted(lo, firsts[:-1]).tolist())])
            lo, hi, trigger = lo[keep], hi[keep], trigger[keep]
            of = np.repeat(np.arange(part.num_rows), list(map(len, again)))
            digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[lo].tolist(), (starts[hi + WORDS] - 1).tolist())]
            yield region_rows(part.column("rid").to_numpy()[of], lo - firsts[of], hi - firsts[of], _hashes(view, starts, trigger), digests)


def _windows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in opened_slices(batches):
        owner, x, asked = opened(batch)
        digests, ends = [], np.searchsorted(owner, np.arange(batch.num_rows), side="right")
        for data, at in zip(batch.column("data").to_pylist(), np.split(x, ends[:-1])):
            text, starts, _ = words([data])
            view = memoryview(text)
            digests += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[at].tolist(), (starts[at + WORDS] - 1).tolist())]
        yield packed(parts, batch.column("rid").to_numpy(), wide(digests), owner, x, ~asked, True)


def shared_windows(kept: DataFrame) -> DataFrame:
    """(rid, lo, hi): the windows, by number of word, that another row of ``kept(rid, data)`` holds too. No rid is negative."""
    enough = kept.select("rid", "data", "size").where(F.col("size") >= 2 * WORDS - 1)
    parts = parts_for(kept, kept.agg(F.sum(F.col("size") / PLACES)).first()[0])
    survivors = written(recurring_places(enough.mapInArrow(partial(_contexts, parts), PACKED), parts, 1, True), "survivors")
    parts = written(enough.join(survivors.hint("shuffle_hash"), "rid").mapInArrow(_regions, REGIONS), "regions")
    discard(survivors)
    classes = parts.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.max("rid").alias("other"), *standing()).where("one < other")
    classes = written(classes.drop("other"), "named")
    done = written(settled(parts, classes), "classes")
    discard(parts, classes)
    asked = done.where("not again")
    ones = done.where("again and first").join(asked.select("h").distinct(), "h", "left_semi")
    todo = written(to_open(asked, ones), "open")
    parts = parts_for(kept, todo.agg(F.sum("n")).first()[0])
    windows = kept.select("rid", "data").join(todo.hint("shuffle_hash"), "rid").mapInArrow(partial(_windows, parts), PACKED)
    single = recurring_ranges(windows, parts, 2, True)
    starts = written(done.where("again").select("rid", "lo", "hi").unionByName(single), "shared")
    discard(done, todo)
    return starts
