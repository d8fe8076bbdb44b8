"""Suffix-array dedup of long repeated strings by prefix-free parsing.

A window is a string of ``length`` bytes. Every byte covered by a window that also starts anywhere
else in the corpus is removed. Prefix-free parsing makes this a job on phrases, not on bytes:

* Triggers. A window's trigger is the place of the least rolling hash among its first ``PLACES`` places (ties: the first).
  It depends on the window's own bytes only, so equal windows have it at the same place, and every window has
  one, periodic text included. Phrases run from trigger to trigger and share the trigger's bytes.
* Parse. A suffix of the corpus is a phrase suffix followed by a suffix of the parse, and the
  corpus order is the order of these pairs. Only the first ``length`` bytes matter here, so both orders are
  kept cut off there: what counts in a suffix array is then which neighbours agree on ``length`` bytes, that is,
  the classes of equal (phrase suffix, following parse) pairs. A class is named by a 128-bit hash of
  its bytes instead of its rank; ranks of unequal classes are never compared.
* Pruning. The ``CONTEXT`` bytes from a trigger on are its context. The contexts of all triggers that lie, with the places that
  make them triggers, inside a repeated window are repeated, so windows over a context that occurs once need no further look.
* Dictionary. A region is the run of windows with the same trigger; its bytes are a phrase with
  the parse that follows. If a region's whole bytes occur twice, all its windows repeat, at one go.
* Combination. The other regions are opened: each window's class is counted, together with those of one
  representative of every repeated region that follows the same context. A repeated window has its like among them.

Contexts and windows are counted in packed rows (``recurring``); regions are joins and counts that combine before they shuffle. A phrase that millions of
documents share is one row of the count. Nothing is gathered beyond a slice of documents or a part of the hashes.

Cases: null and empty texts have no window; matches never cross documents; repeated rows are documents of
their own, so all their windows repeat; null and repeated doc_ids each keep their row; texts shorter
than a window keep all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bucketed, discard, id_text, read_table, written
from skein.llm.passages import WORDS, shared_windows
from skein.llm.recurring import PACKED, REGIONS, opened, opened_slices, packed, parts_for, recurring_places, recurring_ranges, region_rows, settled, slices_of, standing, text_slices, to_open, wide

LENGTH = 400
GRAM = 16  # bytes of a rolling hash
PLACES = 64  # places of which the least hash is a trigger
CONTEXT = 96
CHUNK = 1 << 24
TOGETHER = 1 << 18  # bytes of texts whose triggers are found at once

_B = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(4)]
_MIX = np.uint64(0xD6E8FEB86659FD93)


def triggers(data: bytes, places: int = PLACES) -> np.ndarray:
    """The trigger of the window at every start that has all ``places`` (a power of two) before the text's end.

    That covers starts beyond the last whole window: what ends a text may stand inside another.
    """
    n = len(data) - GRAM - places + 2
    if n <= 0:
        return np.empty(0, np.int64)
    if n > CHUNK // 2:  # a place takes 24 bits below: longer texts in parts that overlap
        step = CHUNK // 2
        return np.concatenate([triggers(data[lo : lo + step + GRAM + places - 2], places) + lo for lo in range(0, n, step)])
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    for k in range(4):  # polynomial hashes of 2, 4, 8 and 16 bytes at every place
        h = h[: -(1 << k)] * _B[k] + h[1 << k :]
    h ^= h >> np.uint64(31)
    h *= _MIX
    # 40 bits of the hash, then the place: the least is the leftmost of equals.
    h = (h & ~np.uint64(CHUNK - 1)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < places:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return (h & np.uint64(CHUNK - 1)).astype(np.int64)


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each region, and its trigger."""
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1]) if len(at) else np.empty(0, np.int64)
    return first, at[first]


def regions(datas: list[bytes], places: int = PLACES) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one; where each begins, and the end; and text, first window, last window and trigger of all regions with whole contexts.

    Windows and triggers count from the first text's begin.
    """
    data, offs = b"".join(datas), np.cumsum([0, *map(len, datas)])
    at = triggers(data, places)
    for lo, hi in zip(np.maximum(offs[:-1], offs[1:] - (GRAM + places - 2)).tolist(), offs[1:].tolist()):
        at[lo:hi] = -1  # these would reach into the next text
    first, trigger = runs(at)
    last, real = np.append(first[1:], len(at))[: len(first)] - 1, trigger >= 0
    first, last, trigger = first[real], last[real], trigger[real]
    of = np.searchsorted(offs, first, side="right") - 1
    whole = trigger + CONTEXT <= offs[of + 1]
    return memoryview(data), offs, of[whole], first[whole], last[whole], trigger[whole]


def cut_regions(keep: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Last windows of regions, cut to the windows that may repeat if only the contexts of ``keep`` do; ``ends``: of their texts."""
    # From a window's start on, regions that begin up to here have their places and contexts inside it. The next text's begin only too late.
    reach = LENGTH - places - CONTEXT
    bad = np.minimum.accumulate(np.where(keep, np.iinfo(np.int64).max, lo)[::-1])[::-1]
    return np.minimum(np.minimum(hi, ends - LENGTH), bad - reach - 1)


def _hashes(view: memoryview, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the contexts; used to prune only."""
    return np.array([xxhash.xxh3_64_intdigest(view[s : s + CONTEXT]) for s in at.tolist()], np.uint64)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in slices of about TOGETHER bytes."""
    return slices_of([batch], lambda b: b.column("size").to_numpy().astype(np.int64), TOGETHER)


def _contexts(places: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        base, keys, owner, at = 0, [], [], []
        for part in _cut(batch):
            view, _, of, _, _, trigger = regions(part.column("data").to_pylist(), places)
            keys.append(_hashes(view, trigger))
            owner.append(of + base)
            at.append(np.arange(len(of)) - np.searchsorted(of, of))
            base += part.num_rows
        keys = np.concatenate(keys).reshape(-1, 1)
        yield packed(parts, batch.column("rid").to_numpy(), keys, np.concatenate(owner), np.concatenate(at), np.zeros(len(keys), bool), False)


def _regions(places: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        for part in _cut(batch):
            view, offs, of, lo, hi, trigger = regions(part.column("data").to_pylist(), places)
            begins = np.searchsorted(of, np.arange(part.num_rows)).tolist()
            keep = np.zeros(len(of), bool)
            keep[np.concatenate([np.frombuffer(p, "<u4").astype(np.int64) + n for p, n in zip(part.column("places").to_pylist(), begins)])] = True
            hi = cut_regions(keep, offs[of + 1], lo, hi, places)
            keep &= lo <= hi
            of, lo, hi, trigger = of[keep], lo[keep], hi[keep], trigger[keep]
            digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist())]
            yield region_rows(part.column("rid").to_numpy()[of], lo - offs[of], hi - offs[of], _hashes(view, trigger), digests)


def _windows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in opened_slices(batches):
        owner, x, asked = opened(batch)
        digests, ends = [], np.searchsorted(owner, np.arange(batch.num_rows), side="right")
        for data, at in zip(batch.column("data").to_pylist(), np.split(x, ends[:-1])):
            view = memoryview(data)
            digests += [xxhash.xxh3_128_digest(view[a : a + LENGTH]) for a in at.tolist()]
        yield packed(parts, batch.column("rid").to_numpy(), wide(digests), owner, x, ~asked, False)


def removed_runs(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (owner, begin, end), in order, of what each owner's windows that start at lo..hi (inclusive) cover."""
    base = owner.astype(np.int64) << 33
    order = np.argsort(base + lo, kind="stable")
    begin, end = (base + lo)[order], np.maximum.accumulate((base + hi + length)[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])[: len(begin)])
    last = np.append(first[1:], len(end))[: len(first)] - 1
    return begin[first] >> 33, begin[first] & (1 << 33) - 1, end[last] & (1 << 33) - 1


def repeated_windows(docs: DataFrame, places: int = PLACES) -> tuple[DataFrame, DataFrame]:
    """The documents (rid, doc_id, data) as a table dealt by rid, and (rid, lo, hi) of their repeated windows.

    rid numbers the rows; it is fixed when that table is written.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    numbered = id_text(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("data"), F.length(text).alias("size"))
    kept = bucketed(numbered, "rid", "documents")
    long_enough = kept.select("rid", "data", "size").where(F.col("size") >= LENGTH)
    parts = parts_for(docs, kept.agg(F.sum(F.col("size") / max(places // 2, 1))).first()[0])
    found = recurring_places(long_enough.mapInArrow(partial(_contexts, places, parts), PACKED), parts, 1, False)
    survivors = written(found, "survivors")
    parts = written(long_enough.join(survivors.hint("shuffle_hash"), "rid").mapInArrow(partial(_regions, places), REGIONS), "regions")
    classes = written(parts.groupBy("f1", "f2").agg(F.count("*").alias("n"), *standing()).where("n > 1"), "named")
    done = written(settled(parts, classes), "classes")
    discard(survivors, parts, classes)
    asked = done.where("not again")
    ones = done.where("again and first").join(asked.select("h").distinct(), "h", "left_semi")
    todo = written(to_open(asked, ones), "open")
    parts = parts_for(docs, todo.agg(F.sum("n")).first()[0])
    windows = kept.select("rid", "data").join(todo.hint("shuffle_hash"), "rid").mapInArrow(partial(_windows, parts), PACKED)
    single = recurring_ranges(windows, parts, 2, False)
    starts = written(done.where("again").select("rid", "lo", "hi").unionByName(single), "repeats")
    discard(done, todo)
    return kept, starts


def remove_repeats(docs: DataFrame, places: int = PLACES, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans for docs(doc_id, text).

    ``n_shared`` counts the runs of over 50 words that other rows hold too, and ``shared_words`` their words; they decide nothing
    of what is removed. Without ``texts`` kept and spans are null.
    """
    kept, starts = repeated_windows(docs, places)
    # One number a run of windows: where it begins, how many follow (times two), whether it is of words.
    number = F.shiftleft(F.col("lo").cast("long"), 32) + F.shiftleft((F.col("hi") - F.col("lo")).cast("long"), 1)
    marked = [df.select("rid", (number + kind).alias("x")) for df, kind in ((starts, 0), (shared_windows(kept), 1))]
    by_doc = written(marked[0].unionByName(marked[1]).groupBy("rid").agg(F.collect_list("x").alias("starts")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            lists = batch.column("starts")
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            x, owner, all_docs = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), np.arange(len(n))
            lo, shared = x >> 32, (x & 1).astype(bool)
            hi = lo + ((x & 0xFFFFFFFF) >> 1)
            of, begin, end = removed_runs(owner[~shared], lo[~shared], hi[~shared])
            held, first, last = removed_runs(owner[shared], lo[shared], hi[shared], WORDS)
            at = np.searchsorted(of, all_docs).tolist() + [len(of)]
            begin, end, rows = begin.tolist(), end.tolist(), []
            for data, i, j in zip(batch.column("data").to_pylist(), at[:-1], at[1:]):
                gone = list(zip(begin[i:j], end[i:j]))
                left = b"".join([data[a:b] for a, b in zip([0, *end[i:j]], [*begin[i:j], len(data)])])
                spans = (left, ",".join(f"{a}:{b}" for a, b in gone)) if texts else (None, None)
                rows.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *spans))
            counts = np.bincount(held, minlength=len(n)), np.bincount(held, last - first, len(n)).astype(np.int64)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.string()]
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "n_shared", "shared_words"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans string, n_shared long, shared_words long"
    return kept.join(by_doc.hint("shuffle_hash"), "rid", "left").select("doc_id", "data", "size", "starts").mapInArrow(run, schema)


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur twice, and whether it held one (``repeated``).

    ``n_shared`` and ``shared_words``: its passages of over 50 words that other documents hold too, which may have fewer bytes.
    """
    out = remove_repeats(read_table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeated"), "n_shared", "shared_words")
