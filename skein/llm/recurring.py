"""Which of very many hashes more than one row holds, counted in packed rows: Spark deals and groups them, numpy counts inside a group.

An entry is a hash with its document and its place there. Entries travel many to a row, as bytes:

* A slice is some documents of one task. Hashes that recur in the slice are settled there: one copy goes to the hash's part, to be
  known there, and asks nothing. So a hash that all documents hold reaches its part once a slice, however hot it is.
* The others are dealt by their hash to parts of about ENTRIES entries, which answer with the entries that recur.
* Answers go back to the slice, where those of a document come together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import counted_join

ENTRIES = 1 << 20  # of a part, on average
WINDOWS = 1 << 19  # opened at once; a document with more is a slice of its own
SLICE = 1 << 23  # bytes of texts in a slice; a longer text is a slice of its own
PACKED = "part long, sid long, rids binary, known binary, keys binary, owner binary, at binary"


def parts_for(df: DataFrame, entries: float | None) -> int:
    """Parts for so many entries, no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(entries or 0) // ENTRIES + 1)


def slices_of(batches: Iterator[pa.RecordBatch], weight: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the weights of their rows add up to ``most``."""
    for batch in batches:
        if batch.num_rows:
            part = np.cumsum(weight(batch)) // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield batch.slice(a, b - a)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``data`` cut at about SLICE bytes."""
    return slices_of(batches, lambda b: b.column("size").to_numpy().astype(np.int64), SLICE)


def wide(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two numbers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ..., n numbers from each lo."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def recur(keys: np.ndarray, holder: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry whether its hash (a row of ``keys``) is known or has two holders; and one entry of each hash."""
    if not len(keys):
        return np.empty(0, bool), np.empty(0, np.int64)
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    ranked, who = keys[order], holder[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    many = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) | np.logical_or.reduceat(known[order], first)
    out = np.empty(len(keys), bool)
    out[order] = many[np.cumsum(new) - 1]
    return out, order[first]


def cuts(part: np.ndarray, *sorted_by_part: np.ndarray) -> Iterator[tuple]:
    """Each part with its stretches of entries."""
    which = np.unique(part)
    edges = [(i, np.searchsorted(part[i], which), np.searchsorted(part[i], which, side="right")) for i in sorted_by_part]
    for j, p in enumerate(which.tolist()):
        yield p, *(i[a[j] : b[j]] for i, a, b in edges)


def packed(parts: int, rids: np.ndarray, keys: np.ndarray, owner: np.ndarray, at: np.ndarray, known: np.ndarray, apart: bool) -> pa.RecordBatch:
    """A slice's rows as ``PACKED``: document ``rids[owner]`` holds a hash at place ``at``.

    ``known`` entries ask nothing and settle all others of their hash. ``apart``: only different documents count, else any two entries.
    """
    settled, one = recur(keys, owner if apart else np.arange(len(keys)), known)
    direct, sid, rows = np.flatnonzero(settled & ~known), int(rids[0]), []
    part = (keys[:, 0] % np.uint64(parts)).astype(np.int64)
    tell, ask = (i[np.argsort(part[i], kind="stable")] for i in (one[settled[one]], np.flatnonzero(~settled)))
    for p, t, q in cuts(part, tell, ask):
        rows.append((p, sid, b"", keys[t].tobytes(), keys[q].tobytes(), owner[q].astype("<u4").tobytes(), at[q].astype("<u4").tobytes()))
    rows.append((parts + sid % parts, sid, rids.astype("<i8").tobytes(), b"", b"", owner[direct].astype("<u4").tobytes(), at[direct].astype("<u4").tobytes()))
    kinds = [pa.int64()] * 2 + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def _answer(parts: int, width: int, apart: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    """The entries of a part that recur; what a slice settled by itself passes."""
    if pdf["part"].iloc[0] >= parts:
        return pdf[["sid", "rids", "owner", "at"]]
    owner = np.frombuffer(b"".join(pdf["owner"]), "<u4")
    n = (pdf["owner"].map(len) // 4).to_numpy()
    keys = np.frombuffer(b"".join([*pdf["keys"], *pdf["known"]]), "<u8").reshape(-1, width)
    holder, known = np.arange(len(keys)), np.arange(len(keys)) >= len(owner)
    if apart:  # a document's entries are in one slice, a row here
        holder[: len(owner)] = (np.repeat(np.arange(len(n)), n) << 32) | owner
    twice = np.split(recur(keys, holder, known)[0][: len(owner)], np.cumsum(n)[:-1])
    cut = lambda column: [np.frombuffer(b, "<u4")[t].tobytes() for b, t in zip(pdf[column], twice)]
    out = pd.DataFrame({"sid": pdf["sid"], "rids": pdf["rids"], "owner": cut("owner"), "at": cut("at")})
    return out[out["owner"].map(len) > 0]


def _entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's documents, and the owners and places of its entries, sorted."""
    owner, at = (np.frombuffer(b"".join(pdf[c]), "<u4").astype(np.int64) for c in ("owner", "at"))
    order = np.argsort(owner << 32 | at)
    return np.frombuffer(b"".join(pdf["rids"]), "<i8"), owner[order], at[order]


def _places(pdf: pd.DataFrame) -> pd.DataFrame:
    rids, owner, at = _entries(pdf)
    who, first = np.unique(owner, return_index=True)
    return pd.DataFrame({"rid": rids[who], "places": [a.astype("<u4").tobytes() for a in np.split(at, first[1:])][: len(who)]})


def _ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    rids, owner, at = _entries(pdf)
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    last = np.append(new[1:], len(at))[: len(new)] - 1
    return pd.DataFrame({"rid": rids[owner[new]], "lo": at[new].astype(np.int32), "hi": at[last].astype(np.int32)})


def _recurring(rows: DataFrame, parts: int, width: int, apart: bool) -> DataFrame:
    answers = rows.groupBy("part").applyInPandas(partial(_answer, parts, width, apart), "sid long, rids binary, owner binary, at binary")
    return answers.groupBy("sid")


def recurring_places(rows: DataFrame, parts: int, width: int, apart: bool) -> DataFrame:
    """(rid, places): of each document with any, the places of entries that recur, rising, as bytes. ``rows`` are of ``packed``, hashes of ``width`` numbers."""
    return _recurring(rows, parts, width, apart).applyInPandas(_places, "rid long, places binary")


def recurring_ranges(rows: DataFrame, parts: int, width: int, apart: bool) -> DataFrame:
    """(rid, lo, hi): the same, as runs of places."""
    return _recurring(rows, parts, width, apart).applyInPandas(_ranges, "rid long, lo int, hi int")


REGIONS = "rid long, lo int, hi int, h long, f1 long, f2 long"


def region_rows(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, digests: list[bytes]) -> pa.RecordBatch:
    """A batch of ``REGIONS``: windows lo..hi, hashes of their context (64 bits) and of all they cover (128 bits)."""
    f = wide(digests).view(np.int64)
    columns = [rid, lo.astype(np.int32), hi.astype(np.int32), h.view(np.int64), f[:, 0], f[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in REGIONS.split(", ")])


def standing() -> list[Column]:
    """one, begin: the row (rid, lo) that stands for a class of regions; numbers, as an aggregate of structs would sort."""
    return [F.min("rid").alias("one"), F.min_by("lo", "rid").alias("begin")]


def settled(parts: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid, lo, hi, h, again, first): whether a region is of ``classes`` (f1, f2, n, one, begin), and whether its row is the one that stands for its class."""
    named = counted_join(parts, classes, ["f1", "f2"], "left", hint="shuffle_hash")
    first = (F.col("one") == F.col("rid")) & (F.col("begin") == F.col("lo"))
    return named.select("rid", "lo", "hi", "h", F.col("n").isNotNull().alias("again"), first.alias("first"))


def to_open(asked: DataFrame, ones: DataFrame) -> DataFrame:
    """(rid, todo, n): the regions whose windows are counted, a row a document, and how many windows they have."""
    rows = asked.select("rid", "lo", "hi", F.lit(True).alias("asked")).unionByName(ones.select("rid", "lo", "hi", F.lit(False).alias("asked")))
    return rows.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "asked")).alias("todo"), F.sum(F.col("hi").cast("long") - F.col("lo") + 1).alias("n"))


def opened_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the columns of ``to_open`` cut at about WINDOWS windows."""
    return slices_of(batches, lambda b: b.column("n").to_numpy(), WINDOWS)


def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, window and whether it is asked for, of all windows of ``todo``."""
    lists = batch.column("todo")
    lo, hi, asked = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
    n = hi.astype(np.int64) - lo + 1
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return np.repeat(row, n), spread(lo.astype(np.int64), n), np.repeat(asked, n)
