"""Byte-level BPE encoding and decoding by relational queries inside each task.

A text is cut by the vocabulary's pattern into words. A word that is a token itself has that id; any other one starts
as its bytes. A DuckDB query in the task contracts all new words of a slice of texts together: rows (word, place, id, next
place, next id) join the merge table, each word's pair of smallest rank, the leftmost of equals, becomes one row, and the
recursion ends when no row finds a merge. The merge table holds every pair of tokens whose bytes joined are a token, whose
id is the rank. Decoding joins ids with the vocabulary and aggregates the bytes in order.

The ids of words stay in a bounded cache that a worker keeps from task to task. Words of over LONGEST bytes would need a round for
each merge: they are contracted by the same rule with a heap. Each query of a task takes a bounded number of bytes or ids.

Cases: a null text counts as empty and has no id; a null doc_id stays; repeated rows each get their row; an empty table
gives an empty result; text that looks like a special token is plain text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, read_table, slices

LONGEST = 255  # bytes of a word that is contracted in the query; places fit into ten bits
QUERY_BYTES = 400_000  # bytes of new words that one query contracts
QUERY_IDS = 200_000  # ids that one query decodes
CACHE_WORDS = 400_000  # words of at most CACHE_CHARS characters that a worker remembers, and those of one slice more
CACHE_CHARS = 48

# Fixed value: the usual pattern, and the same one for texts of Latin letters and common marks, which the faster library can do.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_PLAIN = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_OTHER = re.compile(r"[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]").search

_ENCODE = """
with recursive state(word, place, id, next_place, next_id, step) as (
  select word, place, id, next_place, next_id, 0 from start
  union all (
    with best as (
      select word, min((rank << 20) | (place << 10) | next_place) as found
      from state join merges on left_id = id and right_id = next_id group by word)
    select s.word, place,
      case when place = found & 1023 then (found >> 20)::int else id end,
      case when next_place = (found >> 10) & 1023 then (found & 1023)::int else next_place end,
      case when next_place = (found >> 10) & 1023 then (found >> 20)::int else next_id end,
      step + 1
    from state s join best b on s.word = b.word
    where place <> (found >> 10) & 1023))
select word, place, id, step from state"""

_DECODE = "select row, string_agg(bytes, '' order by place) as bytes from ids join vocabulary using (id) group by row"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids of a rank file: base64 of the bytes, a blank, the rank."""
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def contract(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: its pair of smallest rank, the leftmost of equals, is joined until no pair is a token."""
    n = len(data)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] <= i or end[i] >= stop or end[end[i]] != stop:
            continue  # a part of it has changed since
        middle = end[i]
        end[middle], end[i] = -1, stop
        if stop < n:
            before[stop] = i
        for a in (before[i], i):
            if a >= 0 and end[a] < n and (r := ranks.get(data[a : (b := end[end[a]])])) is not None:
                heapq.heappush(heap, (r, a, b))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """Ids of texts and texts of ids for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks, self.cut = read_ranks(path), regex.compile(pattern).findall
        self.plain = _PLAIN if pattern == PATTERN else None
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "700MB", "temp_directory": ""})
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self._table("merges", pa.table({"left_id": left.astype(np.int32), "right_id": right.astype(np.int32), "rank": rank}))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.hex() for t in self.ranks]}))
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, rows) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _ask(self, name: str, rows, query: str):
        self.db.register(name, rows)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids, as bytes of int32, of words of 2 to LONGEST bytes: one recursive query."""
        import pyarrow as pa

        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(sizes) - 1
        place = (np.arange(last[-1] + 1) - np.repeat(last + 1 - sizes, sizes)).astype(np.int32)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        next_place, next_id = place + np.int32(1), np.append(ids[1:], np.int32(-1))
        next_place[last] = next_id[last] = -1
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        start = pa.table({"word": word, "place": place, "id": ids, "next_place": next_place, "next_id": next_id})
        word, place, ids, step = (c.to_numpy() for c in self._ask("start", start, _ENCODE).columns)
        steps = np.zeros(len(words), np.int32)
        np.maximum.at(steps, word, step)
        kept = np.flatnonzero(step == steps[word])
        kept = kept[np.argsort((word[kept].astype(np.int64) << 10) | place[kept])]
        flat = np.ascontiguousarray(ids[kept], np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(word[kept], minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as bytes, of words of the pattern."""
        found, batch, size = {}, [], 0
        for word in words:
            data = word.encode("utf-8", "replace")
            if (token := self.ranks.get(data)) is not None:
                found[word] = token.to_bytes(4, "little")
            elif len(data) > LONGEST:
                found[word] = np.array(contract(data, self.ranks), "<i4").tobytes()
            else:
                batch.append((word, data))
                size += len(data)
            if size >= QUERY_BYTES:
                found.update(zip([w for w, _ in batch], self._contracted([d for _, d in batch])))
                batch, size = [], 0
        if batch:
            found.update(zip([w for w, _ in batch], self._contracted([d for _, d in batch])))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cuts = [(self.plain if self.plain and not _OTHER(text) else self.cut)(text) for text in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        words: set[str] = set()
        for cut in cuts:
            words.update(cut)
        fresh = [w for w in words if w not in self.known]
        self.known.update(self._words(fresh))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, cut)), "<i4") for cut in cuts]
        for word in fresh:
            if len(word) > CACHE_CHARS:
                del self.known[word]
        return out

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids: joined with the vocabulary and aggregated in order, QUERY_IDS at a time."""
        import pyarrow as pa

        out: list[list[bytes]] = [[] for _ in rows]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        row, ids = np.repeat(np.arange(len(rows)), sizes), np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
        for lo in range(0, len(ids), QUERY_IDS):
            part = slice(lo, lo + QUERY_IDS)
            asked = pa.table({"row": row[part], "place": np.arange(len(ids[part])), "id": ids[part]})
            found = self._ask("ids", asked, _DECODE)
            for r, data in zip(found.column("row").to_pylist(), found.column("bytes").to_pylist()):
                out[r].append(bytes.fromhex(data))
        return [b"".join(parts) for parts in out]


_KEPT: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer, kept from task to task."""
    if (path, pattern) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, pattern] = Tokenizer(path, pattern)
    return _KEPT[path, pattern]


def _lists(rows: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)))


def _run(path: str, pattern: str, decoding: bool, batches: Iterator) -> Iterator:
    import pyarrow as pa

    made = tokenizer(path, pattern)
    for batch in slices(batches):
        ids = made.encode([t or "" for t in batch.column("text").to_pylist()])
        columns = {"doc_id": batch.column("doc_id"), "ids": _lists(ids)}
        if decoding:
            columns["decoded"] = pa.array(made.decode(ids), pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> for docs(doc_id, text) by a rank file and its pattern. Nothing is shuffled."""
    return id_text(docs).mapInArrow(partial(_run, path, pattern, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: the ids of ``encode`` and what ``decode`` makes of them, by one task."""
    return id_text(docs).mapInArrow(partial(_run, path, pattern, True), "doc_id long, ids array<int>, decoded binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary for tokens(doc_id, ids array<int>); null ids count as none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = tokenizer(path, pattern)
        for batch in slices(batches):
            ids = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(made.decode(ids), pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Number and hash of every document's ids, and the hash of the bytes they decode to."""
    import public_tokenizers

    made = round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
