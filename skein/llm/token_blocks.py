"""Token-id output: patched frame-of-reference blocks.

A *segment* holds the ids of consecutive whole documents:

    header   8 bytes magic ``SKPFOR1\\0``; uint32: documents, ids, blocks, ids in a full block
    lengths  uint32 ids of each document (its end id included)
    index    uint32 byte position of each block, from the start of the block area
    blocks   uint32 minimum, uint8 width, uint8 zero, uint16 exceptions, then the packed
             low ``width`` bits of (id - minimum), exception positions (uint16) and the
             exceptions' high bits (uint32)

``width`` is the number of bits that a given share (``percentile``) of the block's values needs;
the others keep their low bits in place and their high bits in the exception list. The index lets
a reader open any block without decoding those before it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_text, shared_dir

MAGIC = b"SKPFOR1\0"
BLOCK = 1024
SEGMENT_IDS = 1 << 17
CACHE_WORDS = 400_000  # words of at most CACHE_CHARS characters that each of a worker's two caches holds: about 60 MB
CACHE_CHARS = 48


def pack_block(values: np.ndarray, percentile: float = 0.95) -> bytes:
    """One block from 1 to 65,535 unsigned values below 2**32."""
    low = int(values.min())
    rest = (values - low).astype(np.uint32)
    top = int(np.partition(rest, k := int(percentile * (len(rest) - 1)))[k])
    width = max(1, top.bit_length())
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, int)
    if width == 16:
        body = (rest & 0xFFFF).astype("<u2").tobytes()
    elif width == 8:
        body = (rest & 0xFF).astype("u1").tobytes()
    else:
        bits = np.unpackbits(rest.astype("<u4").view("u1").reshape(-1, 4), axis=1, count=width, bitorder="little")
        body = np.packbits(bits, bitorder="little").tobytes()
    high = (rest[out] >> np.uint32(width)).astype("<u4") if width < 32 else rest[:0]
    return struct.pack("<IBBH", low, width, 0, len(out)) + body + out.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: memoryview, n: int) -> np.ndarray:
    """The ``n`` values of the block that begins at ``data[0]``."""
    low, width, _, n_out = struct.unpack_from("<IBBH", data)
    size = (n * width + 7) // 8
    raw = np.frombuffer(data, "u1", size, 8)
    if width == 16:
        rest = raw.view("<u2").astype(np.uint32)
    elif width == 8:
        rest = raw.astype(np.uint32)
    else:
        bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 4), "u1")
        packed = np.packbits(bits, axis=1, bitorder="little")
        whole[:, : packed.shape[1]] = packed
        rest = whole.view("<u4").reshape(n).astype(np.uint32)
    if n_out:
        at = np.frombuffer(data, "<u2", n_out, 8 + size)
        rest[at] |= np.frombuffer(data, "<u4", n_out, 8 + size + 2 * n_out) << np.uint32(width)
    return rest + np.uint32(low)


def pack_segment(ids: np.ndarray, lengths: list[int], percentile: float = 0.95, block: int = BLOCK) -> bytes:
    """A segment from the ids of whole documents, one after the other."""
    blocks = [pack_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0, int)
    head = MAGIC + struct.pack("<IIII", len(lengths), len(ids), len(blocks), block)
    return b"".join([head, np.asarray(lengths, "<u4").tobytes(), starts.astype("<u4").tobytes(), *blocks])


def open_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, memoryview, int, int]:
    """Document lengths, block starts, the block area, the number of ids and the ids in a full block."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token blocks")
    docs, ids, blocks, block = struct.unpack_from("<IIII", data, 8)
    lengths = np.frombuffer(data, "<u4", docs, 24)
    starts = np.frombuffer(data, "<u4", blocks, 24 + 4 * docs)
    return lengths, starts, memoryview(data)[24 + 4 * docs + 4 * blocks :], ids, block


def read_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment; only the blocks that hold them are decoded."""
    _, starts, area, n, block = open_segment(data)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    parts = [unpack_block(area[starts[b] :], min(block, n - b * block)) for b in range(first // block, (last - 1) // block + 1)]
    return np.concatenate(parts)[first % block :][: last - first]


class WordEncoder:
    """The library's ids of whole texts as little-endian uint32 bytes, with a bounded cache of words.

    A byte-level pre-tokenizer always cuts before a single space that a non-space follows, so the
    words of such a text are encoded on their own; a text in which any space precedes white space
    goes to the library whole. A new word of plain letters, digits, punctuation and line ends is cut
    where the pre-tokenizer would cut it, and the library's model encodes the parts; any other word
    goes through the library's whole chain.
    """

    odd = re.compile(r" \s")
    plain = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?!\n))+")
    parts = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # Byte-level alphabets show printable bytes as themselves and the others from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.after_space: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str, space: str) -> bytes:
        """Ids of letters, digits or punctuation that the pre-tokenizer keeps together."""
        cache = self.after_space if space else self.bare
        got = cache.get(part)
        if got is None:
            text = space + part
            shown = "\u0120" + part if space and part.isascii() and part != "\n" else text.encode().decode("latin-1").translate(self.alphabet)
            got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(cache) < CACHE_WORDS and len(part) <= CACHE_CHARS:
                cache[part] = got
        return got

    def _word(self, word: str, space: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word, space)
        if self.plain.fullmatch(word) and "<|" not in word:
            first, *rest = self.parts.findall(word)
            got = self._part(first, space)
            for x in rest:
                got += self.bare.get(x) or self._part(x, "")
        else:
            got = self._whole(space + word)
        cache = self.after_space if space else self.bare
        if len(cache) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            cache[word] = got
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.after_space.get
        for text in texts:
            if self.odd.search(text):
                out.append(self._whole(text))
                continue
            words = text.split(" ")
            found = list(map(get, words))
            found[0] = (self.bare.get(words[0]) or self._word(words[0], "")) if words[0] else b""
            if None in found:
                found = [self._word(w, " ") if x is None else x for w, x in zip(words, found)]
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """This worker's encoder; its cache of words lasts from task to task."""
    return WordEncoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _segments(path: str, end_id: int, percentile: float):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part = encoder(path), TaskContext.get().partitionId()
        ids, docs, lengths, before, number, held = [], [], [], 0, 0, 0

        def segment() -> pd.DataFrame:
            data = pack_segment(np.frombuffer(b"".join(ids), "<u4"), lengths, percentile)
            return pd.DataFrame({"part": [part], "segment": [number], "local_start": [before], "n_ids": [sum(lengths)], "doc_ids": [list(docs)], "data": [data]})

        for pdf in batches:
            for lo in range(0, len(pdf), 128):
                rows = pdf.iloc[lo : lo + 128]
                for doc, got in zip(rows.doc_id, encode(rows.text.fillna("").tolist()), strict=True):
                    ids.append(got + end)
                    docs.append(None if pd.isna(doc) else int(doc))
                    lengths.append(len(got) // 4 + 1)
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield segment()
                        before, number, held = before + held, number + 1, 0
                        ids, docs, lengths = [], [], []
        if docs:
            yield segment()

    return run


def write_token_blocks(docs: DataFrame, path: str, out: str, end_id: int = 0, percentile: float = 0.95) -> None:
    """Encode ``docs(doc_id, text)`` in ascending ``doc_id`` order and write its segments under ``out``.

    Rows are dealt by ranges of ``doc_id`` and sorted in each, so that parts, segments and documents
    follow the order of ``doc_id`` (null ids first, equal ids by a hash of their text, then by text). A null text counts as empty;
    every document gets ``end_id`` appended. Each task keeps one segment and one batch in memory.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = id_text(docs).withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    schema = "part int, segment int, local_start long, n_ids long, doc_ids array<long>, data binary"
    ordered.mapInPandas(_segments(path, end_id, percentile), schema).write.option("compression", "none").parquet(out)


def read_token_blocks(spark, out: str) -> DataFrame:
    """The segments under ``out`` with ``start``, the number of ids in all segments before."""
    seg = spark.read.parquet(out)
    total = seg.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each output part: a running sum over a few thousand rows at most.
    from pyspark.sql import Window

    offsets = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return seg.join(offsets, "part").select("part", "segment", (F.col("offset") + F.col("local_start")).alias("start"), "n_ids", "doc_ids", "data")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for start, docs, data in zip(pdf.start, pdf.doc_ids, pdf.data):
            data = bytes(data)
            lengths = open_segment(data)[0].astype(np.int64)
            ids = read_ids(data).astype("<u4")
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
            yield pd.DataFrame({"doc_id": pd.array(list(docs), "Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})


def token_digests(segments: DataFrame) -> DataFrame:
    """One row per document, computed from the decoded blocks: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return segments.select("start", "doc_ids", "data").mapInPandas(_digests, schema)


def op6_token_blocks(spark, sf_dir: str) -> DataFrame:
    """Encode all of ``documents``, write the token files, read them back."""
    import uuid

    from skein.llm.common import read_table

    out = f"{shared_dir(spark)}/skein-tokens-{uuid.uuid4().hex}"
    write_token_blocks(read_table(spark, sf_dir, "documents"), tokenizer_path(), out)
    return token_digests(read_token_blocks(spark, out))
