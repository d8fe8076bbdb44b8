"""SentencePiece encoding and decoding by a lattice of pieces.

A text becomes a blank mark, then itself with blanks as marks, cut into words before each mark that
follows another character (no piece crosses such a place), and words into units between any two characters that stand side
by side in no piece. A unit's lattice has an edge for each of its substrings that is a piece; the best path has the largest
sum of piece scores (ties: the longest last piece, as in the library). Characters without a piece are edges of their own
below all scores and become byte pieces. A text's best path is that of its units.

All units go through Spark. The documents are taken in blocks of ``BLOCK_CHARS`` characters, in the order of their
partition. A block asks for each of its distinct units once (those of one part of a hash in one row, in order of their
first occurrence); the parts are dealt, equal units become one row, its bounded-length substrings are exploded and
equi-joined to the piece table, edges are grouped by unit, and a higher-order ``aggregate`` folds Viterbi over them. The ids go
back to the blocks that asked, by place instead of by text. They meet the block's texts as numbers of units there, and each
text is put together from its units' ids. What is decoded from them is compared with the text by a 128-bit digest.

Only units of more than ``UNIT_CHARS`` characters (junk without a blank; their trellis would be copied once a character in
Spark) are folded by the task that holds their document, by the same lattice.

Documents must come from files or a written table: both sides of a block read them in the same order. If they do not,
the encoding stops with an error.

The scores are those of the model file. Decoding joins pieces and bytes and turns marks into blanks; it gives
the text back exactly, unless the text itself holds the mark (which then reads as a blank) or code points
that UTF-8 cannot hold.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows each get their row; a text of any
length is in one block.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import id_text, read_table, slices, tidy

MARK = "▁"
UNIT_CHARS = 64  # longer units are folded where their document is
BLOCK_CHARS = 16_000_000  # texts of a block; its distinct words are held by one task
PART_CHARS = 2_000_000  # texts for each part of the units
SALT_BITS = 42  # a unit's row lists its places in the blocks of 1,024 partitions; more blocks, more rows
HEAD = 3  # characters that bound the length of the pieces which begin with them
SHORT = 1 << 15  # ids of two bytes
CODES = 1 << 22  # ids, and code points below zero, that a node's number has room for
UNKNOWN_PENALTY = 10.0
SCHEMA = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class PieceTable:
    """Pieces with ids and scores, the id of byte 0, and the text of every id."""

    scores: dict[str, tuple[int, float]]
    byte_zero: int
    texts: list[str]
    longest: int
    unknown: float

    @classmethod
    def load(cls, path: str) -> PieceTable:
        """The table of a model file; control, unknown and byte pieces have no edge in a lattice."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        usual = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        scores = {m.id_to_piece(i): (i, m.get_score(i)) for i in usual}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has a mark after another character; words cannot be encoded on their own")
        byte_zero = next((i for i in range(n) if m.is_byte(i)), -1)
        if byte_zero < 0:
            raise ValueError("the model has no byte pieces")
        if n > CODES // 2:
            raise ValueError("the model has too many pieces")
        low = min(s for _, s in scores.values())
        return cls(scores, byte_zero, [m.id_to_piece(i) for i in range(n)], max(map(len, scores)), low - UNKNOWN_PENALTY)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("raw", "index", "crossed")}

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(units, number of units of each word): words cut between characters that no piece holds side by side.

        No edge of a word's lattice crosses such a place, so the best path is that of its units, one after the other.
        """
        if not hasattr(self, "crossed"):
            pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
            chars = sorted({c for pair in pairs for c in pair})
            index, crossed = np.zeros(0x110000, np.int16), np.zeros((len(chars) + 1, len(chars) + 1), bool)
            index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            for a, b in pairs:
                crossed[index[ord(a)], index[ord(b)]] = True
            self.index, self.crossed = index, crossed
        if not words:
            return [], np.empty(0, np.int64)
        joined = " ".join(words)
        joined = " ".join(map(marked, words)) if MARK in joined else MARK + joined.replace(" ", " " + MARK)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        blank, at = codes == 32, self.index[codes]
        cuts = np.flatnonzero(~self.crossed[at[:-1], at[1:]] & ~blank[:-1] & ~blank[1:]) + 1
        units = np.insert(codes, cuts, 32).astype("<u4").tobytes().decode("utf-32-le").split(" ")
        return units, 1 + np.bincount(np.cumsum(blank)[cuts], minlength=len(words))

    def encode_word(self, word: str) -> bytes:
        """Little-endian uint32 ids of a word's best path: the lattice and its fold in one task."""
        get, longest, n = self.scores.get, self.longest, len(word)
        best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
        for end in range(1, n + 1):
            top, edge = None, (end - 1, -1)
            for start in range(max(0, end - longest), end):
                found = get(word[start:end])
                if found:
                    s = best[start] + found[1]
                elif start == end - 1:
                    found, s = (-1, 0.0), best[start] + self.unknown
                else:
                    continue
                if top is None or s > top:
                    top, edge = s, (start, found[0])
            best[end], back[end] = top, edge
        ids, end = [], n
        while end:
            start, i = back[end]
            ids.append((i,) if i >= 0 else self.byte_ids(word[start:end]))
            end = start
        return array("I", [i for group in reversed(ids) for i in group]).tobytes()

    def byte_ids(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_zero + b for b in char.encode("utf-8", "replace"))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The pieces and bytes of a sequence of ids, one after the other."""
        if not hasattr(self, "raw"):
            lo = self.byte_zero
            self.raw = [bytes([i - lo]) if lo <= i < lo + 256 else t.encode() for i, t in enumerate(self.texts)]
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    @staticmethod
    def text(joined: bytes) -> str:
        """The text of decoded bytes: marks become blanks, the first one goes."""
        text = joined.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        return self.text(self.decode_bytes(ids))


_words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def split_words(text: str) -> list[str]:
    """The words of a text: plain ones without their mark, others (several marks, or marks only) with all of them."""
    words = text.split(" ") if text else []
    if "" in words or MARK in text:  # blanks in a row or at an end, or the mark itself
        words = [w[1:] if w[0] == MARK and MARK not in w[1:] and len(w) > 1 else w for w in _words.findall(MARK + text.replace(" ", MARK))]
    return words


def marked(word: str) -> str:
    """A word of ``split_words`` as the lattice sees it."""
    return word if MARK in word else MARK + word


def _blocks(chars: int, batches: Iterator) -> Iterator[tuple[int, list]]:
    """(number, Arrow slices) of the blocks of a partition's rows, however these come in batches."""
    import pyarrow.compute as pc
    from pyspark import TaskContext

    number, held, room = TaskContext.get().partitionId() << 32, [], chars
    for batch in batches:
        lo = 0
        for i, size in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 1):
            room -= size + 16  # a row counts, too
            if room <= 0:
                yield number, [*held, batch.slice(lo, i - lo)]
                number, held, room, lo = number + 1, [], chars, i
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield number, held


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _parts(units: list[str], n: int) -> list[int]:
    """The part of each unit; n for one that is too long for Spark."""
    crc = zlib.crc32
    return [n if len(u) > UNIT_CHARS else crc(u.encode("utf-8", "replace")) % n for u in units]


class _Units:
    """The distinct units of a block by part, in order of their first occurrence, and the texts as numbers of units.

    Numbers count the units of part 0, then those of part 1 and so on, then those that are too long for Spark.
    """

    def __init__(self, table: PieceTable, n: int, held: list):
        at, rows, sizes, self.texts = _Numbers(), [], [], []
        for part in slices(held):
            mine: list[int] = []
            for t in part.column("text").to_pylist():
                mine += map(at.__getitem__, split_words(t or ""))
                sizes.append(len(mine))
                self.texts.append(xxhash.xxh3_128_digest((t or "").encode("utf-8", "replace")))
            rows.append(np.array(mine, np.int32))
            sizes[-part.num_rows :] = np.diff([0, *sizes[-part.num_rows :]]).tolist()
        units, counts = table.cut(list(at))
        del at
        number = _Numbers()
        codes = np.fromiter(map(number.__getitem__, units), np.int32, len(units))
        self.parts: list[list[str]] = [[] for _ in range(n + 1)]
        of, place = _parts(list(number), n), []
        for u, p in zip(number, of):
            mine = self.parts[p]
            place.append(len(mine))
            mine.append(u)
        starts = np.cumsum([0, *map(len, self.parts)])
        codes = (starts[of] + place)[codes].astype(np.int32) if of else codes
        words = np.concatenate(rows)
        times = counts[words]
        ends = np.cumsum(times)
        self.flat = codes[np.repeat((np.cumsum(counts) - counts)[words] - (ends - times), times) + np.arange(times.sum())]
        self.sizes = np.diff(np.concatenate([[0], ends])[np.cumsum([0, *sizes])])


def _asked(shared: Broadcast, n: int, chars: int, batches: Iterator) -> Iterator:
    """part, block, units (blank-separated, in order of their first occurrence) for each block and part."""
    import pyarrow as pa

    for block, held in _blocks(chars, batches):
        words: dict[str, None] = {}
        for part in slices(held):
            for t in part.column("text").to_pylist():
                deque(map(words.setdefault, split_words(t or "")), 0)
        parts: list[list[str]] = [[] for _ in range(n + 1)]
        units = list(dict.fromkeys(shared.value.cut(list(words))[0]))
        for u, p in zip(units, _parts(units, n)):
            parts[p].append(u)
        rows = [(p, " ".join(some)) for p, some in enumerate(parts[:n]) if some]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([u for _, u in rows], pa.string())], names=["part", "block", "units"])


def _packed(shared: Broadcast, n: int, chars: int, batches: Iterator) -> Iterator:
    """One row for each block: its ids, the number of units and the digest of each text, the units' numbers, long units.

    Of the numbers, all lowest bytes come first, then all second bytes and so on: they compress better apart.
    """
    import pyarrow as pa

    for block, held in _blocks(chars, batches):
        units = _Units(shared.value, n, held)
        numbers = np.ascontiguousarray(units.flat.astype("<i4").view(np.uint8).reshape(-1, 4).T)
        ids = pa.concat_arrays([h.column("doc_id") for h in held])
        row = [
            pa.array([block], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([units.sizes.astype("<i4").tobytes()], pa.binary()),
            pa.array([b"".join(units.texts)], pa.binary()),
            pa.array([zstandard.compress(numbers.tobytes())], pa.binary()),
            pa.array([units.parts[n]], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(row, names=["block", "doc_ids", "sizes", "texts", "numbers", "long"])


def best_paths(words: DataFrame, table: PieceTable) -> DataFrame:
    """part, payload, ids for ``words(id, part, word, payload)``, words with their marks: the relational lattice.

    An id below zero stands for minus a code point without a piece. The payload travels on one edge of its word.
    """
    spark = words.sparkSession
    rows = [(p, i, float(s)) for p, (i, s) in table.scores.items()]
    pieces = F.broadcast(spark.createDataFrame(rows, "piece string, piece_id int, score double"))  # as large as the model's table
    whole = words.select("id", "part", F.col("word").alias("w"), "payload")
    starts = whole.select("id", "part", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"), "payload")
    starts = starts.withColumn("payload", F.when(F.col("i") == 1, F.col("payload"))).withColumn("head", F.substring("w", F.col("i"), F.lit(HEAD)))
    # No substring is longer than the longest piece with its first characters.
    most: dict[str, int] = {}
    for p in table.scores:
        if len(p) >= HEAD:
            most[p[:HEAD]] = max(most.get(p[:HEAD], 0), len(p))
    heads = F.broadcast(spark.createDataFrame(list(most.items()) or [("", 0)], "head string, most int"))
    starts = starts.join(heads, "head", "left")
    sizes = F.sequence(F.lit(1), F.least(F.coalesce("most", F.lit(HEAD - 1)), F.length("w") - F.col("i") + 1))
    spans = starts.select("id", "part", "w", "i", F.explode(sizes).alias("l"), "payload")
    spans = spans.select("id", "part", "i", "l", F.expr("substring(w, i, l)").alias("piece"), F.when(F.col("l") == 1, F.col("payload")).alias("payload"))
    edges = spans.join(pieces, "piece", "left").where("piece_id is not null or l = 1")
    code = F.col("i") * float(CODES) + F.coalesce("piece_id", -F.ascii("piece")) + float(CODES // 2)
    edge = F.struct((F.col("i") + F.col("l")).alias("to"), F.col("i").alias("of"), F.coalesce("score", F.lit(table.unknown)).alias("score"), code.alias("code"))
    # Rows of a word are still in one task, dealt by part: grouping them needs no further shuffle.
    lattice = edges.groupBy("id", "part").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.first("payload", ignorenulls=True).alias("payload"))
    # Viterbi over the edges by their end. Node k has two entries: its best score at 2k - 1, and at 2k where it comes from and by
    # which id, as one number. Every node has an edge, that of its last character. Ties keep the earlier start.
    cost = "element_at(t, 2 * e.of - 1) + e.score"
    viterbi = f"""
      aggregate(edges, array(0D, 0D), (t, e) -> if(2 * e.to > size(t), concat(t, array({cost}, e.code)),
        if({cost} > element_at(t, -2), concat(slice(t, 1, size(t) - 2), array({cost}, e.code)), t)))
    """
    path = f"""
      aggregate(sequence(size(trellis), 4, -2), array(size(trellis)),
        (p, k) -> if(k = element_at(p, 1),
          concat(array(2 * cast(cast(element_at(trellis, k) as long) div {CODES} as int), cast(element_at(trellis, k) % {CODES} as int) - {CODES // 2}), slice(p, 2, size(p))), p),
        p -> slice(p, 2, size(p)))
    """
    return lattice.select("part", "payload", F.expr(viterbi).alias("trellis")).select("part", "payload", F.expr(path).alias("ids"))


def parts_for(docs: DataFrame) -> int:
    """Parts of the words of ``docs(text)``: small ones that are sorted in memory, of about PART_CHARS characters of text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(n, min(chars // PART_CHARS, 16 * n))


def unit_ids(docs: DataFrame, shared: Broadcast, n: int, chars: int = BLOCK_CHARS) -> DataFrame:
    """block, part, sizes, ids: the encoded units that each block of ``docs(text)`` asked for, in the order of its units."""
    table = shared.value
    asked = docs.select("text").mapInArrow(partial(_asked, shared, n, chars), "part int, block long, units string").repartitionById(n, "part")
    places = asked.select("part", "block", F.posexplode(F.split("units", " ")).alias("pos", "word"))
    salt = F.shiftright("block", SALT_BITS)
    words = places.groupBy("word", "part", salt.alias("salt")).agg(F.collect_list(F.struct("block", "pos")).alias("payload"))
    found = best_paths(words.withColumn("id", F.monotonically_increasing_id()), table)
    # Two bytes an id where they do: a code point without a piece takes two numbers below zero then.
    ids = F.col("ids")
    if len(table.texts) <= SHORT:
        pair = lambda i: F.when(i >= 0, F.array(i)).otherwise(F.array(-1 - F.call_function("div", -i, F.lit(SHORT)).cast("int"), -1 - (-i) % SHORT))
        ids = F.when(F.exists(ids, lambda i: i < 0), F.flatten(F.transform(ids, pair))).otherwise(ids).cast("array<short>")
    back = found.select(F.explode("payload").alias("p"), ids.alias("ids"), "part").select("p.block", "part", F.struct("p.pos", "ids").alias("x"))
    rows = back.groupBy("block", "part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("block", "part", F.transform("xs", lambda x: F.size(x["ids"]).cast("short")).alias("sizes"), F.flatten(F.transform("xs", lambda x: x["ids"])).alias("ids"))


def _answered(table: PieceTable, answers, long: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units one after the other, ids of each unit) in the order of a block's numbers."""
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column("sizes"), answers.column("ids")), key=lambda r: r[0])
    extra = [np.frombuffer(table.encode_word(u), "<i4") for u in long]
    sizes = np.concatenate([*(r[1].values.to_numpy() for r in rows), np.array([len(x) for x in extra], np.int64)]).astype(np.int64)
    flat = np.concatenate([*(r[2].values.to_numpy() for r in rows), *extra, np.empty(0, np.int32)]).astype(np.int32)
    odd = np.flatnonzero(flat < 0)  # code points without a piece become bytes
    if len(odd):
        codes = -flat[odd].astype(np.int64)
        if len(table.texts) <= SHORT:
            codes = (codes[::2] - 1) * SHORT + codes[1::2] - 1
        made = [table.byte_ids(chr(c)) for c in codes.tolist()]
        times = np.ones(len(flat), np.int64)
        times[odd] = 0
        times[odd[:: len(odd) // len(made)]] = list(map(len, made))
        of = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(of, times, len(sizes)).astype(np.int64)
        bare = np.repeat(flat < 0, times)
        flat = np.repeat(flat, times)
        flat[bare] = [j for m in made for j in m]
    return flat, sizes


def _encoded(shared: Broadcast, check: bool, packed, answers):
    """One block: its texts from the ids of its units, with numpy gathers over slices of them."""
    import pyarrow as pa

    table, row = shared.value, {c: packed.column(c)[0] for c in packed.column_names}
    flat, sizes = _answered(table, answers, row["long"].as_py())
    ends = np.cumsum(sizes)
    begin = ends - sizes
    raw = zstandard.decompress(row["numbers"].as_py())
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()
    if (np.bincount(numbers, minlength=len(sizes)) == 0).any() or (len(numbers) and numbers.max() >= len(sizes)):
        raise RuntimeError("a block's texts and its units came from different rows; write the documents to a table first")
    # No character's bytes are in two units: a text's decoding is that of its units.
    units = [table.decode_bytes(flat[a:b]) for a, b in zip(begin.tolist(), ends.tolist())] if check else []
    counts, digests, doc_ids, made, at = np.frombuffer(row["sizes"].as_py(), "<i4"), row["texts"].as_py(), row["doc_ids"].values, [], 0
    for lo in range(0, len(counts), 256):
        some = counts[lo : lo + 256]
        mine = numbers[at : at + some.sum()]
        at += len(mine)
        times = sizes[mine]
        stops = np.concatenate([[0], np.cumsum(times)])
        found = flat[np.repeat(begin[mine] - stops[:-1], times) + np.arange(stops[-1])]
        cuts = np.concatenate([[0], np.cumsum(some)])
        bounds = stops[cuts]
        same = [None] * len(some)
        if check:
            said = list(map(units.__getitem__, mine.tolist()))
            texts = (table.text(b"".join(said[a:b])) for a, b in zip(cuts.tolist(), cuts[1:].tolist()))
            same = [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) == digests[16 * k : 16 * k + 16] for k, t in enumerate(texts, lo)]
        ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))
        made.append(pa.RecordBatch.from_arrays([doc_ids.slice(lo, 256), pa.array(np.diff(bounds)), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"]))
    tidy()
    return pa.Table.from_batches(made)


def encode(docs: DataFrame, path: str | None = None, check: bool = True, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and round_trip, whether the ids decode to the text, for docs(doc_id, text)."""
    spark, table, rows = docs.sparkSession, PieceTable.load(path or model_path()), id_text(docs)
    shared = spark.sparkContext.broadcast(table)  # as large as the model's table
    n = parts_for(rows)
    packed = rows.mapInArrow(partial(_packed, shared, n, chars), "block long, doc_ids array<long>, sizes binary, texts binary, numbers binary, long array<string>")
    both = packed.groupBy("block").cogroup(unit_ids(rows, shared, n, chars).groupBy("block"))
    return both.applyInArrow(lambda left, right: _encoded(shared, check, left, right), SCHEMA)


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for ``encoded(doc_id, ids)``."""
    shared = spark.sparkContext.broadcast(PieceTable.load(path or model_path()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text": [shared.value.decode(np.asarray(i)) for i in pdf.ids]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again to check the round trip."""
    return encode(read_table(spark, sf_dir, "documents"))


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, n_tokens, ids, round_trip of every document that is left. Its workers have done other stages: small blocks."""
    return encode(docs.select("doc_id", "text"), chars=BLOCK_CHARS // 4)
