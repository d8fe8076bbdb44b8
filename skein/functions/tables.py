"""Table functions for SQL: texts cut into chunks, joined laterally to the rows they come from.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL sentence_chunks(d.text, 800) c

The rows are those of the column functions ``sentence_chunks`` and ``paragraph_chunks``, with their places in the text's chunks; the work
is linear in the text. ``analyze`` checks the arguments when the query is planned: a size has to be a constant of one or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, ShortType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from skein.functions.text import PARAGRAPH_CHARS, SENTENCE_CHARS, WHITE

# The same ends of sentences and paragraphs as in the column functions; white space is that of ASCII.
_SENTENCE_END = re.compile(r"""(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9"'(])""")
_PARAGRAPH_END = re.compile(r"\n[ \t\n\x0b\f\r]*\n")
_CHUNK = StructType().add("chunk_index", IntegerType()).add("text", StringType()).add("char_count", IntegerType())


def _packed(parts: list[str], gap: str, size: int, split: bool) -> Iterator[str]:
    """Parts packed in order into chunks of ``size`` characters; with ``split`` a longer part ends the chunk and stands in pieces."""
    held, length = [], 0
    for part in parts:
        alone = split and len(part) > size
        if held and (alone or length + len(gap) + len(part) > size):
            yield gap.join(held)
            held, length = [], 0
        if alone:
            yield from (part[i : i + size] for i in range(0, len(part), size))
        else:
            length += len(part) + (len(gap) if held else 0)
            held.append(part)
    if held:
        yield gap.join(held)


def sentence_pieces(text: str, size: int) -> Iterator[str]:
    """The chunks of ``sentence_chunks``."""
    parts = (p.strip(WHITE) for p in _SENTENCE_END.split(text.replace("\r\n", "\n").strip(WHITE)))
    return _packed([p for p in parts if p], " ", size, True)


def paragraph_pieces(text: str, size: int) -> Iterator[str]:
    """The chunks of ``paragraph_chunks``: what is too long is cut after packing."""
    parts = (p.strip(WHITE) for p in _PARAGRAPH_END.split(text))
    for chunk in _packed([p for p in parts if p], "\n\n", size, False):
        yield from (chunk[i : i + size] for i in range(0, len(chunk), size))


def _checked(text: AnalyzeArgument, size: AnalyzeArgument | None) -> AnalyzeResult:
    if not isinstance(text.dataType, StringType):
        raise ValueError("the first argument is a text")
    if size is not None:
        if not isinstance(size.dataType, (ShortType, IntegerType, LongType)) or size.value is None:
            raise ValueError("the size of a chunk is a constant whole number")
        if size.value < 1:
            raise ValueError("a chunk needs at least one character")
    return AnalyzeResult(_CHUNK)


class SentenceChunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _checked(text, size)

    def eval(self, text: str, size: int = SENTENCE_CHARS):
        for i, chunk in enumerate(sentence_pieces(text, size) if text is not None else ()):
            yield i, chunk, len(chunk)


class ParagraphChunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _checked(text, size)

    def eval(self, text: str, size: int = PARAGRAPH_CHARS):
        for i, chunk in enumerate(paragraph_pieces(text, size) if text is not None else ()):
            yield i, chunk, len(chunk)


def register(spark: SparkSession) -> None:
    """``sentence_chunks(text [, size])`` and ``paragraph_chunks(text [, size])`` for the session's SQL; rows travel in Arrow batches."""
    spark.udtf.register("sentence_chunks", udtf(SentenceChunks, useArrow=True))
    spark.udtf.register("paragraph_chunks", udtf(ParagraphChunks, useArrow=True))
