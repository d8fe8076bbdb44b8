"""Text expressions: trimming, names, tokens, sentence and paragraph chunks. All are Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming removes.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# What ends a sentence, and what stands between the words that are embedded.
SENTENCE_END = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])"""
NO_TOKEN = "[^a-z0-9_]+"
# The usual sizes of chunks and slugs.
SENTENCE_CHARS = 800
PARAGRAPH_CHARS = 1400
SLUG_CHARS = 48


def trim_white(c: Column) -> Column:
    """Without white space of any script at both ends; in time linear in the text."""
    return F.trim(c, F.lit(WHITE))


def name_key(c: Column) -> Column:
    """The form in which names are compared."""
    return F.lower(trim_white(c))


def slugify(c: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single hyphens, none at the ends, then cut to SLUG_CHARS."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(plain, 1, SLUG_CHARS)


def prompt_tokens(c: Column) -> Column:
    """Lower-case words of three or more characters, punctuation kept, repeats kept."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: F.length(t) > 2)


def embed_tokens(c: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and underscore."""
    return F.filter(F.split(F.lower(c), NO_TOKEN), lambda w: w != "")


def trigrams(word: Column) -> Column:
    """All three-character substrings; none for shorter words."""
    places = F.sequence(F.lit(1), F.length(word) - 2)
    return F.when(F.length(word) >= 3, F.transform(places, lambda i: F.substring(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def text_trigrams(c: Column) -> Column:
    """The distinct three-character strings of a text, in time linear in it. Strings that begin inside a character beyond the
    first plane come along; they are the same wherever the same characters stand."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), 1))


def sentences(c: Column) -> Column:
    """Cut after . ! ? and white space before a capital, a digit or an opening quote or bracket."""
    text = trim_white(F.regexp_replace(c, "\r\n", "\n"))
    parts = F.split(text, SENTENCE_END)
    return F.filter(F.transform(parts, trim_white), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Cut at blank lines; trimmed, none empty."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), trim_white), lambda s: s != "")


def _pieces(c: Column, size: int) -> Column:
    """A string in pieces of ``size`` characters, cut in one go."""
    return F.when(c == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), 0))


def _flushed(state: Column) -> Column:
    return F.when(state["cur"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["cur"])))


def _start() -> Column:
    return F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))


def sentence_chunks(c: Column, size: int = SENTENCE_CHARS) -> Column:
    """Sentences packed in order into chunks of at most ``size`` characters; a longer sentence stands in pieces of its own."""
    if size < 1:
        raise ValueError("a chunk needs at least one character")

    def step(a: Column, s: Column) -> Column:
        split = F.struct(F.concat(_flushed(a), _pieces(s, size)).alias("out"), F.lit("").alias("cur"))
        full = F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), s.alias("cur"))
        more = F.struct(a["out"].alias("out"), F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s)).alias("cur"))
        over = (a["cur"] != "") & (F.length(a["cur"]) + F.length(s) + 1 > size)
        return F.when(F.length(s) > size, split).when(over, full).otherwise(more)

    return F.aggregate(sentences(c), _start(), step, _flushed)


def paragraph_chunks(c: Column, size: int = PARAGRAPH_CHARS) -> Column:
    """Paragraphs packed with a blank line between them; afterwards chunks over ``size`` are cut in pieces."""
    if size < 1:
        raise ValueError("a chunk needs at least one character")

    def step(a: Column, p: Column) -> Column:
        full = F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), p.alias("cur"))
        more = F.struct(a["out"].alias("out"), F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p)).alias("cur"))
        over = (a["cur"] != "") & (F.length(a["cur"]) + F.length(p) + 2 > size)
        return F.when(over, full).otherwise(more)

    packed = F.aggregate(paragraphs(c), _start(), step, _flushed)
    return F.flatten(F.transform(packed, lambda x: _pieces(x, size)))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of places with the same word in any case, over the shorter text; 0 if either has no word."""
    words = lambda c: F.filter(F.split(F.lower(trim_white(c)), r"\s+"), lambda w: w != "")
    n = F.least(F.size(words(a)), F.size(words(b)))
    pairs = F.zip_with(F.slice(words(a), 1, F.greatest(n, F.lit(1))), F.slice(words(b), 1, F.greatest(n, F.lit(1))), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.when(n > 0, F.round(F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / n, 3)).otherwise(F.lit(0.0))
