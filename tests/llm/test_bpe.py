import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpe
from tests.llm.fixtures import docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def made():
    return bpe.Tokenizer(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n\n\tx ", "it's we'll I'D", "10² ½ ①", "日本語のテキスト", "é‍👩‍🚀", "<|endoftext|>", "x" * 700, "ab" * 400 + " " + "-" * 300, "   z", "\x00\x1f\x85", "naïve coöperation überführt"]


def test_odd_texts_equal_the_library(made, library):
    for got, text in zip(made.encode(ODD), ODD):
        assert got.tolist() == library.encode_ordinary(text), text
    assert made.decode(made.encode(ODD)) == [t.encode() for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab c's\n.1é", max_size=80)), max_size=6))
def test_any_texts_equal_the_library(made, library, texts):
    got = made.encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert made.decode(got) == [t.encode() for t in texts]


def test_plain_expression_is_the_pattern():
    import regex

    cut = regex.compile(P.PATTERN).findall
    assert bpe.PATTERN == P.PATTERN
    for cp in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        for text in (f"a{chr(cp)}1 {chr(cp)}.", f"{chr(cp)}{chr(cp)} {chr(cp)}'s \n{chr(cp)} "):
            assert not bpe._OTHER(text) and bpe._PLAIN(text) == cut(text), hex(cp)


def test_long_words_contract_by_the_same_rule(made, library):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 200))) for _ in range(300)]
    for got, word in zip(made._contracted([w.encode() for w in words]), words):
        want = bpe.contract(word.encode(), made.ranks)
        assert np.frombuffer(got, "<i4").tolist() == want == library._core_bpe.encode_single_piece(word.encode()) or word.encode() in made.ranks
    long = "".join(rng.choice("abcdeé") for _ in range(50_000))
    assert made.encode([long])[0].tolist() == library.encode_ordinary(long)


def test_caches_and_parts_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 20)
    monkeypatch.setattr(bpe, "QUERY_IDS", 5)
    small = bpe.Tokenizer(PATH, P.PATTERN)
    texts = ["some words thrownxq in " + w for w in ("zzqy", "quorlen", "z" * 60, "")] * 2
    for _ in range(2):
        got = small.encode(texts)
        assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
        assert small.decode(got) == [t.encode() for t in texts]


def test_query_on_whole_table(spark, sf, library):
    rows = bpe.op11_byte_bpe(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(spark):
    got = bpe.round_trip(docs(spark, [None, "", "a b", "a b", "\u0000x"], [1, 2, None, 3, 3]), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in got) == [(False, 1, b""), (False, 2, b""), (False, 3, b"\0x"), (False, 3, b"a b"), (True, 0, b"a b")]
    assert bpe.encode(docs(spark, []), PATH, P.PATTERN).count() == 0
    tokens = bpe.encode(docs(spark, ["one two", None]), PATH, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in bpe.decode(tokens, PATH, P.PATTERN).collect()) == [b"", b"one two"]
