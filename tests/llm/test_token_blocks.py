import zlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import token_blocks as tb
from tests.llm.fixtures import docs, table

ODD = ["", None, "a  b\n\n c ", "<|endoftext|> x<|endoftext|>", "it's  \t x \n y", "é　中文 🙂 z", "w " * 5000, "same", "same"]


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tb.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def expected(ids, texts):
    rows, start = [], 0
    for i, got in sorted(zip(ids, brute(texts)), key=lambda x: x[0]):
        rows.append((i, start, len(got), zlib.crc32(np.asarray(got, "<u4").tobytes())))
        start += len(got)
    return rows


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
@settings(max_examples=80, deadline=None)
def test_block_round_trip(values, share):
    values = np.asarray(values, np.uint32)
    assert (tb.unpack_block(memoryview(tb.pack_block(values, share)), len(values)) == values).all()


def test_segment_gives_any_range():
    ids = np.arange(5000, dtype=np.uint32) * 7 % 4999
    data = tb.pack_segment(ids, [1000, 0, 4000], block=256)
    assert (tb.read_ids(data) == ids).all()
    assert (tb.read_ids(data, 777, 1301) == ids[777:1301]).all()
    assert tb.read_ids(data, 9, 9).size == 0


@given(st.text(alphabet="ab '.\n\t 　é1s<|endoftext|>", max_size=40))
@settings(max_examples=200, deadline=None)
def test_word_cache_equals_library(text):
    if not hasattr(test_word_cache_equals_library, "e"):
        test_word_cache_equals_library.e = tb.WordEncoder(tb.tokenizer_path())
    e = test_word_cache_equals_library.e
    assert np.frombuffer(e([text])[0], "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_query_equals_brute_force(spark, tmp_path):
    ids = [40, 7, 3, 100, 9, 8, 1, 2, 0]
    sf = table(spark, tmp_path, "documents", docs(spark, ODD, ids))
    got = [tuple(r) for r in tb.op6_token_blocks(spark, sf).orderBy("doc_id").collect()]
    assert got == expected(ids, ODD)


def test_query_on_test_table(spark, sf):
    pdf = pd.read_parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in tb.op6_token_blocks(spark, sf).orderBy("doc_id").collect()]
    assert got == expected(pdf.doc_id.tolist(), pdf.text.tolist())


def test_empty_table(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", docs(spark, []))
    assert tb.op6_token_blocks(spark, sf).collect() == []
