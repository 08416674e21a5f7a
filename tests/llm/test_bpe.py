import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import bpe
from quernstone.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(PATH)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_reference_encoder(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_long_piece_without_breaks(both):
    for text in ("ab" * 20_000, "日本" * 3000, " " * 5000, "<|endoftext|>", "a\u0000b"):
        assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_table(spark, both):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")], "doc_id long, text string").selectExpr("*", "'x' AS ids2")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_table(df, "doc_id", "text", PATH).collect())
    hello = both[1].encode_ordinary("Hello world")
    assert got == [(1, []), (2, []), (3, hello), (3, hello)]
    assert bpe.encode_table(df.where("false"), "doc_id", "text", PATH).count() == 0
