import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tremorline.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "a  b", "<s>x</s>", "<0x0A>", "\n\n", "Hello\nworld\r\n\t x", "▁▁a", "漢字🙂🙂", "naïve  café   œuvre", "a\x00b\x01", "x" * 500, "漢" * 300, "ab" * 400, " " * 70, "　\xa0"])
def test_as_library(text):
    assert C.counter(PATH).count(text) == len(LIB.encode(text))


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert C.counter(PATH).count(text) == len(LIB.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(" \nthea.inérsé▁", max_size=200))
def test_likely_text(text):
    assert C.counter(PATH).count(text) == len(LIB.encode(text))


def test_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "the cat"), (3, "é" * 5000)], "doc_id long, text string")
    rows = sorted(map(tuple, C.count_tokens(df, PATH).collect()), key=str)
    assert rows == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 7, 2, False), (3, 10000, len(LIB.encode("é" * 5000)), len(LIB.encode("é" * 5000)) > 4096)], key=str)
    assert C.count_tokens(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        C.count_tokens(df.selectExpr("doc_id N_TOKENS", "text"), PATH)
