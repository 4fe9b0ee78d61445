import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremorline.llm import bpe_codec as B

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def both(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    own = B.codec(PATH)
    assert own.encode(text) == ids
    assert own.decode(own.encode_bytes(text)) == LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "Hello, wörld it's 42", "<|endoftext|>x<|startoftext|", "a<|endoftext|><|endoftext|>b", "ΣΑΣ İÍ é", "\x1c\x1d a\x1fb", "don't've'LL", "՘㐀 漢字かな 🙂🏽", "à́ ́x", "½²Ⅷ٣", "\x00\x85 z"])
def test_as_library(text):
    both(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    both(text)


@settings(max_examples=60, deadline=None)
@given(st.text("abehinorst", min_size=200, max_size=3000))
def test_long_words_stream(text):
    both(text)


def test_small_buffers_give_the_same_tokens():
    own, rnd = B.codec(PATH), random.Random(5)
    for _ in range(200):
        word = "".join(rnd.choice(["th", "e", "ing", "an", "a", "aa", "r", "q", "tion", "haha"]) for _ in range(rnd.randint(40, 300)))
        ids = [*map(own.inner.__getitem__, word[:-1]), own.final[word[-1]]]
        machine, out = B.WordTransducer(own.table), []
        machine.limit = own.table.lookahead + 40
        for i in range(0, len(ids) - 1, 7):
            out += machine.feed(ids[i : min(i + 7, len(ids) - 1)])
            assert len(machine.held) <= 2 * machine.limit
        assert out + machine.end(ids[-1:]) == own.table.merge(ids)


def test_state_machine_holds_back_little():
    data = "aé漢🙂".encode() + b"\xf0\x9f\x99" + b"\xff\xc3(" + b"\xe2\x82"
    machine = B.Utf8Machine()
    out = "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.end()
    assert out == data.decode("utf-8", "replace")


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", None), (None, "The cat", "y")], "doc_id long, text string, source string")
    rows = {(r.doc_id, r.text, r.source): r for r in B.encode_documents(df, PATH).collect()}
    assert rows[(1, None, "x")].n_tokens == 0 and rows[(2, "", None)].decoded == ""
    assert rows[(None, "The cat", "y")].n_tokens == 2
    with pytest.raises(ValueError):
        B.encode_documents(df.withColumn("IDS", df.doc_id), PATH)
    assert B.encode_documents(df.limit(0), PATH).count() == 0


def test_every_word_of_documents_goes_through_the_transducer(monkeypatch):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    own = B.Codec(PATH)
    merged = []
    monkeypatch.setattr(own.table, "merge", lambda ids, merge=own.table.merge: merged.append(len(ids)) or merge(ids))
    seen = set()
    for t in texts:
        assert own.encode(t) == LIB.encode(t, add_special_tokens=False).ids
        seen |= {w for chunk in own.words(t) for w in own._normal(chunk)}
    # each merge is the transducer's, at a word's end or when it settles; no word is left out
    assert own.machine.words >= len(seen) > 1000 and own.machine.words <= len(merged)
    assert own.machine.peak <= 2 * own.machine.limit and own.machine.held == []
    # nothing of a word is stable before the lookahead is known
    assert max(map(len, seen)) < own.table.lookahead


def test_segments_and_buffers_are_bounded():
    own, rnd = B.Codec(PATH), random.Random(8)
    text = " ".join("".join(rnd.choice("abehinorst\n") for _ in range(rnd.randint(1, 12))) for _ in range(60000)) + " " + "the" * 70000
    parts = list(own.segments(text))
    assert "".join(parts) == text and max(map(len, parts[:-2])) <= B.SEGMENT + 1 and len(parts) > 5
    assert own.encode(text) == LIB.encode(text, add_special_tokens=False).ids
    assert B.SEGMENT < len("the" * 70000) and own.machine.peak <= 2 * own.machine.limit
    machine, out = own.decoder(), []
    for raw in own.pieces(text):
        out.append(machine.feed(raw))
    assert "".join(out) + machine.end() == LIB.decode(own.encode(text), skip_special_tokens=False)
