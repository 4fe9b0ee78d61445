import io
import struct
import zlib

import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremorline.llm import shared
from tremorline.llm import token_output as O

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def expected(rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIB.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def run(spark, rows):
    return [tuple(r) for r in O.write_and_read(spark.createDataFrame(rows, "doc_id long, text string, shard string"), PATH).collect()]


def test_round_trip(spark):
    rows = [(i * 37 % 101 - 50, t, None) for i, t in enumerate(["Hello world", None, "", "<|endoftext|> x", "é" * 4000, "a\x1cb"] * 9)]
    assert sorted(run(spark, rows)) == sorted(expected([r[:2] for r in rows]))


def test_repeated_and_null_ids(spark):
    rows = [(7, f"text {i % 5}", "s") for i in range(400)] + [(None, "n", "s"), (3, "x", "s"), (9, None, "s")]
    got = sorted(run(spark, rows), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 3, *[7] * 400, 9]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in expected([x[:2] for x in rows]))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_shards_follow_the_bytes(spark):
    def shards(n):
        df = spark.createDataFrame([(i, "word " * 20) for i in range(n)], "doc_id long, text string")
        rows = O.write_shards(df, PATH, shared.scratch(spark, "t"), shard_bytes=2000).orderBy("shard").collect()
        assert sum(r.n_docs for r in rows) == n and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert max(r.n_docs for r in rows) < 40
        return len(rows)

    few, many = shards(200), shards(2000)
    assert 9 * few <= many <= 11 * few


def test_null_ids_are_dealt_over_their_share_of_shards(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(i, "x y z") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = O.write_shards(df, PATH, shared.scratch(spark, "t"), shard_bytes=1500)
    got = sorted(map(tuple, O.read_shards(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 300 + list(range(300)) and got[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows))
    sizes = [r.n_docs for r in manifest.orderBy("shard").collect()]
    assert len(sizes) > 15 and max(sizes) < 80
    only = O.write_shards(df.where("doc_id is null"), PATH, shared.scratch(spark, "t"), shard_bytes=1500)
    assert only.count() > 8 and O.read_shards(only).count() == 300


def test_sizes_beyond_the_format():
    writer = O.ShardWriter(io.BytesIO())
    with pytest.raises(ValueError):
        writer.add(1, b"", 1 << 32, 0)


def test_extra_and_long(spark):
    df = spark.createDataFrame([(1, "word " * 200000, 5, "a"), (1, "word " * 200000, 5, "a"), (2, "b", None, None)], "doc_id long, text string, start int, frame string")
    got = sorted(map(tuple, O.write_and_read(df, PATH).collect()), key=lambda r: r[1])
    assert [r[:3] for r in got] == [(1, 0, 200001), (1, 200001, 200001), (2, 400002, 2)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_format_and_random_access(spark):
    data = O.shard_of([(None, [5, 1]), (2, [1]), (2, [8, 9, 1]), (70000, list(range(5000)))])
    assert struct.unpack("<IBI", data[-9:]) == (5, 0x80, 0x8F92EAB1)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == struct.pack("<5006I", 5, 1, 1, 8, 9, 1, *range(5000))

    class Watched(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    source = Watched(data)
    shard = O.Shard(source)
    before = source.taken
    assert shard.find(2) == [1, 2] and shard.find(None) == [0] and shard.find(1) == []
    assert shard.ids_bytes(2) == struct.pack("<3I", 8, 9, 1) and source.taken - before < 40
    damaged = bytearray(data)
    damaged[int(shard.offsets[2]) + 8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        O.Shard(io.BytesIO(bytes(damaged))).ids_bytes(2)


def test_wanted_documents(spark):
    df = spark.createDataFrame([(i, f"word {i}") for i in range(50)], "doc_id long, text string")
    manifest = O.write_shards(df, PATH, shared.scratch(spark, "t"))
    got = {k: list(v) for k, v in O.read_documents(spark, manifest, [3, 49, 1000])}
    assert got == {k: [*LIB.encode(f"word {k}").ids, 1] for k in (3, 49)}


def test_words_as_library():
    own = O.encoder(PATH)
    assert own.by_chunk and own.letters
    texts = ["Straße, ÉTÉ. aª ºb µm ÿ", "x" * 300 + " don't I'll 'S", "naïve! a.b, .", "日本 語, é̀", "Σας, ς", "A$$$ re%%% are.*** x--- y_ z.) q( _w e...... it's. o'.", "a<| b<|endoftext|> c|> d;;<|endoftext|>"]
    assert [own.encode(t) for t in texts] == [struct.pack(f"<{len(i)}I", *i) for i in (LIB.encode(t).ids for t in texts)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBéßÿ.,;:!?$%*#&-_'\"()<|>/ 1²漢\n\x1c\u0301"), max_size=40))
def test_any_signs_as_library(text):
    assert O.encoder(PATH).encode(text) == struct.pack(f"<{len(i := LIB.encode(text, add_special_tokens=False).ids)}I", *i)


def test_memo_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(O, "MEMO_ENTRIES", 20)
    own = O._Encoder(PATH)
    calls = []
    monkeypatch.setattr(own, "make", lambda chunk, make=own.make: calls.append(chunk) or make(chunk))
    text = " ".join(f"the {a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert calls.count("the") == 1 and len(own) + len(own.older) <= 20
