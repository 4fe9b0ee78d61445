import hashlib
import random
import zlib

import numpy as np

from tremorline.llm import media_audio as M


def test_laws_expand_known_codes():
    mu, a = M.TABLES[M.MULAW], M.TABLES[M.ALAW]
    assert [mu[x] for x in (0x00, 0x80, 0xFF, 0x7F, 0x8F, 0x0F)] == [-32124, 32124, 0, 0, 16764, -16764]
    assert [a[x] for x in (0xD5, 0x55, 0xAA, 0x2A, 0x80)] == [8, -8, 32256, -32256, 5504]
    for law in (M.MULAW, M.ALAW):
        codes = np.arange(256, dtype=np.uint8)
        assert (M.expand(M.compress(M.expand(codes, law), law), law) == M.expand(codes, law)).all()


def scalar_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(M.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if nibble & bit:
                    diff += part
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(value)
    return out


def test_adpcm_as_one_by_one():
    rnd = random.Random(1)
    blocks = [bytes(rnd.randrange(256) for _ in range(64)) for _ in range(40)]
    got = M.adpcm_decode(np.frombuffer(b"".join(blocks), dtype=np.uint8).reshape(-1, 64))
    assert got.tolist() == [scalar_adpcm(b) for b in blocks]


def test_adpcm_follows_a_tone():
    tone = (8000 * np.sin(np.arange(2420) / 12)).astype(np.int16)
    back = M.adpcm_decode(M.adpcm_encode(tone)).ravel()[: len(tone)]
    assert np.abs(back[200:].astype(int) - tone[200:]).mean() < 700


def test_rates():
    tone = (8000 * np.sin(np.arange(800) / 9)).astype(np.int16)
    wide = M.double_rate(tone)
    assert (wide[::2] == tone).all() and np.abs(wide[20:-20].astype(int) - (8000 * np.sin(np.arange(1600) / 18))[20:-20]).max() < 40
    two = M.double_rate(np.concatenate([tone, tone[:5], tone[:1]]), np.array([0, 800, 805]))
    assert (two == np.concatenate([wide, M.double_rate(tone[:5]), M.double_rate(tone[:1])])).all()
    other = M.resample(tone, 8000, 11025)
    want = 8000 * np.sin(np.arange(len(other)) * (8000 / 11025) / 9)
    assert np.abs(other[40:-40] - want[40:-40]).max() < 120


def test_files_keep_every_byte():
    for kind in (M.MULAW, M.ALAW, M.ADPCM, M.PCM):
        data = bytes(range(256)) * 2
        assert M.unwrap(M.wrap(data, kind))[3] == data
        (packed,) = M.stored_pcm([M.wrap(data, kind)])
        assert M.unwrap(M.pcm_file(packed))[:2] == (M.PCM, 16000) and (M.pcm_of(packed)[1] == M.to_pcm(M.wrap(data, kind))).all()
    assert M.unwrap(M.wrap(b"abc"))[3] == b"abc"
    assert M.unwrap(b"RIFF") is None and M.unwrap(None) is None and M.to_pcm(b"nothing") is None and M.unwrap(M.wrap(b"abc" * 9)[:-9]) is None


def test_texts(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 5000), (4, "é" * 5000), (None, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.features(M.store_texts(df)).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        data = M.payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.wrap(data)).hexdigest() and r.media_bytes == len(M.wrap(data))
        (packed,) = M.stored_pcm([M.wrap(data)])
        assert r.feature == M._features([data], [packed])[0] and by.setdefault(text, r.feature) == r.feature
        wide = M.double_rate(M.expand(np.frombuffer(data, dtype=np.uint8), M.MULAW))
        assert r.feature.endswith(f"pcm16k:crc32={zlib.crc32(wide.astype('<i2').tobytes())}") and r.pcm_bytes == len(packed)
    assert len(M.payload("")) == 64 and len(M.payload("x" * 64)) == 64
    assert M.features(M.store_texts(df.limit(0))).count() == 0
    pcm = M.add_pcm(M.store_texts(df).drop("pcm")).collect()
    stored = {(r.doc_id, r.n_bytes): r.pcm for r in M.store_texts(df).collect()}
    assert all(M.pcm_of(r.pcm)[0] == 16000 and r.pcm == stored[r.doc_id, r.n_bytes] for r in pcm)


def test_lifting_keeps_every_sample():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 7, 500):
        for pcm in (rng.integers(-32768, 32768, n).astype(np.int16), np.full(n, -32768, dtype=np.int16)):
            packed = M.pack(*M.lift(pcm), 11025)
            rate, back = M.pcm_of(packed)
            assert rate == 11025 and (back == pcm).all() and len(back) == n
    signals = [rng.integers(-32768, 32768, 2 * n).astype(np.int16) for n in (1, 64, 3)]
    starts = np.array([0, 2, 130])
    even, detail = M.lift(np.concatenate(signals), starts)
    assert (M.unlift(even, detail, starts // 2) == np.concatenate(signals)).all()
    assert (M.lift(M.double_rate(signals[1]))[1] == 0).all()


def test_kinds_and_damaged_media():
    data = bytes(range(256)) * 2
    media = [M.wrap(data, M.MULAW), None, b"no media", M.wrap(data, M.ALAW), M.wrap(data, M.ADPCM), M.wrap(data, M.MULAW, 11025), M.wrap(b"", M.MULAW), M.wrap(data, M.PCM, 16000)]
    got = M.stored_pcm(media)
    assert [g is None for g in got] == [m is None or m == b"no media" for m in media]
    for m, g in zip(media, got):
        if g is not None:
            assert (M.pcm_of(g)[1] == M.to_pcm(m)).all()
    assert len(M.pcm_of(got[6])[1]) == 0


def test_clashing_columns_and_long_texts(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(M, "GROUP", 1000)
    df = spark.createDataFrame([(1, "long " * 50000, b"x", 3), (2, "s", None, 4)], "doc_id long, text string, media binary, n_bytes int")
    got = {r.doc_id: r for r in M.features(M.store_texts(df)).collect()}
    assert got[1].n_bytes == 250000 and got[2].payload_bytes == 64
    with pytest.raises(ValueError):
        M.add_pcm(df, name="N_BYTES")
    assert [r.pcm for r in M.add_pcm(df).collect()] == [None, None]
