"""Telephony audio in a binary column: mu-law, A-law and ADPCM to resampled PCM.

A media value is a RIFF/WAVE file in memory.  ``wrap`` stores 8-bit samples as they
are (mu-law, A-law or ADPCM blocks); ``unwrap`` reads the stored bytes back.  mu-law
and A-law expand by 256-entry tables computed from their rules, for a whole batch at
once; ADPCM blocks decode side by side, one numpy step for the n-th sample of all
blocks; PCM is resampled to twice its rate by a half-band filter in whole numbers,
or to any rate by a windowed-sinc filter.

Resampled PCM is stored as 16-bit samples without loss, after one lifting step: every
second sample as it is, the others as differences from what the half-band filter
expects between their neighbours; differences that are all zero are left out.

Defined results: null text counts as empty; an empty payload is padded to one block;
media that isn't a supported file gives null PCM; equal inputs give equal values, so
repeated rows and ties give repeated results; null ids are carried along; an empty table
gives an empty table; texts may have any length that a row may have, as media go through
memory one batch of about ``GROUP`` bytes, or one longer text, at a time; extra columns
are ignored by ``store_texts`` and kept by ``add_pcm``.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

RATE = 8000
#: The zstandard level of stored media, which stay.
LEVEL = 9
BLOCK = 64
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17

#: Step sizes and index changes of the public IMA ADPCM format.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw(), ALAW: _alaw()}


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the change of the sample, and the next index."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    change = np.where(nibble & 8, -size, size).astype(np.int32)
    following = np.clip(np.arange(len(STEPS))[:, None] + CHANGES[nibble & 7], 0, len(STEPS) - 1).astype(np.int32)
    return change, following


CHANGE, FOLLOWING = _adpcm_tables()


def expand(samples: np.ndarray, law: int) -> np.ndarray:
    """8-bit mu-law or A-law samples to 16-bit PCM."""
    return TABLES[law][samples]


def compress(pcm: np.ndarray, law: int) -> np.ndarray:
    """The nearest 8-bit code of each sample."""
    table = TABLES[law].astype(np.int32)
    order = np.argsort(table, kind="stable")
    levels = table[order]
    at = np.clip(np.searchsorted(levels, pcm), 1, len(levels) - 1)
    lower = pcm - levels[at - 1] <= levels[at] - pcm
    return order[at - lower].astype(np.uint8)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n x block bytes) to n x (2 * (bytes - 4) + 1) samples."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = value
    change, following = CHANGE.ravel(), FOLLOWING.ravel()
    for i, code in enumerate(codes):
        for k, nibble in enumerate((code & 15, code >> 4)):
            at = (index << 4) + nibble
            value += change[at]
            np.clip(value, -32768, 32767, out=value)
            index = following[at]
            out[1 + 2 * i + k] = value
    return out.T


def adpcm_encode(pcm: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Blocks of the samples, the last one filled up with its last sample; many blocks side by side."""
    per = 2 * (size - 4) + 1
    n = max(1, -(-len(pcm) // per))
    rows = np.full(n * per, pcm[-1] if len(pcm) else 0, dtype=np.int32)
    rows[: len(pcm)] = pcm
    rows = rows.reshape(n, per).T
    blocks = np.zeros((n, size), dtype=np.uint8)
    value, index = rows[0].copy(), np.zeros(n, dtype=np.int32)
    blocks[:, 0], blocks[:, 1] = value & 255, value >> 8 & 255
    for i in range(1, per):
        reached = np.clip(value[:, None] + CHANGE[index], -32768, 32767)
        nibble = np.abs(reached - rows[i][:, None]).argmin(axis=1)
        value, index = reached[np.arange(n), nibble], FOLLOWING[index, nibble]
        blocks[:, 4 + (i - 1) // 2] |= (nibble << (0 if i % 2 else 4)).astype(np.uint8)
    return blocks


def between(pcm: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """What the half-band filter (-1, 9, 9, -1)/16 expects between each sample and the next.

    ``starts`` are the places where signals of a batch begin; none reaches into another.
    """
    x = pcm.astype(np.int32)
    n = len(x)
    if not n:
        return np.empty(0, dtype=np.int16)
    before, after, later = np.roll(x, 1), np.roll(x, -1), np.roll(x, -2)
    starts = np.array([0]) if starts is None else starts
    ends = np.append(starts[1:], n)
    before[starts] = x[starts]
    after[ends - 1] = later[ends - 1] = x[ends - 1]
    inner = ends - 2 >= starts
    later[ends[inner] - 2] = x[ends[inner] - 1]
    return np.clip((9 * (x + after) - before - later + 8) >> 4, -32768, 32767).astype(np.int16)


def interleave(even: np.ndarray, odd: np.ndarray) -> np.ndarray:
    out = np.empty(len(even) + len(odd), dtype=np.int16)
    out[0::2], out[1::2] = even, odd
    return out


def double_rate(pcm: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Twice the rate: each sample, then what is expected between it and the next."""
    return interleave(pcm, between(pcm, starts))


def lift(pcm: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Every second sample, and how the others differ (modulo 2**16) from what is expected there; several signals must be of even lengths."""
    even, odd = pcm[0::2], pcm[1::2]
    return even, odd - between(even, None if starts is None else starts // 2)[: len(odd)]


def unlift(even: np.ndarray, detail: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The signal that lift() took apart; ``starts`` are places among the even samples."""
    return interleave(even, between(even, starts)[: len(detail)] + detail)


HEAD = struct.Struct("<4sII")


def pack(even: np.ndarray, detail: np.ndarray, rate: int) -> bytes:
    return HEAD.pack(b"PCML", rate, len(even) + len(detail)) + even.astype("<i2").tobytes() + (detail.astype("<i2").tobytes() if detail.any() else b"")


def unpack(packed: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(rate, even samples, details) of a stored PCM value."""
    mark, rate, n = HEAD.unpack_from(packed)
    evens = (n + 1) // 2
    if mark != b"PCML" or len(packed) not in (HEAD.size + 2 * n, HEAD.size + 2 * evens):
        raise ValueError("not a stored PCM value")
    samples = np.frombuffer(packed, dtype="<i2", offset=HEAD.size)
    return rate, samples[:evens], samples[evens:] if len(samples) == n else np.zeros(n - evens, dtype=np.int16)


def pcm_of(packed: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a stored PCM value."""
    rate, even, detail = unpack(packed)
    return rate, unlift(even, detail)


def pcm_file(packed: bytes) -> bytes:
    """A stored PCM value as a RIFF/WAVE file."""
    rate, pcm = pcm_of(packed)
    return wrap(pcm.astype("<i2").tobytes(), PCM, rate)


def resample(pcm: np.ndarray, rate: int, target: int, lobes: int = 8, chunk: int = 1 << 16) -> np.ndarray:
    """16-bit PCM at any other rate by a windowed-sinc filter, in chunks."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    n = -(-len(pcm) * target // rate)
    low = min(1.0, target / rate)
    reach = math.ceil(lobes / low)
    padded = np.pad(pcm.astype(np.float64), (reach, reach + 1), mode="edge")
    out = np.empty(n, dtype=np.int16)
    for start in range(0, n, chunk):
        at = np.arange(start, min(start + chunk, n)) * (rate / target)
        whole = np.floor(at).astype(np.int64)
        places = np.arange(-reach, reach + 1)
        distance = places[None, :] - (at - whole)[:, None]
        taps = low * np.sinc(low * distance) * (0.5 + 0.5 * np.cos(np.pi * np.clip(distance / (reach + 1), -1, 1)))
        taps /= taps.sum(axis=1, keepdims=True)
        found = (padded[np.minimum(whole[:, None] + places + reach, len(padded) - 1)] * taps).sum(axis=1)
        out[start : start + len(at)] = np.clip(np.rint(found), -32768, 32767)
    return out


# files


def wrap(payload: bytes, kind: int = MULAW, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono RIFF/WAVE file that holds the payload as it is."""
    bits, align = {PCM: (16, 2), ADPCM: (4, block)}.get(kind, (8, 1))
    per_block = 2 * (block - 4) + 1
    count = len(payload) // 2 if kind == PCM else len(payload) // block * per_block if kind == ADPCM else len(payload)
    speed = rate * block // per_block if kind == ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", kind, 1, rate, speed, align, bits) + (b"" if kind == PCM else struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0))
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, count)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(kind, rate, block bytes, payload) of a stored file; None if it isn't one that we support."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if fmt is None or fmt[1] != 1 or fmt[0] not in (PCM, ALAW, MULAW, ADPCM) or at + 8 + size > len(media):
                return None
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def to_pcm(media: bytes | None, target: int = 2 * RATE) -> np.ndarray | None:
    """The stored file's samples at the target rate."""
    if (found := unwrap(media)) is None:
        return None
    kind, rate, block, payload = found
    if kind == PCM:
        pcm = np.frombuffer(payload, dtype="<i2")
    elif kind == ADPCM:
        if block <= 4 or len(payload) % block:
            return None
        pcm = adpcm_decode(np.frombuffer(payload, dtype=np.uint8).reshape(-1, block)).ravel()
    else:
        pcm = expand(np.frombuffer(payload, dtype=np.uint8), kind)
    return double_rate(pcm) if target == 2 * rate else resample(pcm, rate, target)


def stored_pcm(media: list[bytes | None], target: int = 2 * RATE) -> list[bytes | None]:
    """The PCM values of media: 8-bit companded ones of half the rate together, all others one by one."""
    out: list[bytes | None] = [None] * len(media)
    together: dict[int, list[tuple[int, bytes]]] = {MULAW: [], ALAW: []}
    for i, m in enumerate(media):
        found = unwrap(m)
        if found and found[0] in together and 2 * found[1] == target and found[3]:
            together[found[0]].append((i, found[3]))
        elif (pcm := to_pcm(m, target)) is not None:
            out[i] = pack(*lift(pcm), target)
    for law, own in together.items():
        if own:
            counts = np.array([len(p) for _, p in own])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            wide = double_rate(expand(np.frombuffer(b"".join(p for _, p in own), dtype=np.uint8), law), starts)
            even, detail = lift(wide, 2 * starts)
            for (i, _), s, n in zip(own, starts.tolist(), counts.tolist(), strict=True):
                out[i] = pack(even[s : s + n], detail[s : s + n], target)
    return out


def groups(batch: pa.RecordBatch, column: int):
    """Parts of a batch of about GROUP bytes of a column."""
    lo = size = 0
    for hi, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 1):
        size += n
        if size >= GROUP or hi == batch.num_rows:
            yield batch.slice(lo, hi - lo)
            lo, size = hi, 0


def add_pcm(df: DataFrame, media: str = "media", name: str = "pcm", target: int = 2 * RATE) -> DataFrame:
    """Adds the resampled PCM of a media column as it is stored (null where media can't be read)."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name!r} exists already")
    at = df.columns.index(media)

    def run(batches):
        for batch in batches:
            for part in groups(batch, at):
                new = pa.array(stored_pcm(part.column(at).to_pylist(), target), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


# texts as payloads


def padding(size: int, unit: int = BLOCK) -> int:
    """Bytes 0 that are missing to a positive multiple of the unit."""
    return max(unit, -(-size // unit) * unit) - size


def payload(text: str | None, unit: int = BLOCK) -> bytes:
    """UTF-8 bytes, then bytes 0 up to a positive multiple of the unit."""
    data = (text or "").encode("utf-8")
    return data + b"\0" * padding(len(data), unit)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, pcm): each text's payload as a mu-law file and as resampled PCM, written to the shared folder."""

    def run(batches):
        for batch in batches:
            for part in groups(batch, 1):
                data = [(t or "").encode("utf-8") for t in part.column(1).to_pylist()]
                media = [wrap(d + b"\0" * padding(len(d))) for d in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary()), pa.array(stored_pcm(media), pa.binary())], names=["doc_id", "n_bytes", "media", "pcm"])
        shared.release()

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return shared.materialize(own.mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary"), "media", LEVEL)


FEATURES = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("pcm_bytes", T.LongType()))]
)
#: Payload bytes decoded side by side.
GROUP = 1 << 20


def _sums(pcm: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """Of each signal: root mean square, peak and sign changes, in whole numbers."""
    x = pcm.astype(np.int32)
    square = np.add.reduceat((x * x.astype(np.int64)), starts)
    peak = np.maximum.reduceat(np.abs(x), starts)
    flips = np.zeros(len(x), dtype=np.int32)
    flips[1:] = (x[1:] < 0) != (x[:-1] < 0)
    flips[starts] = 0
    crossings = np.add.reduceat(flips, starts)
    return [(math.isqrt(int(s) // int(n)), int(p), int(c)) for s, n, p, c in zip(square, counts, peak, crossings, strict=True)]


def _features(payloads: list[bytes], stored: list[bytes]) -> list[str]:
    """What a payload sounds like as mu-law, as A-law and as ADPCM blocks, and a checksum of the stored PCM's samples."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    counts = np.array([len(p) for p in payloads], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    parts = {"mulaw": _sums(expand(data, MULAW), starts, counts), "alaw": _sums(expand(data, ALAW), starts, counts)}
    per = 2 * (BLOCK - 4) + 1
    decoded = adpcm_decode(data.reshape(-1, BLOCK)).ravel()
    parts["adpcm"] = _sums(decoded, starts // BLOCK * per, counts // BLOCK * per)
    read = [unpack(p) for p in stored]
    wide = unlift(np.concatenate([even for _, even, _ in read]), np.concatenate([detail for *_, detail in read]), starts).astype("<i2")
    checks = [zlib.crc32(wide[2 * s : 2 * (s + n)]) for s, n in zip(starts, counts, strict=True)]
    return [";".join(f"{name}:rms={r[i][0]},peak={r[i][1]},crossings={r[i][2]}" for name, r in parts.items()) + f";pcm16k:crc32={checks[i]}" for i in range(len(payloads))]


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of what store_texts() wrote, all computed from the bytes read back."""

    def run(batches):
        for batch in batches:
            for part in groups(batch, 2):
                media = part.column(2).to_pylist()
                payloads = [unwrap(m)[3] for m in media]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                        pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                        pa.array([len(m) for m in media], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                        pa.array(_features(payloads, part.column(3).to_pylist())),
                        pa.array(pc.binary_length(part.column(3)).cast(pa.int64())),
                    ],
                    names=FEATURES.names,
                )
        shared.release()

    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, FEATURES)
