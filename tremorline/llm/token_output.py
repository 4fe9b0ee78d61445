"""Token ids as files of independent zstandard frames with a trailing seek table.

One shard file holds, in ascending document order,

* one zstandard frame for each document: its ids as little-endian unsigned
  32-bit integers, the end id last,
* a skippable frame with the document ids (a null-flag byte and a signed 64-bit
  integer each), and
* the seek table of the public seekable format: a skippable frame with, for each
  frame, the compressed size, the decompressed size and a checksum (the low 32
  bits of XXH64 of the decompressed bytes), then the footer.

A reader loads the table from the file's end and decompresses the frames of the
documents asked for, and no others; any seekable-zstandard reader can read the
file.  Shards follow each other in document order.

The texts are encoded where they are read, so only compressed frames are
shuffled.  The number of shards follows from the bytes of all texts; documents are dealt
to them by quantiles of the document id.  Where one id fills whole shards, and for rows
without an id, which get their share of shards before all others, rows are dealt by a
hash of their ids.

Defined results: null text counts as empty (the end id only); null document ids
come first; rows with equal ids follow each other by a hash of their tokens, in a
fixed order, so repeated rows give repeated results; an empty table gives no shard; a
text may be as long as a row may, as its ids must take less than 4 GiB, the format's
limit for a frame (an error says so); extra columns are ignored.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Fixed values of the public seekable zstandard format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

END_ID = 1
LEVEL = 3
#: Bytes that a shard aims at, and what a document is taken to add to it: a share of its text's bytes, and its frame's and tables' own.
SHARD_BYTES, FRAME_SHARE, FRAME_BYTES = 128 << 20, 0.6, 48
#: The format's limit for sizes.
LIMIT = 1 << 32
#: Entries of the memo of words (both halves), of which that of other chunks has an eighth, and the longest one kept.
MEMO_ENTRIES = 800_000
MEMO_CHARS = 12
#: Characters of a text that are split at once, and bytes of texts that are encoded together.
SEGMENT, PART_BYTES = 1 << 20, 4 << 20
#: Signs that may form a word behind a run of letters; each run of them is probed before it is taken for one.
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
NOT_SPACE = "\x1c\x1d\x1e\x1f"


# frames and files


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=True)


def frame(raw: bytes, level: int = LEVEL) -> bytes:
    return _compressor(level).compress(raw)


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    """Writes frames in the order given; keeps 21 bytes a document until closed."""

    def __init__(self, sink):
        self.sink, self.entries, self.keys, self.tokens = sink, bytearray(), bytearray(), 0

    def add(self, key: int | None, packed: bytes, raw_size: int, check: int) -> None:
        if max(len(packed), raw_size) >= LIMIT or len(self.entries) + 64 >= LIMIT:
            raise ValueError("a frame or the seek table exceeds the format's 4 GiB")
        self.sink.write(packed)
        self.entries += struct.pack("<III", len(packed), raw_size, check)
        self.keys += struct.pack("<Bq", key is None, key or 0)
        self.tokens += raw_size // 4

    def close(self) -> None:
        n = len(self.entries) // 12
        self.sink.write(struct.pack("<II", SKIPPABLE, len(self.keys)) + self.keys)
        # the frame of document ids has an entry too, so that the sizes add up to the table's place
        entries = self.entries + struct.pack("<III", len(self.keys) + 8, 0, checksum(b""))
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", n + 1, 0x80, SEEK_MAGIC))


class Shard:
    """Random access to one shard file; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, os.SEEK_END)
        if size < 17:
            raise ValueError("not a seekable zstandard file")
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != 0x80 or n < 1:
            raise ValueError("not a seekable zstandard file with checksums")
        table = n * 12 + 9
        source.seek(size - table - 8)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SEEK_TABLE or length != table:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(source.read(n * 12), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        source.seek(int(self.offsets[n - 1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE or length != 9 * (n - 1):
            raise ValueError("the document ids are damaged")
        keys = np.frombuffer(source.read(length), dtype=np.dtype([("null", "u1"), ("id", "<i8")]))
        self.keys, self.null = keys["id"], keys["null"].astype(bool)

    def __len__(self) -> int:
        return len(self.keys)

    def ids_bytes(self, n: int) -> bytes:
        """The ids of the n-th document, its checksum verified."""
        self.source.seek(int(self.offsets[n]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[n, 0])), max_output_size=max(1, int(self.table[n, 1])))
        if len(raw) != self.table[n, 1] or checksum(raw) != self.table[n, 2]:
            raise ValueError(f"frame {n} is damaged")
        return raw

    def find(self, key: int | None) -> list[int]:
        """Places of the documents with this id."""
        nulls = int(self.null.sum())  # these come first
        if key is None:
            return list(range(nulls))
        return [nulls + i for i in range(*np.searchsorted(self.keys[nulls:], [key, key + 1]))]


# encoding with the library


LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
SIGNS_BEHIND = "(?s)^.*?([" + "".join("\\" + c for c in SIGNS) + "]*)$"

#: Texts by which a tokenizer file is probed: whether white space of any kind ends words whatever stands beside it.
PROBES = [
    "a <|endoftext|>Bé, 1\n\tc",
    "  two  spaces\r\n\r\nand\u00a0others\u2003here\u3000too\u2028x\u0085y ",
    "don't we'LL 12 345.6 , . ;; !? (a) [b] {c} <d> <| |> \"e\" 'f' «g» – — …",
    "漢字 かな 한글 ไทย عربي עברית ελ ΣΑΣ İ ı ß ŉ ǆ ﬁ ½ ² Ⅷ ٣",
    "e\u0301 \u0301e 🙂 🙂🏽 👩‍👩‍👧 \u200b a\u200db \ufeff z\ufe0f",
    "<|startoftext|> <|endoftext|> <|endoftext|><|startoftext|> x<|endoftext|>y < | endoftext | >",
    "\x00 \x01a \x7f b\x00c _ __ a_b A1b2 -1 +2 1e5 http://x.y/z?q=1&r#s a@b.c",
]


class _Memo(dict):
    """What was looked up lately: when the younger half is full it becomes the older one, whose entries come back when they are met."""

    def __init__(self, entries: int):
        super().__init__()
        self.half = entries // 2
        self.older: dict[str, bytes] = {}

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        return self.keep(key, value) if len(key) <= MEMO_CHARS else value


class _Words(_Memo):
    """Packed ids of lower-case runs of Latin-1 letters, from the library's model."""

    def __init__(self, model):
        super().__init__(MEMO_ENTRIES)
        self.tokenize = model.tokenize
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in printable]
        self.byte_level = {b: chr(256 + n) for n, b in enumerate(hidden)}

    def make(self, key: str) -> bytes:
        return pack([t.id for t in self.tokenize(key if key.isascii() else key.encode().decode("latin-1").translate(self.byte_level))])


_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def pack(ids: list[int]) -> bytes:
    return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)


class _Encoder(_Memo):
    """Packed ids by white-space-delimited chunk, from the tokenizers library; bounded.

    White space ends words, so chunks can be encoded each by itself.  A run of Latin-1
    letters is one word, in lower case, and goes straight to the library's model; a run of
    signs behind it is a word of its own.  All other chunks go through the whole tokenizer.
    The file is probed for these properties; without them whole texts are encoded.
    """

    def __init__(self, path: str):
        super().__init__(MEMO_ENTRIES // 8)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.words = _Words(self.own.model)
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        probes = ["".join(letters), *letters, "Word", "ÉTÉ", "straße"]
        self.letters = all(self.words[w.lower()] == self._whole(w) for w in probes)
        self.signs: dict[str, bytes | None] = {"": b""}
        self.by_chunk = all(self._whole(probe) == b"".join(map(self._whole, probe.split())) for probe in PROBES)

    def _whole(self, text: str) -> bytes:
        return pack(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _signs(self, run: str) -> bytes | None:
        """The ids of signs behind letters; None if the run isn't a word of its own there."""
        alone = self._whole(run)
        known = all(self._whole(letters + run) == self._whole(letters) + alone for letters in ("ab", "Zé"))
        if len(self.signs) < MEMO_ENTRIES and len(run) <= MEMO_CHARS:
            self.signs[run] = alone if known else None
        return alone if known else None

    def make(self, chunk: str) -> bytes:
        body = chunk.rstrip(SIGNS)
        if self.letters and body.isalpha() and (body.isascii() or max(body) <= "\xff"):
            run = chunk[len(body) :]
            signs = self.signs[run] if run in self.signs else self._signs(run)
            if signs is not None:
                return self.words[body.lower()] + signs
        return self._whole(chunk)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if not self.by_chunk or any(c in text for c in NOT_SPACE):
            return self._whole(text)
        return b"".join(b"".join(map(self.__getitem__, part.split())) for part in segments(text))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of several texts: chunks that they share are looked up once."""
        odd = pc.match_substring_regex(texts, f"[{NOT_SPACE}]")
        odd = pc.or_(odd, pc.greater(pc.binary_length(texts), SEGMENT)).to_numpy(zero_copy_only=False) | (not self.by_chunk)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts))
        coded = lists.flatten().dictionary_encode()
        pieces, first, second = self._pieces(coded.dictionary)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        ids, starts = np.frombuffer(b"".join(pieces), dtype="<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        of = np.stack([first[at], second[at]], axis=1).ravel()
        counts = sizes[of]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = ids[np.repeat(starts[of] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[2 * (lists.offsets.to_numpy() - lists.offsets[0].as_py())].tolist()
        return [self.encode(text.as_py()) if o else ids[a:b].tobytes() for text, o, a, b in zip(texts, odd.tolist(), bounds, bounds[1:], strict=False)]

    def _pieces(self, chunks: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Packed ids of the words and runs of signs of different chunks, and which two of these make up each chunk."""
        bodies = pc.utf8_rtrim(chunks, SIGNS)
        plain = pc.match_substring_regex(bodies, LETTERS).to_numpy(zero_copy_only=False) & self.letters
        runs = pc.replace_substring_regex(chunks, SIGNS_BEHIND, r"\1").dictionary_encode()
        signs = [self.signs[r] if r in self.signs else self._signs(r) for r in runs.dictionary.to_pylist()]
        run = runs.indices.to_numpy()
        plain &= np.array([s is not None for s in signs], dtype=bool)[run] if len(run) else plain
        words = pc.utf8_lower(bodies.filter(pa.array(plain))).dictionary_encode()
        pieces = [*map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()), *(s or b"" for s in signs), b""]
        first, second = np.empty(len(chunks), dtype=np.int64), np.full(len(chunks), len(pieces) - 1)
        first[plain], second[plain] = words.indices.to_numpy(), len(words.dictionary) + run[plain]
        others = np.flatnonzero(~plain)
        first[others] = len(pieces) + np.arange(len(others))
        return pieces + [self[c] for c in chunks.take(pa.array(others)).to_pylist()], first, second


def segments(text: str) -> Iterator[str]:
    """The text in parts of about SEGMENT characters, cut at spaces or line ends."""
    at = 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT
        cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
        if cut <= at:
            cut = min((i for i in (text.find(" ", end), text.find("\n", end)) if i >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _open(path: str, mode: str):
    """A file of any store that pyarrow knows, by URI."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at) if mode == "r" else store.open_output_stream(at, buffer_size=1 << 20)


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PART_BYTES in a column, of one row at least."""
    lo = size = 0
    for hi, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 1):
        size += n
        if size >= PART_BYTES or hi == batch.num_rows:
            yield batch.slice(lo, hi - lo)
            lo, size = hi, 0


def shards_for(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[int, int]:
    """How many shards documents (doc_id, text) get, and how many of these are for rows without an id."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) * FRAME_SHARE + FRAME_BYTES
    r = docs.agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), size)), F.lit(0.0)).alias("null")).first()
    nulls = -int(-r["null"] // shard_bytes)
    return nulls + max(-int(-(r["all"] - r["null"]) // shard_bytes), int(nulls == 0 or r["all"] > r["null"])), nulls


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents below folder; returns (shard, file, n_docs, n_tokens, start), one row a shard.

    ``shards`` sets the number of shards that documents with an id get; without it that follows from ``shard_bytes``.
    A task writes under a name of its own and only then renames, so that repeated or
    speculative tasks leave whole files.  ``start`` is the number of ids in earlier shards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total, nulls = shards_for(docs, shard_bytes)
    total = nulls + shards if shards else total
    cuts = max(total - nulls, 1)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)] or [0.5], max(20 * min(cuts, 5000), 4 * cuts)).alias("b")).first().b or []
    edges = np.array(bounds[: cuts - 1], dtype=np.int64)

    end = struct.pack("<I", end_id)

    def encode(batches):
        own = encoder(path)
        for batch in batches:
            for part in parts(batch, 1):
                raws = [raw + end for raw in own.encode_all(part.column(1).fill_null(""))]
                keys = part.column(0)
                values = np.array(keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), dtype=np.int64)
                hashes = np.array([xxhash.xxh64_intdigest(r, 7) >> 1 for r in raws], dtype=np.int64)
                low, high = np.searchsorted(edges, values, "left"), np.searchsorted(edges, values, "right")
                shard = nulls + low + hashes % np.maximum(high - low, 1)
                if nulls:
                    shard = np.where(keys.is_null().to_numpy(zero_copy_only=False), hashes % nulls, shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), keys, pa.array(hashes), pa.array([frame(r) for r in raws], pa.binary()), pa.array([len(r) for r in raws], pa.int64()), pa.array([checksum(r) for r in raws], pa.int64())],
                    names=["shard", "doc_id", "order", "frame", "size", "check"],
                )

    def write(batches):
        sink = writer = name = None
        at = n = 0

        def done():
            nonlocal sink
            writer.close()
            sink.close()
            sink = None
            from pyarrow import fs

            store, own = fs.FileSystem.from_uri(name)
            final = f"{folder}/shard-{at:06d}.zst"
            store.move(own, fs.FileSystem.from_uri(final)[1])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([final]), pa.array([n], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["shard", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or row[0] != at:
                    if sink is not None:
                        yield done()
                    at, n = row[0], 0
                    name = f"{folder}/attempt-{at:06d}-{os.urandom(8).hex()}"
                    sink = _open(name, "w")
                    writer = ShardWriter(sink)
                writer.add(row[1], row[3], row[4], row[5])
                n += 1
        if sink is not None:
            yield done()

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    frames = docs.mapInArrow(encode, "shard int, doc_id long, order long, frame binary, size long, check long")
    dealt = frames.repartitionById(max(total, 1), F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "order", "frame")
    manifest = dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long").toArrow().sort_by("shard")  # one row a shard
    counts = manifest.column("n_tokens").to_numpy()
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    return spark.createDataFrame([(int(s), f, int(d), int(n), int(b)) for s, f, d, n, b in zip(*(manifest.column(c).to_pylist() for c in ("shard", "file", "n_docs", "n_tokens")), starts, strict=True)], "shard int, file string, n_docs long, n_tokens long, start long")


def read_shards(manifest: DataFrame, digest: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; with digest=False the ids themselves."""
    last = ("ids_crc32", "long") if digest else ("ids", "binary")

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(file, "r") as source:
                    shard = Shard(source)
                    for first in range(0, len(shard), 1024):
                        keys, starts, counts, ends = [], [], [], []
                        for i in range(first, min(first + 1024, len(shard))):
                            raw = shard.ids_bytes(i)
                            keys.append(None if shard.null[i] else int(shard.keys[i]))
                            starts.append(start)
                            counts.append(len(raw) // 4)
                            ends.append(zlib.crc32(raw) if digest else raw)
                            start += len(raw) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ends, pa.int64() if digest else pa.binary())], names=["doc_id", "start", "n_tokens", last[0]])

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n).mapInArrow(read, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")


def read_documents(spark: SparkSession, manifest: DataFrame, wanted: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids of the wanted documents only, on the driver: decompresses their frames and no others."""
    wanted = list(wanted)
    for row in manifest.orderBy("shard").toLocalIterator():
        with _open(row.file, "r") as source:
            shard = Shard(source)
            for key in wanted:
                for n in shard.find(key):
                    yield key, np.frombuffer(shard.ids_bytes(n), dtype="<u4")


def shard_of(documents: list[tuple[int | None, list[int]]]) -> bytes:
    """A whole shard in memory, for small sets and tests."""
    sink = io.BytesIO()
    writer = ShardWriter(sink)
    for key, ids in documents:
        raw = struct.pack(f"<{len(ids)}I", *ids)
        writer.add(key, frame(raw), len(raw), checksum(raw))
    writer.close()
    return sink.getvalue()


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    """The round trip: all documents into files in the shared folder, and back."""
    return read_shards(write_shards(docs, path, shared.scratch(docs.sparkSession, "token-ids")))
