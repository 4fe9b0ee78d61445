"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Byte-pair merging looks like a whole-word procedure, but what happens at one
place depends on a bounded stretch of text to its right only.  From the merge
list we compute that stretch (``sufficient_lookahead``): once so many symbols
behind a token are known, no later text can change it, so it is emitted and its
symbols leave the buffer.  Memory per word is therefore constant however long
the word is.  Every word goes through the transducer; a bounded memo keeps its results
for white-space-delimited chunks that come again.  Decoding is an incremental
byte-to-text state machine.

A text is taken in segments of about ``SEGMENT`` characters, cut at spaces, and its ids
leave by segment: besides the text itself and what a caller asks to keep, memory doesn't
grow with the text.

Tokenizer files of the "BPE with word ends" and "byte-level BPE" kinds are
read; normalisation and the cut into words are the file's own components.

Defined results: null text counts as empty and gives no ids; a null id list
decodes as empty; an empty table gives an empty table; repeated rows give repeated
results, so ties can't matter; texts and words may have any length; extra columns pass
through ``encode_documents`` untouched unless they bear an output name, in
which case a ValueError says so.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Entries of the memo of white-space-delimited chunks; it is emptied when full.
MEMO_ENTRIES = 300_000
#: Chunks longer than this aren't kept in the memo.
MEMO_CHARS = 128
#: Characters of a text that are encoded at once.
SEGMENT = 1 << 16
#: Characters for which str.split() sees white space and the tokenizer doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: The rank of pairs that never merge.
NONE = 1 << 40


class MergeTable:
    """Merges by pair of symbol ids, and the lookahead that they need."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.rank.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.base = 1 + max(vocab.values())
        self.pair = {a * self.base + b: rank for (a, b), (rank, _) in self.rank.items()}
        self.made = {rank: new for rank, new in self.rank.values()}
        self.width = {vocab[x]: self._symbols(x) for x in vocab}
        self.lookahead = self._sufficient_lookahead()

    def _symbols(self, token: str) -> int:
        body = token.removesuffix(self.suffix) if self.suffix else token
        return len(body)

    def _sufficient_lookahead(self) -> int:
        """Symbols behind a token after which it is stable.

        ``reach`` of a merge (x, y) is how far beyond the end of xy text can
        decide whether that merge happens at a place.  Only merges of a lower
        rank interfere, so one pass in rank order suffices: what forms y, what
        takes y away to the right, what forms x, and what takes x away to the
        left.
        """
        formed: dict[int, int] = {}  # token -> reach of what forms it
        takes_right: dict[int, int] = {}  # y -> most of |z| + reach of (y, z)
        takes_left: dict[int, int] = {}  # x -> most reach of (w, x)
        most = 0
        for (x, y), (_, xy) in sorted(self.rank.items(), key=lambda e: e[1][0]):
            reach = max(0, formed.get(y, 0), takes_right.get(y, 0), max(formed.get(x, 0), takes_left.get(x, 0)) - self.width[y])
            formed[xy] = max(formed.get(xy, 0), reach)
            takes_right[x] = max(takes_right.get(x, 0), self.width[y] + reach)
            takes_left[y] = max(takes_left.get(y, 0), reach)
            most = max(most, self.width[y] + reach)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Applies all merges to a whole sequence: lowest rank first, then leftmost."""
        rank = self.rank
        if len(ids) <= 160:
            ids, get, base, made = list(ids), self.pair.get, self.base, self.made
            ranks = [get(a * base + b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) < NONE:
                i = ranks.index(best)
                ids[i] = new = made[best]
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get(new * base + ids[i + 1], NONE)
                if i:
                    ranks[i - 1] = get(ids[i - 1] * base + new, NONE)
            return ids
        ids = list(ids)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := rank.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, left, right, new = heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if f := rank.get((new, ids[k])):
                    heappush(heap, (f[0], i, new, ids[k], f[1]))
            if (h := before[i]) >= 0 and (f := rank.get((ids[h], new))):
                heappush(heap, (f[0], h, ids[h], new, f[1]))
        return [x for x in ids if x >= 0]


class WordTransducer:
    """Takes words' symbols in pieces of any size and emits tokens once they are stable.

    Nothing can be stable before lookahead symbols and the longest token are known;
    that much is held back, and as much again, so that settling is worth its merge.
    ``words`` counts the words ended, ``peak`` the most symbols held.
    """

    def __init__(self, table: MergeTable):
        self.table = table
        self.limit = 2 * (table.lookahead + max(table.width.values()))
        self.held: list[int] = []
        self.words = self.peak = 0

    def feed(self, symbols: list[int]) -> list[int]:
        """Symbols that the word's end surely doesn't follow directly yet."""
        out: list[int] = []
        for start in range(0, len(symbols), self.limit):
            self.held += symbols[start : start + self.limit]
            if len(self.held) > self.limit:
                self.peak = max(self.peak, len(self.held))
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        tokens, end, settled = self.table.merge(self.held), 0, 0
        for n, token in enumerate(tokens):
            end += self.table.width[token]
            if end + self.table.lookahead > len(self.held):
                break
            settled, cut = n + 1, end
        if settled:
            self.held = self.held[cut:]
        return tokens[:settled]

    def end(self, last: list[int] = ()) -> list[int]:
        """The word's last symbols; all that is left of it becomes stable."""
        self.held += last
        self.words += 1
        self.peak = max(self.peak, len(self.held))
        tokens, self.held = self.table.merge(self.held), []
        return tokens


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE files are supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.table = MergeTable(model["vocab"], merges, self.suffix)
        self.spec_decoder = spec.get("decoder")
        if self.spec_decoder is not None and self.spec_decoder.get("type") != "ByteLevel":
            raise ValueError("only files without a decoder or with a byte-level one are supported")
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match plain text")
        self.special_starts = {s[:2] for s in self.special}
        self.inner = {c: i for c, i in model["vocab"].items() if len(c) == 1}
        self.final = {c: model["vocab"][c + self.suffix] for c in self.inner if c + self.suffix in model["vocab"]}
        by_byte = _byte_alphabet()
        self.inner_byte = [self.inner.get(by_byte[b]) for b in range(256)]
        self.final_byte = [self.final.get(by_byte[b]) for b in range(256)]
        #: Runs of Latin-1 letters are single words if each such letter is one, as the cut is by classes.
        self.plain = bool(self.suffix) and all(self._normal(chr(c)) == [bytes(chr(c).lower(), "utf-8")] for c in range(256) if chr(c).isalpha())
        self.machine = WordTransducer(self.table)
        self.memo = _Memo(self)
        names = {i: s for s, i in (model["vocab"] | self.special).items()}
        if self.spec_decoder is None:
            self.surface = {i: s.encode() for i, s in names.items()}
            self.between = b" "
        else:
            to_byte = {c: b for b, c in _byte_alphabet().items()}
            self.surface = {i: s.encode() if s in self.special else bytes(to_byte[c] for c in s) for i, s in names.items()}
            self.between = b""

    # encoding

    def _normal(self, text: str) -> list[bytes]:
        to_byte = {c: b for b, c in _byte_alphabet().items()}
        return [bytes(to_byte[c] for c in w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)]

    def _letters(self, word: str) -> list[int]:
        """Tokens of a run of Latin-1 letters."""
        data = word.lower().encode()
        out = self.machine.feed([*map(self.inner_byte.__getitem__, data[:-1])])
        return out + self.machine.end([self.final_byte[data[-1]]])

    def words(self, text: str) -> list[str]:
        if any(c in text for c in NOT_SPACE):
            import re

            return [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w]
        return text.split()

    def segments(self, text: str) -> Iterator[str]:
        """The text in parts of about SEGMENT characters, cut at spaces or line ends."""
        at = 0
        while len(text) - at > SEGMENT:
            end = at + SEGMENT
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if cut <= at:
                cut = min((i for i in (text.find(" ", end), text.find("\n", end)) if i >= 0), default=len(text))
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def pieces(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, by segment."""
        if not text:
            return
        if not self.suffix:
            yield from (self._pack(part) for part in self.stream([text]))
            return
        for segment in self.segments(text):
            yield b"".join(map(self.memo.__getitem__, self.words(segment)))

    def encode_bytes(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces(text))

    def encode(self, text: str | None) -> list[int]:
        raw = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each special string and word of the parts, as soon as they are stable."""
        for part in parts:
            for piece, special in self._cut_specials(part):
                if special is not None:
                    yield [special]
                    continue
                normal = self.normalizer.normalize_str(piece) if self.normalizer else piece
                for word, _ in self.splitter.pre_tokenize_str(normal):
                    yield from self._word(word)

    def _word(self, word: str) -> Iterator[list[int]]:
        machine = self.machine
        for start in range(0, len(word) - 1, machine.limit):
            if out := machine.feed([*map(self.inner.__getitem__, word[start : min(start + machine.limit, len(word) - 1)])]):
                yield out
        yield machine.end([self.final[word[-1]]])

    def _cut_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        if any(s in text for s in self.special_starts):
            while True:
                found = min(((i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0), default=None)
                if found is None:
                    break
                if found[0] > at:
                    yield text[at : found[0]], None
                yield found[2], self.special[found[2]]
                at = found[0] + len(found[2])
        if at < len(text):
            yield text[at:], None

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    # decoding

    def decoder(self) -> TextDecoder:
        return TextDecoder(self)

    def decode(self, raw: bytes) -> str:
        """The text of ids given as little-endian unsigned 32-bit integers."""
        machine = self.decoder()
        return "".join([*(machine.feed(raw[start : start + (1 << 16)]) for start in range(0, len(raw), 1 << 16)), machine.end()])


class TextDecoder:
    """Packed ids in pieces to text; holds back the bytes of an unfinished character only."""

    def __init__(self, codec: Codec):
        self.codec, self.machine, self.begun = codec, Utf8Machine(), False

    def feed(self, raw: bytes) -> str:
        if not raw:
            return ""
        between = self.codec.between
        data = between.join(map(self.codec.surface.__getitem__, struct.unpack(f"<{len(raw) // 4}I", raw)))
        data, self.begun = (between + data if self.begun else data), True
        return self.machine.feed(data)

    def end(self) -> str:
        return self.machine.end()


class Utf8Machine:
    """Bytes in pieces of any size to text: holds back at most three bytes.

    A malformed sequence becomes U+FFFD once per maximal valid prefix, as the
    Unicode standard recommends.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if need > back and byte < 0xF5 else 0
                break
            if byte < 0x80:
                break
        cut = len(data) - keep
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


class _Memo(dict):
    """Packed ids by white-space-delimited chunk; bounded by MEMO_ENTRIES."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        codec = self.codec
        if codec.plain and len(chunk) <= MEMO_CHARS and chunk.isalpha() and max(chunk) <= "\xff":
            raw = codec._pack(codec._letters(chunk))
        elif codec.plain and 1 < len(chunk) <= MEMO_CHARS and chunk[-1] in ".,;:!?" and (body := chunk[:-1]).isalpha() and max(body) <= "\xff":
            raw = self[body] + self[chunk[-1]]
        else:
            raw = b"".join(map(codec._pack, codec.stream([chunk])))
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = raw
        return raw


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


OUT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])


def encode_documents(docs: DataFrame, path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit), n_tokens and, if asked for, decoded."""
    schema = T.StructType([f for f in OUT if decode or f.name != "decoded"])
    if clash := {f.name.lower() for f in schema} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    at = docs.columns.index(text)

    def run(batches):
        own = codec(path)
        for batch in shared.slices(batches):
            raws = [own.encode_bytes(t) for t in batch.column(at).to_pylist()]
            new = [pa.array(raws, pa.binary()), pa.array([len(r) // 4 for r in raws], pa.int64())]
            if decode:
                new.append(pa.array([own.decode(r) for r in raws], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in schema)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *schema.fields]))


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text, keeping digests only."""

    def run(batches):
        own = codec(path)
        for batch in shared.slices(batches):
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                size, all_ids, text, machine = 0, hashlib.sha256(), hashlib.sha256(), own.decoder()
                for raw in own.pieces(value.as_py()):
                    size += len(raw) // 4
                    all_ids.update(raw)
                    text.update(machine.feed(raw).encode("utf-8"))
                text.update(machine.end().encode("utf-8"))
                counts.append(size)
                ids.append(all_ids.hexdigest())
                decoded.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
