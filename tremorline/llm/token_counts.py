"""Token counts by heap-and-linked-list byte-pair merging.

For a sentencepiece BPE model a text's count is the number of its initial
symbols (characters) minus the number of merges; a symbol left alone that the
vocabulary lacks counts as its UTF-8 bytes.  No identifier is ever emitted.  The
adjacent pairs lie in a heap by rank and place, the symbols in a linked list, so
each merge costs a logarithm and touches two neighbours.

The texts are cut first where no merge can cross: before a run of spaces that
follows anything else, and, in long runs, between two characters that no
piece of the vocabulary holds side by side.  Counts of short pieces are kept in a
bounded memo.

Defined results: null text counts as empty, with 0 bytes and 0 tokens; repeated
rows give repeated results; null ids and extra columns are carried along if they are
kept; an empty table gives an empty table; a text may have any length, as it is counted
in pieces and only a run without such a cut is merged at once; an output name that
exists already is a ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64


class Counter:
    """Counts as the sentencepiece library does with one BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        plain = [p for p in model.pieces if p.type == 1]
        if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        order = sorted({p.score for p in plain}, reverse=True)
        by_score = {s: i for i, s in enumerate(order)}
        #: Highest score first; equal scores go by place.
        self.rank = {p.piece: by_score[p.score] for p in plain}
        self.longest = max(map(len, self.rank))
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.single = {p for p in self.rank if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces with inner spaces are not supported")
        self.memo, self.after_space = _Memo(self), _AfterSpace(self)
        self.free_newline = "\n" not in self.single and not any("\n" in p for p in self.pairs)

    def merges(self, piece: str) -> int:
        """Tokens of one piece: its symbols minus the merges, bytes for unknown symbols."""
        rank, n = self.rank, len(piece)
        if n == 1:
            return 1 if piece in self.single else len(piece.encode("utf-8"))
        end = list(range(1, n + 1))  # by start of a symbol: its end, which is the next symbol's start
        before = list(range(-1, n - 1))
        # entries are whole numbers of (rank, start, end of the merged symbol), in this order
        bits = n.bit_length()
        low, get = (1 << bits) - 1, rank.get
        heap = [(((r << bits) + i) << bits) + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        left = n
        while heap:
            entry = heappop(heap)
            k = entry & low
            i = entry >> bits & low
            j = end[i]
            if j >= k or j <= i or end[j] != k:  # one of the two symbols has been merged since
                continue
            end[i], end[j] = k, -1
            left -= 1
            if k < n:
                before[k] = i
                if (r := get(piece[i : end[k]])) is not None:
                    heappush(heap, (((r << bits) + i) << bits) + end[k])
            if (h := before[i]) >= 0 and (r := get(piece[h:k])) is not None:
                heappush(heap, (((r << bits) + h) << bits) + k)
        if not self.single.issuperset(piece):
            i = 0
            while i < n:
                if end[i] == i + 1 and piece[i] not in self.single:
                    left += len(piece[i].encode("utf-8")) - 1
                i = end[i]
        return left

    def _long(self, piece: str) -> int:
        """The same for a piece of any length, cut where nothing can merge."""
        total, start = 0, 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in self.pairs:
                total += self.merges(piece[start:i])
                start = i
        return total + self.merges(piece[start:])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            marked = SPACE + text.replace(" ", SPACE)
            return sum(map(self.memo.__getitem__, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)))
        return sum(map(self.after_space.__getitem__, text.split(" ")))


class _Memo(dict):
    """Counts by piece; bounded by MEMO_ENTRIES."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        counter = self.counter
        if len(piece) > 1 and "\n" in piece and counter.free_newline:
            parts = piece.split("\n")
            return sum(self[p] for p in parts if p) + len(parts) - 1
        if len(piece) > MEMO_CHARS:
            return counter._long(piece)
        if len(piece) > 2 and piece[-1] in ".,;:!?" and piece[-2:] not in counter.pairs:
            return self[piece[:-1]] + self[piece[-1]]
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[piece] = n = counter.merges(piece)
        return n


class _AfterSpace(dict):
    """Counts of words that follow one space, by word; bounded by MEMO_ENTRIES."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.memo[SPACE + word]
        if len(word) <= 12 and word.isalpha():  # the others are rarely seen again
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to the columns named in keep (default: all but text)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    if clash := {f.name.lower() for f in new} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    picked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("text of tokens"))

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            counts = [own.count(t) for t in texts]
            sizes = pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[*keep, *(f.name for f in new)])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:-1], *new]))
