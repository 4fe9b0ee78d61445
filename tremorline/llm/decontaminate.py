"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by a benchmark item if some window of it, as many words
long as the item, has a weighted shingle similarity of at least 0.8 with it: the sum
of the smaller multiplicities of the five-word shingles over the sum of the larger.

* Item-sized windows slide over the document word by word.  A window whose similarity
  with every item must be too small gets no fingerprint: of its a shingles and an item's
  b, at least (a + b) * 0.8 / 1.8 have to be shingles of the benchmark.  That bound is
  exact and doesn't say which item is meant.
* The other windows get SimHash fingerprints of 256 bits from rolling counts of bits.
* Which items a window is compared with comes from the fingerprints alone: the items of
  the window's size are indexed by ``BLOCKS`` blocks of bits.  Two fingerprints within the
  radius differ in at most radius // BLOCKS bits of some block; half of these flips are
  tried when the index is made, the others when it is asked, so every item within the
  radius is found.  A window draws about a sixth of the items of its size from the index.
* The exact similarity decides.

The radius (56 of 256 bits) is three standard deviations beyond the mean distance at
similarity 0.8; SimHash can't guarantee more.  The mean is higher only where a document
of eight words has four of an item's five shingles: 91 % of those are within the radius.

A job makes the indexes, one to a file of bounded size in the shared folder, so each is
made once.  Workers read them there, one after the other, and keep the last ones between
tasks; the documents are read once, nothing is broadcast and no text passes the driver.

Words are runs of letters, digits and underscores, lower-cased.  Defined results:
items without words (null, empty) match nothing; an item of fewer than five words is
one shingle of all its words; a document shorter than the item is one window; null
texts match nothing; null document or item ids are carried along; repeated rows give
repeated results; of windows with equal similarity the first is reported; empty tables
on either side give no match; a document may have any length, as windows are laid in
stretches of ``PIECE`` words; columns of any name are kept by ``clean``.
"""

from __future__ import annotations

import io
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WIDTH = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, and how many may differ.
BITS, RADIUS = 256, 56
#: Blocks of a fingerprint's bits, 13 or 14 bits each.
BLOCKS = 19
CUTS = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
#: Bytes and items of the benchmark in one file, about; an item takes 2.2 kB of the index.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 10_000
#: Files whose items a worker keeps, and bytes of documents that it takes at once if there are more.
KEPT, CHUNK_BYTES = 4, 32 << 20
#: Windows that are laid at once, and those that ask the index at once.
PIECE, ASKED = 1 << 13, 1 << 12
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(tokens: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.encode("utf-8", "replace")) for w in tokens], dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words from the words' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + n]) * ODD
        out ^= out >> np.uint64(29)
    return out


def lane(shingles: np.ndarray, k: int) -> np.ndarray:
    """Bits 64 k to 64 k + 63 of the shingles, a row of 64 for each."""
    x = (shingles ^ np.uint64((k + 1) * int(ODD) % (1 << 64))) * ODD
    x = (x ^ (x >> np.uint64(32))) * ODD
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits as numbers."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def simhash(shingles: np.ndarray) -> np.ndarray:
    """A bit is set if it is set in over half the shingles, counted with multiplicity; BITS / 64 numbers."""
    return np.concatenate([_packed((2 * lane(shingles, k).sum(axis=0, dtype=np.int64) > len(shingles))[None, :]) for k in range(BITS // 64)])


def _values(prints: np.ndarray) -> Iterator[np.ndarray]:
    """The value of each block of the fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8), axis=1, bitorder="little")
    for first, end in zip(CUTS, CUTS[1:], strict=False):
        yield np.packbits(bits[:, first:end], axis=1, bitorder="little").view("<u2").ravel().astype(np.int64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def _close_values(bits: int, flips: int) -> np.ndarray:
    """All values of so many bits with at most ``flips`` of them set."""
    return np.array([sum(1 << i for i in c) for n in range(min(flips, bits) + 1) for c in combinations(range(bits), n)], dtype=np.int64)


class Items:
    """Items of one file: their words, shingles and fingerprints, indexed by blocks of bits.

    ``items`` are (id, words); a group holds the items of equal length.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH, radius: int = RADIUS, least: float = SIMILARITY):
        split = [(key, tokens) for key, tokens in ((k, words(t)) for k, t in items) if tokens]
        vocabulary = sorted({w for _, tokens in split for w in tokens})
        place = {w: i + 1 for i, w in enumerate(vocabulary)}
        hashes = np.concatenate([np.zeros(1, dtype=np.uint64), word_hashes(vocabulary)])
        lengths = np.array([len(tokens) for _, tokens in split], dtype=np.int64)
        sizes, group = np.unique(lengths, return_inverse=True)
        shingles, counts, prints = [], [], np.zeros((len(split), BITS // 64), dtype=np.uint64)
        for n, (_, tokens) in enumerate(split):
            own = shingle_hashes(hashes[[place[w] for w in tokens]], min(width, len(tokens)))
            prints[n] = simhash(own)
            for kept, values in zip((shingles, counts), np.unique(own, return_counts=True), strict=True):
                kept.append(values)
        arrays = {
            "ids": np.array([key or 0 for key, _ in split], dtype=np.int64),
            "named": np.array([key is not None for key, _ in split], dtype=bool),
            "words": np.frombuffer("\n".join(vocabulary).encode("utf-8", "surrogatepass"), dtype=np.uint8),
            "hashes": hashes,
            "lengths": lengths,
            "sizes": sizes,
            "widths": np.minimum(sizes, width),
            "group": group.astype(np.int64),
            "ends": np.cumsum([len(x) for x in shingles], dtype=np.int64),
            "shingles": np.concatenate([np.zeros(0, dtype=np.uint64), *shingles]),
            "counts": np.concatenate([np.zeros(0, dtype=np.int64), *counts]).astype(np.int32),
            "prints": prints,
        }
        for k, value in enumerate(_values(prints)):
            bits = CUTS[k + 1] - CUTS[k]
            close = _close_values(bits, radius // BLOCKS // 2)
            keys = ((arrays["group"] << bits | value)[:, None] ^ close[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            arrays[f"keys{k}"], first = np.unique(keys[order], return_index=True)
            arrays[f"first{k}"] = np.append(first, len(keys)).astype(np.int32)
            arrays[f"items{k}"] = (order // len(close)).astype(np.int32)
        self._hold(arrays, radius, least)

    def _hold(self, arrays: dict[str, np.ndarray], radius: int, least: float) -> None:
        self.arrays, self.radius, self.least = arrays, radius, least
        self.items = [(key if named else None, n) for key, named, n in zip(arrays["ids"].tolist(), arrays["named"].tolist(), arrays["lengths"].tolist(), strict=True)]
        self.vocabulary = {w: i + 1 for i, w in enumerate(arrays["words"].tobytes().decode("utf-8", "surrogatepass").split("\n"))} if self.items else {}
        self.hashes, self.sizes, self.widths, self.group, self.prints = (arrays[x] for x in ("hashes", "sizes", "widths", "group", "prints"))
        ends, known = arrays["ends"].tolist(), defaultdict(list)
        self.shingles = [arrays["shingles"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.counts = [arrays["counts"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for g, own in zip(self.group.tolist(), self.shingles, strict=True):
            known[int(self.widths[g])].append(own)
        self.known = {w: np.unique(np.concatenate(x)) for w, x in known.items()}
        self.close = {bits: _close_values(bits, radius // BLOCKS - radius // BLOCKS // 2) for bits in {b - a for a, b in zip(CUTS, CUTS[1:], strict=False)}}

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes, radius: int, least: float) -> Items:
        """The items of ``packed``; the index isn't made again."""
        items = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as arrays:
            items._hold(dict(arrays), radius, least)
        return items

    def drawn(self, prints: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item): the items of the groups that agree on some block but for radius // BLOCKS bits."""
        pairs = []
        for k, value in enumerate(_values(prints)):
            bits = CUTS[k + 1] - CUTS[k]
            keys, first, items = (self.arrays[f"{x}{k}"] for x in ("keys", "first", "items"))
            close = self.close[bits]
            asked = ((groups << bits | value)[:, None] ^ close[None, :]).ravel()
            found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = np.flatnonzero(keys[found] == asked)
            lo, n = first[found[hit]], first[found[hit] + 1] - first[found[hit]]
            at = np.repeat(hit // len(close), n)
            pairs.append(np.unique(at * len(self.items) + items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(at))]))
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.items), pairs % len(self.items)

    def near(self, prints: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item): all items of the groups whose fingerprint is within the radius."""
        ats, items = [], []
        for lo in range(0, len(prints), ASKED):
            at, item = self.drawn(prints[lo : lo + ASKED], groups[lo : lo + ASKED])
            close = np.bitwise_count(prints[lo + at] ^ self.prints[item]).sum(axis=1) <= self.radius
            ats.append(lo + at[close])
            items.append(item[close])
        return np.concatenate(ats), np.concatenate(items)

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles with an item's."""
        unique, counts = np.unique(shingles, return_counts=True)
        own, n = self.shingles[item], self.counts[item]
        at = np.minimum(np.searchsorted(own, unique), len(own) - 1)
        both = int(np.minimum(counts, n[at])[own[at] == unique].sum())
        return both / (len(shingles) + int(n.sum()) - both) if both else 0.0

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, differing bits) of the best window of each item found."""
        tokens = words(text)
        if not tokens or not self.items:
            return
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens], dtype=np.int64)
        inside = np.concatenate([[0], np.cumsum(ids > 0)])
        best: dict[int, tuple[float, int, int, int]] = {}
        for width, known in self.known.items():
            places = np.flatnonzero(inside[width:] - inside[:-width] == width) if len(tokens) >= width else ()
            if not len(places):
                continue
            hashes = _at(self.hashes[ids], places, width)
            hits = places[known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes]
            if len(hits):
                self._best_windows(tokens, width, hits, best)
        for item, (s, first, size, bits) in sorted(best.items()):
            yield item, first, size, s, bits

    def _best_windows(self, tokens: list[str], width: int, hits: np.ndarray, best: dict[int, tuple[float, int, int, int]]) -> None:
        """``hits``: the places of shingles of this width that some item has."""
        groups = np.flatnonzero(self.widths == width)
        size = np.minimum(self.sizes[groups], len(tokens))
        own, theirs = size - width + 1, self.sizes[groups] - width + 1
        need = np.ceil(self.least / (1 + self.least) * (own + theirs) - 1e-9).astype(np.int64)
        possible = need <= own
        if not possible.any():
            return
        groups, size, own, need = groups[possible], size[possible], own[possible], need[possible]
        widest = int(own.max())
        upto = np.zeros(len(tokens) - width + 2, dtype=np.int64)
        upto[hits + 1] = 1
        np.cumsum(upto, out=upto)
        # no window reaches from one stretch into the next
        for stretch in np.split(hits, np.flatnonzero(np.diff(hits) > widest) + 1):
            if len(stretch) < need.min():
                continue
            start, end = max(0, int(stretch[0]) - widest + 1), int(stretch[-1]) + 1
            for lo in range(start, end, PIECE):
                hi = min(lo + PIECE, end)
                laid = []
                for g, n, a, least in zip(groups.tolist(), size.tolist(), own.tolist(), need.tolist(), strict=True):
                    last = min(hi, len(tokens) - n + 1)
                    if last > lo:
                        dense = lo + np.flatnonzero(upto[lo + a : last + a] - upto[lo:last] >= least)
                        if len(dense):
                            laid.append((g, n, a, dense))
                if laid:
                    self._compare(tokens[lo : hi + widest + width - 2], lo, width, laid, best)

    def _compare(self, tokens: list[str], lo: int, width: int, laid: list[tuple[int, int, int, np.ndarray]], best: dict[int, tuple[float, int, int, int]]) -> None:
        """Fingerprints of the windows laid, (group, words, shingles, first words), and their items."""
        shingles = shingle_hashes(word_hashes(tokens), width)
        counts = [len(at) for *_, at in laid]
        prints = np.empty((sum(counts), BITS // 64), dtype=np.uint64)
        rolling = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
        for k in range(BITS // 64):
            np.cumsum(lane(shingles, k), axis=0, out=rolling[1:])
            prints[:, k] = np.concatenate([_packed(2 * (rolling[at - lo + a] - rolling[at - lo]) > a) for _, _, a, at in laid])
        window, item = self.near(prints, np.repeat([g for g, *_ in laid], counts))
        firsts = np.concatenate([at for *_, at in laid])
        of = np.repeat(np.arange(len(laid)), counts)
        for w, i in zip(window.tolist(), item.tolist(), strict=True):
            _, n, a, _ = laid[of[w]]
            first = int(firsts[w])
            s = self.similarity(shingles[first - lo : first - lo + a], i)
            if s >= self.least and (i not in best or (s, -first) > (best[i][0], -best[i][1])):
                best[i] = (s, first, n, int(np.bitwise_count(prints[w] ^ self.prints[i]).sum()))


def _at(hashes: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """shingle_hashes at some places only."""
    out = np.full(len(places), width, dtype=np.uint64)
    for j in range(width):
        out = (out ^ hashes[places + j]) * ODD
        out ^= out >> np.uint64(29)
    return out


def item_files(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES, most_items: int = BLOCK_ITEMS, width: int = WIDTH, radius: int = RADIUS) -> list[str]:
    """Writes the items' indexes below the shared folder, about so many items to a file; no text passes the driver."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sums = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if not sums.n:
        return []

    def run(batches):
        items = [pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if items:
            yield pa.RecordBatch.from_arrays([pa.array([Items(items, width, radius).packed()], pa.binary())], names=["index"])

    path = shared.scratch(spark, "benchmark")
    own.repartition(max(1, -(-sums.b // most_bytes), -(-sums.n // most_items))).mapInArrow(run, "index binary").write.parquet(path)
    return sorted(spark.read.schema("index binary").parquet(path).inputFiles())


@lru_cache(maxsize=KEPT)
def items_of(file: str, radius: int, least: float) -> Items:
    """The items of one file; a worker keeps the last ones."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        rows = pq.read_table(source, columns=["index"]).column(0)
    return Items.unpacked(rows[0].as_py(), radius, least) if len(rows) else Items([], radius=radius, least=least)


def _chunks(batches, files: list[str], at: int):
    """Slices of the batches; larger ones where items have to be read anew for each."""
    if len(files) <= KEPT:
        yield from shared.slices(batches)
        return
    held, size = [], 0
    for part in shared.slices(batches):
        held.append(part)
        size += part.column(at).nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


MATCH = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("item_id", T.LongType()), ("first_word", T.LongType()), ("n_words", T.LongType()), ("similarity", T.DoubleType()), ("differing_bits", T.IntegerType()))])


def contaminations(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity, differing_bits): each item's best window in each document."""
    files = item_files(benchmark, width=width, radius=radius)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())

    def run(batches):
        for batch in _chunks(batches, files, 1):
            rows = []
            for file in files:
                items = items_of(file, radius, least)
                rows += [(key, items.items[n][0], first, size, s, bits) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for n, first, size, s, bits in items.matches(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=MATCH.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    files, at = item_files(benchmark, width=width, radius=radius), docs.columns.index(text)

    def run(batches):
        for batch in _chunks(batches, files, at):
            for file in files:
                items = items_of(file, radius, least)
                batch = batch.filter(pa.array([next(items.matches(t.as_py()), None) is None for t in batch.column(at)], pa.bool_()))
            yield batch

    return docs.mapInArrow(run, docs.schema)
