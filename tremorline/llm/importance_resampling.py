"""Importance resampling towards a target: documents whose words are likelier in the target than in the corpus.

Features are runs of 1 to ``width`` consecutive words, hashed to buckets.  One scan
of a text keeps a ring of CRC-32 states, one for each of the last ``width`` starts;
each word extends all of them by a space and itself and begins a new one, and every
state is a feature's checksum.  What a document leaves is its buckets and how often
each occurs, so a row has at most ``buckets`` entries however long the text is.

Counts over all rows of corpus and target give each bucket a gain, the floor of 1000
times the logarithm of its smoothed ratio; a document's weight is the sum over its
features.  Gumbel noise from a hash of the id turns the highest scores into a draw
without replacement in proportion to the weights.

Defined results: null and empty texts have no features and weight 0, and are drawn
only if ``least_words`` lets them; a null id is hashed as an empty one and ranks first among ties;
repeated rows count and rank as often as they occur; empty tables count
nothing: without a corpus there is no row, without a target all buckets are smoothed;
texts are scanned in blocks, so one may have any length; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from . import shared

WIDTH = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20
#: Letters A-Z become small ones, and all that is no ASCII letter, digit or other character becomes a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in lists, cut at the first space behind each block."""
    plain = text.translate(_PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + block)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def checksums(parts: Iterator[list[bytes]], width: int = WIDTH) -> Iterator[list[int]]:
    """CRC-32 of every run of 1 to width words, in lists by part of the text."""
    crc, ring = zlib.crc32, deque()
    for part in parts:
        out = []
        for word in part:
            if len(ring) == width:  # the oldest run has all its words
                ring.popleft()
            tail = b" " + word
            for i, state in enumerate(ring):
                ring[i] = crc(tail, state)
            ring.append(crc(word))
            out.extend(ring)
        yield out


def scan(text: bytes | None, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, the buckets met in ascending order and how often each was."""
    n_words, counts = 0, None

    def counted():
        nonlocal n_words
        for part in words(text or b""):
            n_words += len(part)
            yield part

    for found in checksums(counted(), width):
        if found:
            more = np.bincount(np.array(found, dtype=np.int64) % buckets, minlength=buckets)
            counts = more if counts is None else counts + more
    if counts is None:
        return n_words, 0, np.zeros(0, np.int32), np.zeros(0, np.int64)
    met = np.flatnonzero(counts)
    return n_words, int(counts.sum()), met.astype(np.int32), counts[met]


def features(docs: DataFrame, key: str, text: str, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, met, times): the buckets of each text and their counts."""

    def run(batches):
        for batch in shared.slices(batches):
            rows = [scan(t.as_py(), width, buckets) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[i] for r in rows]) if rows else [], kind)) for i, kind in ((2, pa.int32()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists], names=["doc_id", "n_words", "n_features", "met", "times"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, met array<int>, times array<long>")


def tally(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows; each task sends a row for each bucket it met."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in shared.slices(batches):
            met, times = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            np.add.at(total, met, times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return found.select("met", "times").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the tallies of corpus and target."""
    spark = corpus.sparkSession
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))).unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    table = both.groupBy("bucket").agg(*(F.sum(c).cast("double").alias(c) for c in "st"))
    sums = table.agg(*(F.sum(c).alias(f"all_{c}") for c in "st"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return table.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """The floor of 1000 times Gumbel noise, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.ln(-F.ln(share)))


def weigh(found: DataFrame, table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): gains summed over each row's features.

    The gains (``buckets`` whole numbers) go to the workers with the function.
    """
    gain = np.zeros(buckets, dtype=np.int64)
    for row in table.collect():
        gain[row.bucket] = row.gain

    def run(batches):
        for batch in shared.slices(batches):
            met, times = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            sums = np.concatenate([[0], np.cumsum(gain[met] * times)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "met", "times").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the rank of those drawn, best first; null for the others.

    ``percent`` of the documents that have at least ``least_words`` words are drawn,
    rounded down; ties go to the smaller id.
    """
    found = shared.materialize(features(docs, key, text, width, buckets), "resampling-features")
    theirs = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text"))
    table = gains(tally(found, buckets), tally(features(theirs, "id", "text", width, buckets), buckets), buckets)
    scored = weigh(found, table, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = shared.materialize(scored.withColumn("_place", F.monotonically_increasing_id()), "resampling-scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # the place in the input spreads rows that repeat an id over ranges, too
    ranked = numbered(able.withColumn("_down", -F.col("score")), ("_down", "doc_id", "_place"), name="rank")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest.select(*columns, "rank"))
