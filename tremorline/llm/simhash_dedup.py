"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints within ``radius`` bits are linked, and linked documents form
components.  Candidates come from 2**(radius+1) - 1 tables of structured masks:
each of the 64 bits gets a vector of radius+1 bits, and table v compares the bits
whose vector has an odd product with v.  For any at most ``radius`` differing bits
some v has even products with all their vectors, so in table v the pair collides:
no pair within the radius is lost, whatever the data.

Equal fingerprints are one node from the start.  Within a table, a bucket of up to
``small`` nodes is compared in blocks and only a spanning forest of its links goes
on; in a larger bucket every node emits the points within half the radius on the
bits that the mask leaves free, and nodes that share a point are linked to the
least of them (such nodes are within the radius; and nodes within the radius share
a point).  So the rows grow with the nodes, never with their pairs, and no bucket
has to fit anywhere.

Defined results: null and empty texts have no words and fingerprint zero, and are
linked like others; a null document id takes part and never names a component
unless all ids of its component are null (then the component is null); repeated
rows are kept, and of a component the rows with the least id stay; an empty
table gives an empty table; a text may have any length, as bits are counted in blocks;
extra columns are kept by ``deduplicate`` and ignored by ``components``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Nodes of a bucket up to which it is compared in blocks.
SMALL = 1 << 14
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half the hashes of the word shingles."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    lasts = ends[min(width, len(words)) - 1 :].tolist()
    total, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(lasts), BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], lasts[at : at + BLOCK], strict=False)], dtype=np.uint64)
        total += _bit_counts(hashes)
    return int(np.packbits(2 * total > len(lasts), bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from the 64 x n bit matrix by popcounts of packed rows."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches):
        for batch in shared.slices(batches):
            values = [signed(fingerprint(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks; any ``radius`` bits are all outside of one of them.

    Bit i has a vector of radius+1 bits; the vectors are dealt in turn, so masks
    have about half the bits each.  For up to ``radius`` positions there is a
    nonzero v whose product with each of their vectors is even.
    """
    vectors = [1 + (i * 11) % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` with the components of all links within the radius."""
    spark = nodes.sparkSession
    masks = covering_masks(radius)
    n_free = [64 - m.bit_count() for m in masks]
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))
    buckets = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared_buckets = buckets.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes rows behind an explode or a mapInArrow as those before it, and would broadcast them: hence the hints
    members = shared.materialize(buckets.hint("merge").join(shared_buckets, ["t", "key"]), "simhash-buckets")

    def compare(batches):
        """Runs of sorted rows are buckets; their links' spanning forests go out."""
        held, at = [], None
        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
                if at is not None and at != (t[lo], key[lo]):
                    yield from forest(held)
                    held = []
                at = (t[lo], key[lo])
                held.append(fp[lo:hi])
        if held:
            yield from forest(held)

    def forest(held):
        """Breadth first: each node is compared once with those not reached yet."""
        points = np.concatenate(held).view(np.uint64)
        left, edges = np.arange(len(points)), []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                u = queue.pop()
                near = np.bitwise_count(points[left] ^ points[u]) <= radius
                found, left = left[near], left[~near]
                edges += [(u, v) for v in found]
                queue += found.tolist()
        if edges:
            pair = points.view(np.int64)[np.array(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    def balls(batches):
        """The points within half the radius of each node on the free bits of its table."""
        half = radius // 2
        shifts = []
        for m in masks:
            free = [1 << i for i in range(64) if not m >> i & 1]
            ball, ring = {0}, {0}
            for _ in range(half):
                ring = {x ^ f for x in ring for f in free}
                ball |= ring
            shifts.append(np.array(sorted(ball), dtype=np.uint64))
        for batch in batches:
            for t, fp in zip(batch.column(0).to_pylist(), batch.column(2).to_numpy().view(np.uint64), strict=True):
                points = (shifts[t] ^ fp).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), t, dtype=np.int32)), pa.array(points), pa.array(np.full(len(points), fp).view(np.int64))], names=["t", "point", "fp"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = members.where(F.col("n") <= small).repartition(tasks, "t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp").mapInArrow(compare, "a long, b long")
    if radius % 2:
        raise ValueError("the radius must be even")  # halves of an odd one would miss links in large buckets
    if members.where(F.col("n") > small).limit(1).count():
        spread = members.where(F.col("n") > small).select("t", "key", "fp").mapInArrow(balls, "t int, point long, fp long")
        # a point names its bucket: the bits under the mask are the bucket's key
        least = spread.groupBy("t", "point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        near = near.unionAll(spread.hint("merge").join(least, ["t", "point"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return near.distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the least document id that links reach."""
    prints = shared.materialize(fingerprints(docs, key, text, width), "simhash")
    nodes = shared.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), radius), "simhash-edges")
    # both tables have a row a document and are compressed to a fraction of their size in memory
    named = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(firsts, "root").select("fp", "component_id")
    return prints.hint("merge").join(by_print, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The documents of whose component none has a smaller id; the columns stay as they are.

    Of rows that share an id all or none stay; rows with a null id stay only if their
    component has no other id.
    """
    found = components(docs, key, text, radius, width)
    gone = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)").select("doc_id").distinct()
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone["doc_id"]), "left_anti")
