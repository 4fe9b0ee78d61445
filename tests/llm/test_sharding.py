"""Shards against a brute-force version, balance, spread of hot keys, and files read back."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tremorline.llm import sharding


def brute_force(docs, shards, overhead=16):
    """(key, text) to shard and slot, for keys and texts that don't repeat together."""
    sized = [(k, t, len((t or "").encode()) + overhead) for k, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))]
    total, before, out, filled = sum(s for *_, s in sized), 0, {}, {}
    for k, t, s in sized:
        shard = (2 * before + s) * shards // (2 * total)
        out[k, t] = (s, shard, filled.get(shard, 0))
        filled[shard] = filled.get(shard, 0) + 1
        before += s
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    own = [(i, rng.choice(["", "é" * rng.randrange(30), "word " * rng.randrange(200)])) for i in rng.sample(range(-500, 5000), 700)]
    return [*own, (None, "no key"), (6000, None), (6001, "long " * 30_000)]


@pytest.mark.parametrize("shards", [1, 7, 40, 3000])
def test_as_brute_force(spark, docs, shards):
    own = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.text): (r.size, r.shard, r.slot) for r in sharding.place(own, shards).collect()}
    assert got == brute_force(docs, shards)


def test_sizes_are_near_equal(spark):
    own = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id * 7919 % 400 as int)) as text")
    sums = [r.b for r in sharding.place(own, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 2 * (400 + 16)


def test_result_does_not_depend_on_partitions(spark, docs):
    own = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (sharding.place(own.repartition(n), 9, parts=p).select("doc_id", "shard", "slot").collect() for n, p in ((1, 2), (6, 11)))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_hot_key_and_repeated_rows_are_spread(spark):
    own = spark.range(3000).selectExpr("case when id % 3 = 0 then null else id end as doc_id", "case when id % 3 = 0 then 'same' else string(id) end as text")
    ranges = sharding.dealt(own, parts=8).groupBy("range").count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 3000 / 4
    rows = sharding.place(own, 10, parts=8).groupBy("shard").agg(F.max("slot").alias("last"), F.count("*").alias("n")).collect()
    assert all(r.last == r.n - 1 for r in rows) and sum(r.n for r in rows) == 3000


def test_files_are_read_back_with_clashing_columns(spark, docs, tmp_path):
    own = spark.createDataFrame([(k, t, 1, "a", 2, 3.5) for k, t in docs], "doc_id long, text string, Size int, shard string, range int, `odd.name` double")
    out = sharding.write(own, f"{tmp_path}/shards", 5)
    assert out.columns == ["doc_id", "text", "Size_", "shard_", "range", "odd.name", "size", "shard", "slot"]
    want = brute_force(docs, 5)
    rows = sharding.digests(out).collect()
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={i}" for i in range(5) if any(s == i for _, s, _ in want.values())]
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    crcs = {k: zlib.crc32((t or "").encode()) for k, t in docs}
    assert all(r.text_crc32 == crcs[r.doc_id] for r in rows)
    assert sorted((r["size"], r.shard, r.slot) for r in rows) == sorted(want.values())


def test_empty_table_and_bad_number(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.digests(sharding.write(none, f"{tmp_path}/none", 4)).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        sharding.place(none, 0)
