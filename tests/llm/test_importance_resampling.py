"""Importance resampling against a brute-force version: whole texts, zlib on joined words, Python's logarithms."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tremorline.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, width, buckets):
    words = WORD.findall((text or "").translate(SMALL))
    runs = [" ".join(words[i : i + n]) for i in range(len(words)) for n in range(1, width + 1) if i + n <= len(words)]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def brute_force(docs, target, width, buckets, least, percent, seed):
    mine, theirs = [plain_features(t, width, buckets) for _, t in docs], [plain_features(t, width, buckets)[1] for t in target]
    s, t = sum((c for _, c in mine), Counter()), sum(theirs, Counter())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(s.total() + buckets) / (float(s[b] + 1) * float(t.total() + buckets)))) for b in s | t}
    rows = []
    for (key, _), (n, c) in zip(docs, mine, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append([key, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


TEXTS = ["Alpha beta, GAMMA delta-epsilon 42", "beta beta beta", "Été à l'école ÀÉ alpha", None, "", " ,.;! ", "x" * 70, "alpha beta gamma " * 50, "\x00nul\x7f 🙂 smile", "beta beta beta"]


@pytest.mark.parametrize(("width", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (3, 97, 2, 50), (2, 7, 0, 100)])
def test_as_brute_force(spark, width, buckets, least, percent):
    docs = [(i if i % 7 else None, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(3, TEXTS[0])] * 2
    target = ["alpha beta", None, "Gamma delta gamma", "42"]
    own = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in docs], "doc_id long, text string, weight string, rank int, n_words int, met int").repartition(3)
    got = ir.resample(own, spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=buckets, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(docs, target, width, buckets, least, percent, ir.SEED)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80), st.integers(1, 4), st.integers(1, 9))
def test_ring_of_any_text_and_block(text, width, block):
    parts = list(ir.words(text.encode(), block))
    assert [w.decode() for p in parts for w in p] == WORD.findall(text.translate(SMALL))
    found = Counter(c % 101 for p in ir.checksums(iter(parts), width) for c in p)
    assert found == plain_features(text, width, 101)[1]


def test_long_text_is_scanned_in_blocks():
    text = b"one two three " * 400_000
    assert max(len(p) for p in ir.words(text)) < 300_000
    n_words, n_features, met, times = ir.scan(text, 2, 1000)
    assert (n_words, n_features) == (1_200_000, 2_399_999) and times.sum() == n_features and len(met) <= 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "word " * 30), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ir.resample(none, docs).count() == 0
    found = {r.doc_id: r for r in ir.resample(docs, none, percent=100).collect()}
    assert found[1].rank == 1 and found[1].n_features == 30 and found[2].weight == 0 and found[2].rank is None


def test_documents_like_the_target_are_preferred(spark):
    docs = spark.createDataFrame([(i, ("earth quake fault slip " if i % 10 == 0 else "market share price fund ") * 10) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("earth quake fault slip plate",)], "text string")
    drawn = [r.doc_id for r in ir.resample(docs, target).where("rank is not null").collect()]
    assert len(drawn) == 40 and all(i % 10 == 0 for i in drawn)


def test_one_id_on_most_rows_is_ranked_whole(spark):
    docs = spark.range(2000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "repeat('word ', 25) as text")
    ranks = [r["rank"] for r in ir.resample(docs, docs.limit(1), percent=100).collect()]
    assert sorted(ranks) == list(range(1, 2001))
