import itertools
import random
import re

import xxhash

from tremorline.llm import simhash_dedup as S
from tremorline.llm.components import connected_components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    rnd = random.Random(1)
    for text in [None, "", " \t", "One", "a b c", "a b c d", "ÉA\x0bb\x1cc d e É", " ".join(rnd.choice("abcdef") for _ in range(500))]:
        assert S.fingerprint(text) == brute_print(text)


def test_masks_cover_all_small_differences():
    masks = S.covering_masks(4)
    assert len(masks) == 31
    rnd = random.Random(2)
    for _ in range(20000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
        assert any(not diff & m for m in masks)


def planted(n, seed):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        x = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    return out


def check_links(spark, prints, small):
    nodes = spark.createDataFrame([(S.signed(p),) for p in set(prints)], "fp long")
    edges = S.links(nodes, 4, small)
    pairs = edges.collect()
    assert all((a ^ b) & (2**64 - 1) for a, b in pairs) and all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    unique = sorted(set(prints), key=S.signed)
    want = brute_components(unique)
    assert [roots.get(S.signed(p), S.signed(p)) for p in unique] == [S.signed(unique[i]) for i in want]


def test_links_as_brute_force(spark):
    check_links(spark, planted(60, 3), 1024)


def test_large_buckets_as_brute_force(spark):
    check_links(spark, planted(30, 4), 2)


def test_buckets_are_not_broadcast(spark, monkeypatch):
    """Spark takes the nodes' 31 tables, and the points around them, for as small as the nodes."""
    plans, materialize = [], S.shared.materialize

    def planned(df, name, *level):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name, *level)

    monkeypatch.setattr(S.shared, "materialize", planned)
    nodes = materialize(spark.createDataFrame([(S.signed(p),) for p in set(planted(30, 4))], "fp long"), "nodes")
    edges = S.links(nodes, 4, 2)
    plans.append(edges._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_components_of_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today".split()
    rnd = random.Random(6)
    rows = [(i, " ".join([*base, str(i % 7)] if i % 2 else rnd.sample(base, len(base))), "x") for i in range(60)] + [(None, None, "x"), (90, "", "y"), (91, " ", "y"), (5, "other words", None), (5, "other words", None)]
    got = S.components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    prints = [brute_print(r[1]) for r in rows]
    want = brute_components(prints)
    least = {}
    for r, c in zip(rows, want):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], S.signed(p), least.get(c))) for r, p, c in zip(rows, prints, want))


def test_deduplicate_keeps_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (2, "entirely other words are here now"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.deduplicate(df).collect()) == [1, 2]
    assert S.deduplicate(df.limit(0)).columns == ["doc_id", "text"]
    assert S.deduplicate(df.limit(0)).count() == 0


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
