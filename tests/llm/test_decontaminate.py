import random
from collections import Counter

import numpy as np

from tremorline.llm import decontaminate as D


def brute(docs, items, width=5):
    out = set()
    for d, text in docs:
        tokens = D.words(text)
        for i, t in items:
            item = D.words(t)
            if not item or not tokens:
                continue
            w, n = min(width, len(item)), min(len(item), len(tokens))
            want = Counter(tuple(item[k : k + w]) for k in range(len(item) - w + 1))
            for at in range(len(tokens) - n + 1):
                win = tokens[at : at + n]
                w2 = min(w, n)
                have = Counter(tuple(win[k : k + w2]) for k in range(n - w2 + 1))
                if D.similarity(have, want) >= 0.8:
                    out.add((d, i))
    return out


def planted(seed):
    rnd = random.Random(seed)
    vocab = [a + b for a in ("th", "er", "in", "on", "é", "qu") for b in ("a", "e", "ing", "s", "t", "re")]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randint(12, 60))) for i in range(12)] + [(50, "Only four words here"), (51, ""), (52, None), (53, " .. ")]
    docs = []
    for d in range(60):
        parts = [say(rnd.randint(0, 120))]
        for _ in range(d % 3):
            words = rnd.choice(items[:13])[1].split()
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(words))
                words[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [words[at], rnd.choice(vocab)]])
            parts += [" ".join(words).upper() if d % 2 else ",\n".join(words), say(rnd.randint(0, 80))]
        docs.append((d, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, items[0][1] + " " + items[0][1]), (903, "only, FOUR words: here!")], items


def test_as_brute_force():
    hits = 0
    for seed in range(4):
        docs, items = planted(seed)
        index = D.Items(items)
        got = {(d, index.items[m[0]][0]) for d, text in docs for m in index.matches(text)}
        assert got == brute(docs, items)
        hits += len(got)
    assert hits > 40


def test_blocks_find_all_within_radius():
    rnd = random.Random(3)
    index = D.Items([(i, " ".join(str(rnd.random()) for _ in range(9 + i % 2))) for i in range(50)])
    for _ in range(300):
        f = index.prints[rnd.randrange(50)].copy()
        for b in rnd.sample(range(256), rnd.randint(0, 64)):
            f[b // 64] ^= np.uint64(1 << b % 64)
        for g in (0, 1):
            at, item = index.near(np.array([f, f ^ f]), np.array([g, g]))
            want = {n for n, p in enumerate(index.prints) if int(np.bitwise_count(p ^ f).sum()) <= 56 and index.group[n] == g}
            assert set(item[at == 0].tolist()) == want


def test_index_is_selective_and_made_once():
    rnd = random.Random(5)
    index = D.Items([(i or None, " ".join(str(rnd.random()) for _ in range(20))) for i in range(2000)])
    prints = np.random.default_rng(1).integers(0, 1 << 64, (200, 4), dtype=np.uint64)
    at, _ = index.drawn(prints, np.zeros(200, dtype=np.int64))
    assert 0 < len(at) <= 0.2 * 200 * 2000
    again = D.Items.unpacked(index.packed(), index.radius, index.least)
    assert again.items == index.items and again.vocabulary == index.vocabulary
    assert all(np.array_equal(x, y) for x, y in zip(again.drawn(prints, np.zeros(200, dtype=np.int64)), index.drawn(prints, np.zeros(200, dtype=np.int64)), strict=True))
    assert sum(x.nbytes for n, x in index.arrays.items() if n.rstrip("0123456789") in ("keys", "first", "items")) < 2000 * 6000


class Every(D.Items):
    """Compares a window with every item of its size."""

    def near(self, prints, groups):
        at, item = np.nonzero(groups[:, None] == self.group[None, :])
        return at, item


def edited(words, rnd, vocab):
    words = list(words)
    for _ in range(rnd.randint(0, max(1, len(words) // 40))):
        at = rnd.randrange(len(words))
        words[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [words[at], rnd.choice(vocab)]])
    return words


def test_recall_of_the_fingerprints():
    rnd = random.Random(11)
    vocab = [a + b for a in ("th", "er", "in", "on", "st", "qu") for b in ("a", "e", "ing", "s", "t", "re")]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rnd.randint(20, 200)))) for i in range(60)]
    docs = [(d, " ".join([*say(rnd.randint(0, 40)), *edited(rnd.choice(items)[1].split(), rnd, vocab), *say(rnd.randint(0, 40))])) for d in range(400)]
    index = D.Items(items)
    every = Every(items)
    found = {(d, n) for d, t in docs for n, *_ in index.matches(t)}
    want = {(d, n) for d, t in docs for n, *_ in every.matches(t)}
    assert found <= want and len(want) > 300 and len(found) >= 0.99 * len(want)
    assert {(d, items[n][0]) for d, n in want if d < 40} == brute(docs[:40], items)
    some = [s for _, t in docs for _, _, _, s, _ in every.matches(t)]
    assert min(some) < 0.85 and max(some) == 1


def test_long_documents_and_full_files():
    import tracemalloc

    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(30, 90)))) for i in range(1000)]
    tracemalloc.start()
    index = D.Items(items)
    assert tracemalloc.get_traced_memory()[0] < 1000 * 16_000 + 2_000_000
    tracemalloc.stop()
    text = " ".join([items[3][1], *(rnd.choice(vocab) for _ in range(40000)), items[7][1], items[7][1], items[999][1]])
    assert {n: s for n, _, _, s, _ in index.matches(text)} == {3: 1, 7: 1, 999: 1}
    assert {n for n, *_ in index.matches(" ".join(t for _, t in items))} == set(range(1000))


def test_tables(spark):
    docs, items = planted(9)
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs] + [(None, items[1][1], None, None)] * 2, "doc_id long, text string, item_id string, first_word int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items) | {(None, 1)}
    assert {(r.doc_id, r.item_id) for r in D.contaminations(df, bench).collect()} == want
    kept = D.clean(df, bench)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})
    assert D.contaminations(df, bench.limit(0)).count() == 0 and D.clean(df, bench.limit(0)).count() == df.count()
    assert D.contaminations(df.limit(0), bench).count() == 0


def test_many_files_and_extra_columns(spark, monkeypatch):
    docs, items = planted(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(D, "item_files", lambda b, files=D.item_files, **kept: files(b, 800, 3, **kept))
    assert len(D.item_files(bench)) > D.KEPT
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in D.contaminations(df, bench).collect()} == want
    assert D.clean(df, bench).count() == len(docs) - len({d for d, _ in want})
