import random
import zlib

import numpy as np
import pytest

from tremorline.llm import toxicity as X

TOXIC = ["vile", "scorn", "filth"]


def corpus(n, seed):
    rnd = random.Random(seed)
    vocab = ["the", "of", "der", "und", "le", "que", "los"] + [a + b for a in ("ta", "ro", "mi", "ne", "su") for b in ("ka", "lo", "ri", "ve")]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 80))]
        toxic = int(i % 4 == 0)
        for _ in range(rnd.randint(2, 3) * toxic):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(TOXIC))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(600, 1)
    m = X.train([r[1] for r in rows[:450]], np.array([r[2] for r in rows[:450]], dtype=np.float32))
    X.calibrate(m, [r[1] for r in rows[450:]], np.array([r[2] for r in rows[450:]], dtype=np.float32))
    return m


def test_held_out_accuracy(model):
    scorer = X.Scorer(model)
    rows = corpus(400, 2)
    right = sum((scorer.score(t) >= 0.5) == y for _, t, y in rows)
    assert right >= 380


def test_convolution_as_brute_force(model):
    rng = np.random.default_rng(3)
    parts = rng.standard_normal((9 + X.REACH, X.N_COLUMNS)).astype(np.float32)
    got = X.convolve(parts, 9, model.bias)
    for i in range(9):
        for w, places in enumerate(X.COLUMNS):
            want = model.bias[w * X.FILTERS : (w + 1) * X.FILTERS] + sum(parts[i + j, p] for j, p in enumerate(places))
            assert np.allclose(got[i, w * X.FILTERS : (w + 1) * X.FILTERS], want, atol=1e-5)


def test_segments_and_memo_change_nothing(model, monkeypatch):
    texts = [" ".join(t for _, t, _ in corpus(60, 4)), "", None, "vile", "ta vile scorn"]
    want = [X.Scorer(model).score(t) for t in texts]
    monkeypatch.setattr(X, "SEGMENT", 16)
    monkeypatch.setattr(X, "ROWS_KEPT", 10)
    assert np.allclose([X.Scorer(model).score(t) for t in texts], want)


def test_tables(spark):
    rows = corpus(500, 5)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(None, None, None, None), (7, "", "y", 2)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (5, None), (4, 0)], "doc_id long, toxic int")
    got = X.judge(docs, labels).collect()
    assert len(got) == 502 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id != 7]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    kept = X.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in got if not r.predicted}
    assert {r.score for r in X.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert X.judge(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = corpus(200, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a, b = (sorted((r.doc_id, r.score) for r in X.judge(docs.drop("toxic"), spark.createDataFrame(lab, "doc_id long, toxic int")).collect()) for lab in ([(i, y) for i, _, y in rows], flip))
    assert a == b


def test_thresholds_cover_all_labels_at_their_mix(spark):
    rows = [(i, t, y, r) for i, t, y in corpus(900, 8) for r in [zlib.crc32(b"flip%d" % i) % 3 == 0]]
    labelled = [(i, t, y if not r else 0) for i, t, y, r in rows]  # a third of the toxic texts passes for clean
    docs = spark.createDataFrame([x[:2] for x in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int")
    bounds = {"rows": 120, "most_bytes": 1 << 20}  # fewer than there are labels
    usable = X.usable_labels(labels)
    used = {r[0] for r in X.sample(docs, usable, *bounds.values())}
    free = [r for r in labelled if zlib.crc32(b"%d" % r[0]) % 5]
    model = X.fit(docs, labels, **bounds)
    scorer, counts = X.Scorer(model), np.zeros((len(X.LANGUAGES), 2, X.STEPS))
    for i, t, y in free:
        if i not in used:
            p, language = scorer.look(X.words(t))
            counts[X.LANGUAGES.index(language), y, min(int(p * X.STEPS), X.STEPS - 1)] += 1
    assert len(used) == 120 and counts.sum() == len(free) - 120
    whole = np.array([sum(y == k for _, _, y in free) for k in (0, 1)])
    assert model.thresholds == X.cuts(counts, whole)
    assert X.cuts(counts, whole * 7) == model.thresholds


def test_cuts_weigh_the_mix():
    counts = np.zeros((len(X.LANGUAGES), 2, X.STEPS))
    counts[:, 0, 100], counts[:, 0, 3000], counts[:, 1, 3000], counts[:, 1, 4000] = 50, 10, 20, 30
    low, high = (X.cuts(counts, np.array(w))["en"] * X.STEPS for w in ((240, 200), (2400, 200)))
    assert 100 < low <= 3000 < high <= 4000


def test_long_and_repeated_texts_leave_room(spark):
    rows = corpus(300, 9)
    first = [(i, ("la " * 40_000) + t) for i, t, _ in rows if i in (1, 4, 8, 13)]  # the first files hold texts beyond the bound
    hot = [(2, t) for _, t, _ in corpus(400, 10)]
    rest = [(i, t) for i, t, _ in rows if i not in (1, 2, 4, 8, 13)]
    docs = spark.createDataFrame(first, "doc_id long, text string").unionAll(spark.createDataFrame(hot + rest, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    usable = X.usable_labels(labels)
    got = X.sample(docs, usable, 1000, 100_000)
    fold = {i for i, _, _ in rows if zlib.crc32(b"%d" % i) % 5 and zlib.crc32(b"calibrate%d" % i) % 5}
    assert {r[0] for r in got} == fold - {1, 4, 8, 13} and len(got) == len({r[0] for r in got})
    assert not X.fit(docs, labels, 1000, 100_000).empty
    for most in (5000, 1):
        got = X.sample(docs, usable, 1000, most)
        assert {r[2] for r in got} == {0, 1}
        assert most == 1 or sum(len(t.encode()) for _, t, _ in got) <= most
    few = X.sample(docs, usable, 40, 100_000)
    assert sum(r[2] for r in few) == 20 and len(few) == 40
