import random

from tremorline.llm import line_dedup as L


def norm(line):
    return " ".join(line.lower().split())


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    """By row: the kept text and the number of removed lines."""
    seen, out = {}, []
    lines = []
    for n, (d, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(norm(line)) >= 20:
                lines.append(((d if d is not None else 2**63 - 1, p), n, p, norm(line).split()))
    lines.sort(key=lambda x: x[0])
    gone = set()
    for i, (_, n, p, words) in enumerate(lines):
        for _, _, _, other in lines[:i]:
            if other == words or len(words) >= 8 and len(other) >= 8 and near(words, other):
                gone.add((n, p))
                break
    for n, (_d, text) in enumerate(rows):
        if text is None:
            out.append((None, 0))
        else:
            kept = [x for p, x in enumerate(text.split("\n")) if (n, p) not in gone]
            out.append(("\n".join(kept), len(text.split("\n")) - len(kept)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "Theta", "iota", "kappa"]
    pool = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 24))] for _ in range(25)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            words = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(vocab)]])
            lines.append(rnd.choice([" ", "  ", "\t"]).join(words) + rnd.choice(["", " ", "\r"]))
        rows.append((d * 7 % 50, "\n".join(lines)))
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (None, "\n".join(" ".join(p) for p in pool))]


def test_as_brute_force(spark):
    removed = 0
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        got = {r.doc_id: (r.text, r.n_removed) for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {d: w for (d, _), w in zip(rows, want)}
        removed += sum(w[1] for w in want)
    assert removed > 60


def test_repeated_rows_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine\nshort"
    rows = [(1, text, 5, "x", 1), (1, text, 5, "x", 1), (2, text.replace("four", "FOUR x"), 6, None, 2), (None, text, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long, norm string, d int")
    out = L.deduplicate(df)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    assert sorted((str(r.doc_id), r.text, r.h) for r in out.collect()) == sorted([("1", text, 5), ("1", text, 5), ("2", "short", 6), ("None", "short", None)], key=str)
    assert L.deduplicate(df.limit(0)).count() == 0


def test_long_lines(spark):
    words = [f"w{i % 997}" for i in range(20000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:9000] + words[9001:])), (3, " ".join(words[:9000] + words[9002:])), (4, " ".join(["new", *words]))]
    got = {r.doc_id: r.n_removed for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1}


def test_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def short_brute(rows, least):
    lines = [(d, p, line, norm(line).split()) for d, text in sorted(rows) for p, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if len(norm(x[2])) >= 20]
    return {(d, p) for i, (d, p, _, w) in enumerate(lines) if any(o == w or min(len(o), len(w)) >= least and near(w, o) for *_, o in lines[:i])}


def test_short_lines_as_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["alphabetical", "betamethasone", "gammaglobulin", "deltoid", "epsilons", "zetas", "etas"]
    rows = [(d, "\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 10))) for _ in range(3))) for d in range(70)]
    for line in [row[1].split("\n")[0].split() for row in rows[:30]]:
        at = rnd.randrange(len(line))
        rows.append((len(rows), " ".join(line[:at] + rnd.choice([[], ["new"], [line[at], "new"]]) + line[at + 1 :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 4, 8):
        want = short_brute(rows, least)
        assert {(r.d, r.pos) for r in L.dropped(df, min_words=least).collect()} == want
    assert len(short_brute(rows, 2)) > len(short_brute(rows, 8)) + 10


def test_query_compares_short_lines(spark, tmp_path):
    from tremorline.llm import queries

    spark.createDataFrame([(1, "the same short heading here"), (2, "the same short heading there"), (3, "one two three four five six seven"), (4, "one two three four five six seven eight")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


def test_both_ways_of_hashing_meet(spark, monkeypatch):
    rows = corpus(3)
    want = brute(rows)
    for long in (0, 9, 14):
        monkeypatch.setattr(L, "LONG", long)
        got = {r.doc_id: (r.text, r.n_removed) for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {d: w for (d, _), w in zip(rows, want)}


def test_hot_lines_and_templates(spark):
    """One line in a third of the rows, one template whose lines differ in a word, and one repeated document."""
    hot, template = "the same very common line of words", "item {} of the long list of items in stock"
    rows = [(i, hot) for i in range(150)] + [(1000 + i, template.format(f"n{i}")) for i in range(150)] + [(5000, "a repeated document with one more line\n" + hot)] * 150
    got = L.report(spark.createDataFrame(rows, "doc_id long, text string"), min_words=2).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == {0, 1000} and len(got) == 450
    assert all(r.n_removed == 1 and r.text == "a repeated document with one more line" for r in got if r.doc_id == 5000)
