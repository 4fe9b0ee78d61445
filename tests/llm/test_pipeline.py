"""The corpus pipeline against the stages' brute-force versions, and the queries' contracts."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tremorline.llm import queries, simhash_dedup, toxicity

from .test_decontaminate import brute as brute_contaminations
from .test_line_dedup import brute as brute_lines
from .test_simhash_dedup import brute_components, brute_print

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = [a + b for a in ("th", "er", "in", "on", "qu", "sta") for b in ("a", "e", "ing", "s", "t", "re", "ly")]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(6)]
    boiler = say(14)
    rows = []
    for i in range(160):
        lines = [say(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 4))]
        toxic = i % 5 == 0
        if toxic:
            lines[0] += " vile filth scorn"
        if i % 4 == 1:
            lines.append(boiler if i % 8 == 1 else boiler + " x")
        if i % 20 == 7:
            lines.append(rnd.choice(items)[1])
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 5, int(toxic)))
    rows += [(200 + i, rows[i][1], "fr", "copy", 5, rows[i][5]) for i in range(0, 40, 3)]
    rows += [(300, None, None, None, None, 0), (301, "", "en", "x", 0, 0)]
    where = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "<|x|>")], "conv_id long, turn long, role string, text string").write.parquet(f"{where}/conversations.parquet")
    spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string").write.parquet(f"{where}/pages.parquet")
    return where, [r[:2] for r in rows], items


def test_run_as_brute_force(spark, tables):
    where, rows, items = tables
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    kept = [r for r in rows if scorer.score(r[1]) < 0.5]
    assert 20 < len(rows) - len(kept) < 60
    lines = brute_lines(kept)
    assert sum(n for _, n in lines) > 20
    kept = [(d, t) for (d, _), (t, _) in zip(kept, lines)]
    groups = brute_components([brute_print(t) for _, t in kept])
    least = {}
    for (d, _), g in zip(kept, groups):
        least[g] = min(d, least.get(g, d))
    kept = [r for r, g in zip(kept, groups) if least[g] == r[0]]
    bad = {d for d, _ in brute_contaminations(kept, items)}
    assert bad
    kept = [r for r in kept if r[0] not in bad]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    assert set(got) == {d for d, _ in kept}
    for d, text in kept:
        ids = LIB.encode(text or "", add_special_tokens=False).ids
        assert got[d].text == text and got[d].ids == struct.pack(f"<{len(ids)}I", *ids) and got[d].decoded == LIB.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns(spark, tables):
    where, *_ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "benchmark_decontamination", "bpe_encode_decode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes] and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), where).count() == 0


def test_queries(spark, tables):
    where, rows, _ = tables
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 13))}
    frames = {n: q(spark, where) for n, q in queries.QUERIES.items()}
    for n in ("op1_token_output", "op2_token_counts", "op4_simhash", "op5_bpe_codec", "op6_media_audio", "op7_line_dedup", "op9_toxicity", "op11_importance_resampling", "op12_sharding"):
        assert sorted(r.doc_id for r in frames[n].select("doc_id").collect()) == sorted(d for d, _ in rows), n
    prints = {r.doc_id: r.fingerprint for r in frames["op4_simhash"].collect()}
    assert all(prints[d] == f"{brute_print(t):016x}" for d, t in rows)
    codes = {r.doc_id: r for r in frames["op5_bpe_codec"].collect()}
    for d, t in rows[:20]:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        assert codes[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and codes[d].n_tokens == len(ids)
    assert {r.conv_id for r in frames["op3_chat_format"].collect()} == {-1, 1}
    assert [tuple(r) for r in frames["op8_url_filter"].collect()] == [(1, "a.org", "/x", "org/", "allow")]


def test_simhash_signs():
    assert simhash_dedup.signed(2**64 - 1) == -1 and simhash_dedup.signed(5) == 5
