import hashlib
import random

from tremorline.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus():
    rnd = random.Random(4)
    words = ["<|im_end|>", "&amp;", "&lt;|", "<|", "<", "|", "&", "\n", "été", "🙂", "word", "<|im_start|>assistant\n", "7"]
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 14)):
            role = rnd.choice(["user", "assistant"]) if t else rnd.choice(["system", "user"])
            rows.append((c, t, role, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), "x"))
    rows += [(100, None, None, None, None), (100, 0, "assistant", "", None), (100, 0, "assistant", "", None), (None, 5, "ro\nle&nl;", "<", "y"), (None, 6, "assistant", "|>", "y")]
    rows += [(200, 600 * t, "system" if t in (3, 5) else "assistant", f"turn {t} " * 20, None) for t in range(9)]
    return rows


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_digests_at_any_budget(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    for budget, history, limit in ((2048, 256, 768), (120, 40, 60), (60, 0, 20)):
        got = C.digests(C.windows(df, budget, history, limit)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)


def test_large_conversations_get_the_same_windows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    for budget, history, limit in ((2048, 256, 768), (120, 40, 60)):
        want = sorted(map(str, C.windows(df, budget, history, limit).collect()))
        for most_turns, most_bytes in ((0, 0), (6, 1 << 20), (100, 300)):
            assert sorted(map(str, C.windows(df, budget, history, limit, most_turns, most_bytes).collect())) == want
            got = C.window_digests(df, budget, history, limit, most_turns, most_bytes).collect()
            assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(corpus())


def test_text_is_shuffled_once(spark):
    plan = C.window_digests(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_hot_null_conversation(spark):
    rows = [(None, None, "assistant", f"text {i % 7}", None) for i in range(300)] + [(None, 5, "user", "same", None)] * 200 + [(1, 1, "user", "x", None)]
    got = C.window_digests(spark.createDataFrame(rows, SCHEMA), most_turns=100).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)


def test_windows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    found = sorted(C.windows(df, 120, 40, 60).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.window))
    assert len(found) > len({r.conv_id for r in found}) and any(r.n_context > 1 for r in found)
    for before, r in zip([None, *found], found):
        pieces = [x for x in r.formatted.split("<|im_start|>")[1:]]
        assert len(pieces) == r.n_turns and all(p.count("<|im_end|>\n") == 1 and p.endswith("<|im_end|>\n") for p in pieces)
        if before is not None and before.conv_id == r.conv_id:
            own = [p for p in pieces[: r.n_context] if not p.startswith("system\n")]
            assert own == before.formatted.split("<|im_start|>")[1:][len(before.formatted.split("<|im_start|>")) - 1 - len(own) :]
        else:
            assert r.n_context == 0
        assert not r.over_budget or r.n_tokens > 120
        for s in r.loss:
            assert r.formatted[s.start - len("assistant\n") : s.start] == "assistant\n" and r.formatted[s.start + s.length :].startswith("<|im_end|>\n")
    late = [r.formatted for r in found if r.conv_id == 200]
    first = next(i for i, f in enumerate(late) if "system\nturn 3" in f)
    assert all(f.startswith("<|im_start|>system\nturn 3") and f.count("turn 3 turn 3") for f in late[first + 1 :]) and len(late) > first + 1


def test_budget_holds_for_short_turns(spark):
    df = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", "a b c d e f g h", None) for t in range(200)], SCHEMA)
    rows = C.windows(df, 120, 40, 20).collect()
    assert len(rows) > 10 and not any(r.over_budget for r in rows)


def test_native_and_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = C.digests(C.windows(df))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
    assert C.digests(C.windows(df.limit(0))).count() == 0
