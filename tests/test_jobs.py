"""The jobs on growing and damaged copies of small tables, run again, and after a failure."""

import shutil
from collections import Counter

import pytest

from jobs import text_intake

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIRST = [(i, f"text {i} é", "es" if i % 2 else "en", f"s{i % 3}", len(f"text {i} é")) for i in range(60)]
SECOND = [
    (None, "no key", "en", "s0", 6),
    (100, None, "en", "s0", None),
    (101, " \t", "en", "s1", 2),
    (102, "wrong", "en", "s1", 4),
    (103, "no length", "en", "s1", None),
    (7, "again, another text", "es", "s1", 19),
    (7, "again, another text", "es", "s1", 19),
    (104, "no source", None, None, 9),
    (105, "empty source", None, "", 12),
]
CONFIG = text_intake.read_config() | {"least_rows": 1}


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def plain_report(rows):
    taken = Counter(r[0] for r in rows if judged(r) == "accepted")
    groups = {}
    for r in rows:
        groups.setdefault((r[3] or None, r[2]), []).append(r)
    out = {}
    for key, own in groups.items():
        verdicts, lengths = Counter(map(judged, own)), [len(r[1]) for r in own if r[1] is not None]
        repeated = sum(judged(r) == "accepted" and taken[r[0]] > 1 for r in own)
        share = round(1 - verdicts["accepted"] / len(own), 6)
        out[key] = (len(own), *(verdicts[v] for v in ("accepted", "no_key", "no_text", "wrong_length")), sum(len((r[1] or "").encode()) for r in own), min(lengths, default=None), max(lengths, default=None), repeated, share, share <= CONFIG["most_set_apart"] and not repeated)
    return out


def judged(row):
    key, text, *_, length = row
    return "no_key" if key is None else "no_text" if not (text or "").strip(" ") else "wrong_length" if length != len(text) else "accepted"


def shown(report):
    return {(r.source, r.lang): tuple(r)[2:] for r in report.collect()}


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*.parquet"))


def test_intake_takes_only_what_is_new(spark, tmp_path):
    source, out = tmp_path / "documents.parquet", tmp_path / "out"
    put(spark, FIRST, source)
    assert shown(text_intake.run(spark, str(source), str(out), CONFIG)) == plain_report(FIRST)
    before = files(out / "rows")
    put(spark, SECOND, source)
    assert shown(text_intake.run(spark, str(source), str(out), CONFIG)) == plain_report(FIRST + SECOND)
    assert spark.read.parquet(f"{out}/rows").where("batch = 1").count() == len(SECOND)
    assert set(before) < set(files(out / "rows")), "the first batch's files stay"
    last = files(out / "rows") + files(out / "counts")
    assert shown(text_intake.run(spark, str(source), str(out), CONFIG)) == plain_report(FIRST + SECOND)
    assert last == files(out / "rows") + files(out / "counts"), "nothing new, nothing written"


def test_intake_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "documents.parquet", tmp_path / "out"
    put(spark, FIRST, source)
    text_intake.run(spark, str(source), str(out), CONFIG)
    put(spark, SECOND, source)
    own = text_intake.group_counts

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(text_intake, "group_counts", broken)
    with pytest.raises(Exception, match="lost"):
        text_intake.run(spark, str(source), str(out), CONFIG)
    monkeypatch.setattr(text_intake, "group_counts", own)
    assert spark.read.parquet(f"{out}/rows").where("batch = 1").count() == len(SECOND), "rows were written before the failure"
    assert shown(text_intake.run(spark, str(source), str(out), CONFIG)) == plain_report(FIRST + SECOND)


def test_intake_of_a_file_without_rows_and_a_single_file(spark, tmp_path):
    put(spark, [], tmp_path / "none")
    assert text_intake.run(spark, f"{tmp_path}/none", f"{tmp_path}/out0", CONFIG).count() == 0
    put(spark, FIRST, tmp_path / "some")
    one = next((tmp_path / "some").glob("part-*.parquet"))
    shutil.copy(one, tmp_path / "documents.parquet")
    assert shown(text_intake.run(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/out1", CONFIG)) == plain_report(FIRST)
