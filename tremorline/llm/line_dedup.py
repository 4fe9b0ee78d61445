"""Near-duplicate lines across a corpus by a deletion-neighbourhood join.

Two lines are near if one word's insertion, deletion or substitution turns one into
the other; lines are compared lower-cased, with runs of spaces, tabs and carriage returns as single spaces.
A line goes if an earlier line, by (document id, place), equals it or is near it;
lines under ``min_chars`` characters always stay, and those under ``min_words`` words
(2 at least, as an edit leaves nothing of a single word) are compared for equality only.  All of this is DataFrame code; no Python runs on
the executors.

* Every line emits hashes of about its first and its last half of words.  Near lines
  share at least one of these, so lines that share none with a different line drop out
  (pre-aggregated as least and largest line hash by key, then a semi join).
* Of the others, the text of each distinct line is fetched from its first place.  They
  emit their deletion neighbourhood as hashed keys: the line without its j-th word, and
  the line itself at each boundary, named by length, place and the hashes of what stands
  before and after.  Lines that share their first m words differ behind these, so only
  places there are emitted; likewise for the last m words.  In lines of over ``LONG``
  words the hashes come from running aggregates, so a long line costs its length and
  not its square.
* Lines with an equal key are within the edit bound by construction.  For each key
  the earliest line is found by aggregation, and the others are joined to it, so rows
  grow with the lines and not with their pairs.  The texts of a line and its earliest
  partner are then compared to verify the edit distance exactly.

All filters are semi joins on keys that were aggregated before: nothing is broadcast by
this module, no structure has a size of its own, and adaptive execution can split what
is hot.  Texts are shuffled twice: to fetch the lines in question, and to leave out
those that go.

Defined results: null texts stay null; a null document id counts as the last one;
rows that share id and text count as one document and get equal results; an empty
table gives an empty table; a document that loses all lines keeps an empty text; a line
may be as long as its document; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

MIN_CHARS = 20
MIN_WORDS = 8
#: The least min_words: of every line with more than one word something is left by an edit.
LEAST_WORDS = 2
#: Words up to which each place of a line is hashed by itself; about there that costs what sorting the words does.
LONG = 1024
_LAST = 0x7FFFFFFFFFFFFFFF
_D, _T, _GONE = "line dedup: document", "line dedup: text hash", "line dedup: places"


def normalize(text: Column) -> Column:
    """Lower case; in each line, runs of spaces, tabs and carriage returns as single spaces, none at the ends."""
    low = F.lower(text)
    odd = F.lit(False)
    for c in ("  ", "\t", "\r", " \n", "\n "):
        odd = odd | text.contains(c)
    tidy = F.regexp_replace(F.regexp_replace(low, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    return F.trim(F.when(odd, tidy).otherwise(low))


def _keys(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(docs[key].cast("long"), F.lit(_LAST)), F.xxhash64(docs[text])


def _lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(d, t, pos, norm, h, g): the lines that take part, with two hashes."""
    d, t = _keys(docs, key, text)
    split = docs.select(d.alias("d"), t.alias("t"), F.posexplode(F.split(normalize(docs[text]), "\n")).alias("pos", "norm"))
    return split.where(F.length("norm") >= min_chars).select("*", F.xxhash64("norm").alias("h"), F.hash("norm").alias("g"))


def _n_words(norm: str = "norm") -> Column:
    return F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


#: The lengths of the hashed parts are multiples of this many words, in lines of twice as many at least.
STEP = 4


def _halves(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds m, a, z, a2, z2: hashes of the first and last m words, null where not needed.

    m is the greatest multiple of STEP (in shorter lines, of 1) within half the words n.
    One edit leaves m words alone at one of the ends, and the other line's m is the same
    unless n + 1 reaches the next multiple; such lines emit that one, too.
    """
    step = F.when(F.col("n") >= 2 * STEP, STEP).otherwise(1)
    m = F.floor(F.col("n") / (2 * step)).cast("int") * step

    def part(m: Column, sign: int, when: Column) -> Column:
        return F.when(when, F.xxhash64(F.call_function("substring_index", F.col("norm"), F.lit(" "), m * sign), m, F.lit(sign)))

    long = (F.col("n") >= min_words) & (m > 0)
    more = (F.col("n") >= min_words) & (F.col("n") % (2 * step) == 2 * step - 1)
    return lines.select("*", _n_words().alias("n")).select("*", m.alias("m"), part(m, 1, long).alias("a"), part(m, -1, long).alias("z"), part(m + step, 1, more).alias("a2"), part(m + step, -1, more).alias("z2"))


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(h, g, d, t, pos, m, a, z, a2, z2) of the lines that take part, written once."""
    return shared.materialize(_halves(_lines(docs, key, text, min_chars), min_words).select("h", "g", "d", "t", "pos", "m", "a", "z", "a2", "z2"), "lines")


def _shared_halves(lines: DataFrame) -> DataFrame:
    """(h, g, ma, mz): of each line that shares a half with a different line, the least number of first and of last words shared."""
    more = F.col("m") + F.when(F.col("m") >= STEP, STEP).otherwise(1)
    ends = [F.struct(F.col("a").alias("x"), F.col("m").alias("s")), F.struct(F.col("z").alias("x"), (-F.col("m")).alias("s"))]
    ends += [F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), (more * sign).alias("s"))) for x, sign in (("a2", 1), ("z2", -1))]
    halves = lines.where("a is not null").select("h", "g", F.explode(F.array_compact(F.array(*ends))).alias("e")).select("h", "g", "e.x", "e.s")
    several = halves.groupBy("x").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("x")
    return halves.join(several, "x", "left_semi").groupBy("h", "g").agg(F.min(F.when(F.col("s") > 0, F.col("s"))).alias("ma"), F.min(F.when(F.col("s") < 0, -F.col("s"))).alias("mz"))


def in_question(lines: DataFrame) -> DataFrame:
    """(h, g, d, t, pos, d_min, ma, mz): places of lines that repeat (d_min: their least document id) or share a half."""
    repeated = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("d").alias("d_min")).where("n > 1")
    marks = repeated.select("h", "g", "d_min", F.lit(None).cast("int").alias("ma"), F.lit(None).cast("int").alias("mz")).unionAll(_shared_halves(lines).select("h", "g", F.lit(None).cast("long"), "ma", "mz"))
    marks = marks.groupBy("h", "g").agg(F.max("d_min").alias("d_min"), F.max("ma").alias("ma"), F.max("mz").alias("mz"))
    return shared.materialize(lines.select("h", "g", "d", "t", "pos").join(marks, ["h", "g"]), "lines-in-question")


def _texts(docs: DataFrame, places: DataFrame, key: str, text: str) -> DataFrame:
    """(h, g, first, ma, mz, norm, n) of the distinct lines that share a half, each from its first place."""
    firsts = places.where("ma is not null or mz is not null").groupBy("h", "g").agg(F.min(F.struct("d", "t", "pos")).alias("first"), F.max("ma").alias("ma"), F.max("mz").alias("mz"))
    # a document's list is no longer than its lines
    wanted = firsts.groupBy("first.d", "first.t").agg(F.collect_list(F.struct("h", "g", "first", "ma", "mz")).alias("wanted"))
    d, t = _keys(docs, key, text)
    found = docs.select(d.alias("d"), t.alias("t"), docs[text].alias("text")).join(wanted, ["d", "t"])
    lines = found.select(F.split(normalize(F.col("text")), "\n").alias("lines"), "wanted")
    each = lines.select(F.explode(F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get("lines", w["first"]["pos"]).alias("norm")))).alias("e")).select("e.w.*", "e.norm")
    return shared.materialize(each.dropDuplicates(["h", "g"]).select("*", _n_words().alias("n")), "line-texts")  # repeated rows are one document


def _variants(texts: DataFrame) -> DataFrame:
    """(h, g, x, p, q): the deletion neighbourhood as keys x, with the words before and after the place.

    Lines of LONG + 1 words go both ways, so that near lines always meet in one of them.
    """
    lo, hi = F.when(F.col("mz").isNull(), F.col("ma")).otherwise(0), F.when(F.col("ma").isNull(), F.col("n") - F.col("mz")).otherwise(F.col("n"))
    own = texts.select("h", "g", "norm", "n", lo.alias("lo"), hi.alias("hi"))
    cut = lambda size, place, before, behind: F.xxhash64(size, place, before, behind)

    def hashes(sign: int, words) -> Column:
        return F.transform(F.sequence("lo", "hi"), lambda j: F.xxhash64(F.call_function("substring_index", F.col("norm"), F.lit(" "), words(j) * sign)))

    ends = own.where(F.col("n") <= LONG + 1).select("h", "g", "n", "lo", "hi", hashes(1, lambda j: j).alias("upto"), hashes(-1, lambda j: F.col("n") - j).alias("after"))
    at = lambda name, j: F.get(name, j - F.col("lo"))
    whole = F.transform(F.sequence("lo", "hi"), lambda j: F.struct(cut(F.col("n"), j, at("upto", j), at("after", j)).alias("x"), j.alias("p"), (F.col("n") - j).alias("q")))
    less = F.transform(F.sequence(F.col("lo") + 1, F.col("hi")), lambda j: F.struct(cut(F.col("n") - 1, j - 1, at("upto", j - 1), at("after", j)).alias("x"), (j - 1).alias("p"), (F.col("n") - j).alias("q")))
    short = ends.select("h", "g", F.explode(F.concat(whole, less)).alias("v")).select("h", "g", "v.x", "v.p", "v.q")

    line, by_place = "partition by h, g", "partition by h, g order by j"
    # dealt by line before its words are taken apart, so the windows below need no shuffle of words
    words = own.where(F.col("n") > LONG).repartition("h", "g").select("h", "g", "n", "lo", "hi", F.posexplode(F.split("norm", " ")).alias("j", "w"))
    words = words.select("h", "g", "n", "lo", "hi", (F.col("j") + 1).alias("j"), F.xxhash64("w", "j").alias("a"), F.xxhash64("w", F.col("n") - F.col("j")).alias("z"))
    runs = words.select(
        "h", "g", "n", "lo", "hi", "j",
        F.expr(f"bit_xor(a) over ({by_place} rows unbounded preceding)").alias("upto"),
        F.col("a"),
        F.expr(f"bit_xor(z) over ({line})").alias("all_z"),
        F.expr(f"bit_xor(z) over ({by_place} rows unbounded preceding)").alias("z_upto"),
    )
    after = F.col("all_z").bitwiseXOR(F.col("z_upto"))
    runs = runs.where("j >= lo and j <= hi")  # the windows need all words, the keys don't
    every = F.array(
        F.struct(cut(F.col("n") - 1, F.col("j") - 1, F.col("upto").bitwiseXOR(F.col("a")), after).alias("x"), (F.col("j") - 1).alias("p"), (F.col("n") - F.col("j")).alias("q")),
        F.struct(cut(F.col("n"), F.col("j"), F.col("upto"), after).alias("x"), F.col("j").alias("p"), (F.col("n") - F.col("j")).alias("q")),
        F.when(F.col("j") == 1, F.struct(cut(F.col("n"), F.lit(0), F.lit(0).cast("long"), F.col("all_z")).alias("x"), F.lit(0).alias("p"), F.col("n").alias("q"))),
    )
    long = runs.select("h", "g", F.explode(F.array_compact(every)).alias("v")).select("h", "g", "v.x", "v.p", "v.q")
    return short.unionAll(long)


def near_lines(docs: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, g): the distinct lines that are near an earlier, different line; ``places`` is in_question()."""
    texts = _texts(docs, places, key, text)
    variants = _variants(texts)
    met = variants.groupBy("x").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("x")
    own = shared.materialize(variants.join(met, "x", "left_semi").join(texts.select("h", "g", "first"), ["h", "g"]), "line-variants-met")
    earliest = own.groupBy("x").agg(F.min("first").alias("least"))
    pairs = own.join(earliest, "x").where("least < first").select("h", "g", "least", "p", "q").distinct()
    partner = texts.select(F.col("first").alias("least"), F.col("norm").alias("other"))
    seen = pairs.join(partner, "least").join(texts.select("h", "g", "norm"), ["h", "g"])
    same = " and ".join(f"substring_index(norm, ' ', {m}) = substring_index(other, ' ', {m})" for m in ("p", "-q"))
    sizes = "abs(size(split(norm, ' ')) - size(split(other, ' '))) <= 1 and greatest(size(split(norm, ' ')), size(split(other, ' '))) <= p + q + 1"
    return seen.where(f"{same} and {sizes}").select("h", "g").distinct()


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, pos) of the line places that go."""
    if min_words < LEAST_WORDS:
        raise ValueError(f"min_words must be {LEAST_WORDS} at least")
    places = in_question(hashed_lines(docs, key, text, min_chars, min_words))
    near = near_lines(docs, places, key, text).withColumn("near", F.lit(True))
    judged = shared.materialize(places.join(near, ["h", "g"], "left").where("near or d_min is not null").select("h", "g", "d", "t", "pos", "d_min", "near"), "lines-judged")
    # all places of a near line go; of a repeated one, those in later documents, and in the first document all but the first
    tied = judged.where("near is null and d = d_min")
    first = tied.groupBy("h", "g").agg(F.min(F.struct("t", "pos")).alias("first"))
    later = tied.join(first, ["h", "g"]).where("struct(t, pos) <> first")
    return judged.where("near or d > d_min").select("d", "t", "pos").unionAll(later.select("d", "t", "pos"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with two more columns: the kept text and the number of removed lines."""
    gone = dropped(docs, key, text, min_chars, min_words).groupBy(F.col("d").alias(_D), F.col("t").alias(_T)).agg(F.collect_set("pos").alias(_GONE))
    d, t = _keys(docs, key, text)
    joined = docs.join(gone, (d == gone[_D]) & (t == gone[_T]), "left")

    def left(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_GONE)), lambda i: F.get(lines, i)), "\n")

    # the text is split once, as the only entry of an array whose entry the inner function sees
    kept = F.get(F.transform(F.array(F.split(docs[text], "\n")), left), 0)
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns), F.when(F.col(_GONE).isNull(), docs[text]).otherwise(kept).alias("line dedup: kept"), F.coalesce(F.size(_GONE), F.lit(0)).alias("line dedup: removed"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its columns, the text without the lines that go."""
    marked = mark(docs, key, text, min_chars, min_words)
    return marked.select(*(F.col("line dedup: kept").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every document."""
    marked = mark(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), min_words=min_words)
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return marked.select("doc_id", F.coalesce(n_lines, F.lit(0)).alias("n_lines"), F.col("line dedup: removed").alias("n_removed"), F.col("line dedup: kept").alias("text"))
