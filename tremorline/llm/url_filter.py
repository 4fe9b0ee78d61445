"""URL filters: host-and-path rules, then a character language-model ratio.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule that fits decides.  Other URLs are judged by two variable-order Markov
models of characters, one of the URLs that rules accept and one of those they
reject: orders 0 to 4, Witten-Bell smoothed from each order to the next shorter one
and at last to a uniform share.  The score is the mean log-likelihood difference by
character.

Half the labelled URLs (by hash) fit the models that the threshold is calibrated
with: the other half gives the one with the best sum of the two rates of right
answers.  The models that judge are then fitted on all labelled URLs.

Characters count as they are, but for A-Z, so contexts are rows of a table that grows
with the corpus.  URLs meet it by a join; it is broadcast only if its rows, which are
counted, are few.  If they are many, only the contexts that hold at least one of
``HOT_SHARE`` places are broadcast, which can't be more than ``HOT_SHARE``; the others,
none of which is frequent then, are joined by shuffle.  DataFrame code only.

Defined results: a null URL, or one without ``://``, has an empty host and path and
no rule; a null URL has the score 0, so its verdict depends on the threshold's sign;
without labelled URLs of both kinds in the fitting half every score is 0, the
threshold is 0 and the verdict is allow; of thresholds that are equally good the
nearest to 0 is taken, then the lower; repeated rows get equal results; an empty table
gives an empty table; a URL may be as long as a row may; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules that are written into one expression.
MOST_RULES = 1000
ORDER = 4
#: The uniform share of a character that no context has seen.
ALPHABET = 256
#: Places of a URL that are cut out at once.
PIECE = 512
#: Rows of a model's table that are broadcast at most (about 60 bytes each).
MOST_BROADCAST = 250_000
#: A context with one of so many places is broadcast in any case.
HOT_SHARE = 50_000
#: What stands before and after a URL.
BEFORE, AFTER = "\x02", "\x03"
#: Scores are calibrated in steps of a hundredth between these bounds.
STEPS, BOUND = 100, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The URL after its scheme, A-Z lower-cased, between ORDER marks of its start and one of its end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url), F.lit(""))
    return F.concat(F.lit(BEFORE * ORDER), F.translate(rest, _UPPER, _LOWER), F.lit(AFTER))


def _grams(urls: DataFrame, *carried: str) -> DataFrame:
    """Each place's character behind its predecessors, as ``g``; long URLs go by pieces, as finding a place takes its distance from the start."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("s") - ORDER - 1) / PIECE).cast("int")), lambda k: F.substring(F.col("s"), k * PIECE + 1, F.lit(PIECE + ORDER)))
    return urls.select(*carried, F.explode(pieces).alias("s")).select(*carried, F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - ORDER), lambda i: F.substring(F.col("s"), i, F.lit(ORDER + 1)))).alias("g"))


#: The labelled URLs that the counts are of: accepted and rejected ones of the fitting half, and of all.
SETS = ("accepted_half", "rejected_half", "accepted", "rejected")


def models(counts: DataFrame) -> DataFrame:
    """(g, half, whole) from (g, the counts of SETS): logs of the accepted model's over the rejected model's probability of g's last character."""
    tables = {ORDER + 1: counts}
    for n in range(ORDER, 0, -1):
        tables[n] = tables[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(*(F.sum(x).alias(x) for x in SETS))
    lower = None
    for n in range(1, ORDER + 2):
        context = F.substring("g", 1, n - 1).alias("c") if n > 1 else F.lit("").alias("c")
        own = tables[n].select("g", context, *SETS)
        totals = own.groupBy("c").agg(*(F.sum(x).alias(f"n {x}") for x in SETS), *(F.count_if(F.col(x) > 0).alias(f"kinds {x}") for x in SETS))
        joined = own.join(totals, "c")
        if lower is not None:
            joined = joined.join(lower, F.substring("g", 2, n - 1) == F.col("shorter"))

        def smoothed(x: str, first: bool = lower is None) -> Column:
            p = F.lit(1.0 / ALPHABET) if first else F.col(f"lower {x}")
            n, kinds = F.col(f"n {x}"), F.col(f"kinds {x}")
            return F.when(n == 0, p).otherwise((F.col(x) + kinds * p) / (n + kinds))

        level = joined.select("g", *(smoothed(x).alias(x) for x in SETS))
        lower = level.select(F.col("g").alias("shorter"), *(F.col(x).alias(f"lower {x}") for x in SETS))
    return level.select("g", (F.log("accepted_half") - F.log("rejected_half")).alias("half"), (F.log("accepted") - F.log("rejected")).alias("whole"))


def frequent(counts: DataFrame) -> DataFrame:
    """(g) of the contexts that hold at least one of HOT_SHARE places, so at most HOT_SHARE rows."""
    places = counts.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n")).first().n
    return counts.where(F.col("places") * HOT_SHARE >= places).select("g")


def _ratios(grams: DataFrame, table: DataFrame, counts: DataFrame) -> DataFrame:
    """The places with the logs of their contexts; every context of a URL is in the table."""
    if table.count() <= MOST_BROADCAST:
        return grams.join(F.broadcast(table), "g")
    hot = F.broadcast(frequent(counts))
    rare = grams.join(hot, "g", "left_anti").join(table.join(hot, "g", "left_anti").hint("merge"), "g")
    return grams.join(F.broadcast(table.join(hot, "g", "left_semi")), "g").unionByName(rare)


def scores(labelled: DataFrame) -> DataFrame:
    """(url, label, score) of distinct URLs, from (url, label): 1 accepted, 0 rejected, null neither.

    Labelled URLs of the calibrating half have scores of the half's models, those without
    a label scores of the whole ones'; the other labelled URLs have no row.
    """
    urls = labelled.where("url is not null").distinct().select("url", "label", (F.substring(F.md5("url"), 1, 1) < "8").alias("fold"), symbols(F.col("url")).alias("s"))
    kinds = {"accepted": F.col("label") == 1, "rejected": F.col("label") == 0}
    flags = [F.coalesce(kinds[x.partition("_")[0]] & (F.col("fold") if x.endswith("half") else F.lit(True)), F.lit(False)).cast("long").alias(x) for x in SETS]
    counts = shared.materialize(_grams(urls.select("s", *flags), *SETS).groupBy("g").agg(*(F.sum(x).alias(x) for x in SETS), F.count("*").alias("places")), "url-counts")
    table = shared.materialize(models(counts), "url-models")
    # 96 bits of hashes stand for a URL in the join
    ids = [F.xxhash64("url").alias("h"), F.hash("url").alias("k")]
    judged = urls.where("label is null or not fold").select("url", "label", *ids, "s")
    ratio = F.when(F.col("calibrates"), F.col("half")).otherwise(F.col("whole"))
    grams = _grams(judged.withColumn("calibrates", F.col("label").isNotNull()), "h", "k", "calibrates")
    means = _ratios(grams, table, counts).groupBy("h", "k").agg(F.avg(ratio).alias("score"))
    return judged.drop("s").join(means, ["h", "k"]).select("url", "label", "score")


def threshold(scored: DataFrame) -> float:
    """The step with the best sum of both rates on the calibrating half; of equal ones the nearest to 0, then the lower."""
    step = F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("score"))) * STEPS).alias("step")
    steps = scored.where(F.col("label").isNotNull()).groupBy(step).agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    # at most 2 * BOUND * STEPS + 1 rows from here on
    below = steps.select("step", F.expr("coalesce(sum(a) over (order by step rows between unbounded preceding and 1 preceding), 0)").alias("ba"), F.expr("coalesce(sum(n - a) over (order by step rows between unbounded preceding and 1 preceding), 0)").alias("br"), F.expr("sum(a) over ()").alias("ta"), F.expr("sum(n - a) over ()").alias("tr"))
    best = below.where("ta > 0 and tr > 0").orderBy(((F.col("ta") - F.col("ba")) * F.col("tr") + F.col("br") * F.col("ta")).desc(), F.abs("step"), "step").first()
    return best.step / STEPS if best else 0.0


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; the score is null where a rule decides."""
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = own.select("*", rule.alias("rule"), verdict.alias("ruled"))
    labelled = ruled.select("url", F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0).alias("label"))
    scored = shared.materialize(scores(labelled), "url-scores")
    kinds = {r.label for r in labelled.where((F.substring(F.md5("url"), 1, 1) < "8") & F.col("label").isNotNull()).select("label").distinct().collect()}
    cut = threshold(scored) if len(kinds) == 2 else 0.0
    score = F.col("score") if len(kinds) == 2 else F.lit(0.0)
    left = scored.where("label is null").select(F.col("url").alias("scored"), score.alias("score"))
    joined = ruled.join(left, ruled["url"] == left["scored"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block")).alias("verdict"), F.col("score"))
