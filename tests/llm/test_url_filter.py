import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tremorline.llm import url_filter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate(str.maketrans(U._UPPER, U._LOWER)), m[2]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(rows):
    urls = {u: rule(*parts(u)) for _, u in rows if u is not None}
    fold = {u: hashlib.md5(u.encode()).hexdigest()[0] < "8" for u in urls}
    k = U.ORDER

    def text(u):
        return U.BEFORE * k + (u.split("://", 1)[1] if "://" in u else u).translate(str.maketrans(U._UPPER, U._LOWER)) + U.AFTER

    def fitted(chosen):
        counts = {v: defaultdict(Counter) for v in ("allow", "block")}
        for u, (_, v) in urls.items():
            if v and chosen(u):
                s = text(u)
                for i in range(k, len(s)):
                    for n in range(k + 1):
                        counts[v][s[i - n : i]][s[i]] += 1
        return counts

    def p(counts, context, c):
        seen = counts[context]
        lower = p(counts, context[1:], c) if context else 1 / U.ALPHABET
        n = sum(seen.values())
        return lower if not n else (seen[c] + len(seen) * lower) / (n + len(seen))

    half, whole = fitted(lambda u: fold[u]), fitted(lambda u: True)

    def score(u, counts):
        s = text(u)
        return sum(math.log(p(counts["allow"], s[i - k : i], s[i])) - math.log(p(counts["block"], s[i - k : i], s[i])) for i in range(k, len(s))) / (len(s) - k)

    held = [(math.floor(max(-20, min(20, score(u, half))) * 100), v) for u, (_, v) in urls.items() if v and not fold[u]]
    na, nr = sum(v == "allow" for _, v in held), sum(v == "block" for _, v in held)
    if {v for u, (_, v) in urls.items() if v and fold[u]} != {"allow", "block"}:
        return {r: (*parts(u), *((rule(*parts(u))) if rule(*parts(u))[0] else (None, "allow"))) for r, u in rows}
    cut = 0.0
    if na and nr:
        steps = {s for s, _ in held}
        best = max(steps, key=lambda t: (sum(s >= t and v == "allow" for s, v in held) * nr + sum(s < t and v == "block" for s, v in held) * na, -abs(t), -t))
        cut = best / 100
    out = {}
    for r, u in rows:
        h, q = parts(u)
        name, v = rule(h, q)
        out[r] = (h, q, name, v or ("allow" if (score(u, whole) if u is not None else 0) >= cut else "block"))
    return out


def rows(n, seed=1):
    rnd = random.Random(seed)
    hosts = ["example.org", "a.example.org", "Shop.EXAMPLE.com", "news.site.com", "x.net", "notexample.org", "bestorg", "casino.net", "org", "example.com:80"]
    paths = ["/fr/1", "/de/2?x=1", "/en/12", "/en/2", "/es/9#t", "", "/", "?q=/fr/", "/fr", "/de/casino-win", "/FR/1"]
    out = [(i, f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', rnd.randint(0, 999)])}") for i in range(n)]
    return [*out, (9001, None), (9002, "no scheme"), (9003, ""), (9004, "://"), (9005, "a://b://c.org/"), (9006, "http://é.org/ü")]


def got(spark, data):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(spark.createDataFrame(data, "page_id long, url string")).collect()}


def test_as_brute_force(spark):
    data = rows(300)
    assert got(spark, data) == brute(data)


def test_joined_as_broadcast(spark, monkeypatch):
    data = rows(200, 3)
    want = got(spark, data)
    monkeypatch.setattr(U, "MOST_BROADCAST", 0)
    assert got(spark, data) == want == brute(data)


def test_contexts_in_every_url(spark, monkeypatch):
    data = [(i, u and u.replace("://", "://www.same.", 1)) for i, u in rows(200, 5)]
    want = got(spark, data)
    monkeypatch.setattr(U, "MOST_BROADCAST", 0)
    for share in (60, 1):  # some contexts are frequent; none is
        monkeypatch.setattr(U, "HOT_SHARE", share)
        assert got(spark, data) == want == brute(data)


def test_frequent_contexts_are_few(spark, monkeypatch):
    monkeypatch.setattr(U, "HOT_SHARE", 60)
    urls = spark.createDataFrame([(f"http://www.same.org/{i * i}",) for i in range(500)], "url string").select(U.symbols(F.col("url")).alias("s"))
    counts = U._grams(urls).groupBy("g").agg(F.count("*").alias("places"))
    hot = {r.g for r in U.frequent(counts).collect()}
    places = {r.g: r.places for r in counts.collect()}
    assert 0 < len(hot) <= 60 and ".same" in hot
    assert hot == {g for g, n in places.items() if n * 60 >= sum(places.values())}
    assert U.frequent(counts.limit(0)).count() == 0


def test_contexts_grow_with_the_corpus(spark):
    def size(n):
        df = spark.createDataFrame([(f"http://x{i * 7919 % 10007}.org/é{i}%2F{i * 31}", i % 2) for i in range(n)], "url string, label int")
        flags = [F.lit(1).cast("long").alias(x) for x in U.SETS]
        return U._grams(df.select(U.symbols(F.col("url")).alias("s"), *flags), *U.SETS).select("g").distinct().count()

    assert size(2000) > 3 * size(200)
    a, b = (spark.range(1).select(U.symbols(F.lit(f"http://e.org/{x}"))).first()[0] for x in ("en/1", "en/2"))
    assert a != b


def test_long_urls(spark):
    data = [*rows(60, 4), (1000, "http://x.net/" + "a/é" * 20000), (1001, "http://y.com/fr/" + "z" * 30000)]
    out = got(spark, data)
    assert len(out) == len({r for r, _ in data}) and out[1001][2:] == ("com/fr/", "allow") and len(out[1000][1]) == 60001


def test_without_labels(spark):
    data = [(1, "http://x.net/a"), (2, None), (None, "http://y.net/"), (3, "http://z.com/fr/")]
    assert got(spark, data) == brute(data)
    assert got(spark, []) == {}


def test_repeated_rows_and_extra_columns(spark):
    data = [(i % 7, u, "h", "s") for i, u in rows(80, 2)] * 2
    out = U.judge(spark.createDataFrame(data, "page_id long, url string, host string, score string"))
    assert out.count() == len(data) and out.columns == ["page_id", "host", "path", "rule", "verdict", "score"]


def test_native(spark):
    plan = U.judge(spark.createDataFrame(rows(5), "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
