import random

from pyspark.sql import functions as F

from quiverlake.llm import urlfilter as U

RULES = U.CONTRACT_RULES


def judge(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [
    None, "", "no scheme/en/", "http://", "http://a.example.com/en/7", "http://A.EXAMPLE.com/en/70?x#y", "https://example.com/en/8", "https://notexample.net/de/8", "x://net/de/1", "http://net",
    "http://b.org/es/#f", "http://b.org/es", "http://com/en/", "http://com?/en/", "http://h.net/de/8://x", "http://example.net/de/8", "ftp://é.com/en/é", "http://a.com./en/", "http://example.com/en/7" + "7" * 50_000,
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")
    rows = U.judge(df, RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judge(URLS[r.page_id % len(URLS)]), URLS[r.page_id % len(URLS)]


def test_ties_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert U.judge(df, [("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "block")]).first().verdict == "block"
    assert U.judge(df, []).first().verdict == "allow"
    assert U.judge(df.limit(0), RULES).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(3)
    keys = [f"k{rng.random()}" for _ in range(4000)]
    listed = keys[:900]
    universe = spark.createDataFrame([(k,) for k in keys + keys[:50]], "key string")
    c = U.Cascade.build(universe, spark.createDataFrame([(k,) for k in listed], "key string"), bits_per_key=4, hashes=2)
    assert len(c.levels) > 2
    got = {r.key for r in universe.where(c.contains(F.col("key"))).collect()}
    assert got == set(listed)
    assert spark.createDataFrame([(None,)], "key string").where(c.contains(F.col("key"))).count() == 0


def test_many_rules_in_parts_and_many_shapes(spark):
    rng = random.Random(5)
    rules = [(".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), "/" + "".join(rng.choice("xy") for _ in range(rng.randrange(90))), rng.choice(["block", "allow"])) for _ in range(300)]
    urls = [f"http://{rng.choice('abc')}.{h}{p}{rng.choice(['', 'x', '?q'])}" for h, p, _ in rules] + ["http://c.c/" + "x" * 500]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in U.judge(df, rules, max_bytes=150).collect():  # three parts
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], rules), urls[r.page_id]


def test_cascade_that_is_cut_off_stays_exact(spark):
    keys = [f"k{i}" for i in range(600)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    for levels in (1, 2):
        c = U.Cascade.build(universe, universe.where("key LIKE '%7%'"), bits_per_key=2, hashes=1, max_levels=levels)
        assert c.last and {r.key for r in universe.where(c.contains(F.col("key"))).collect()} == {k for k in keys if "7" in k}
