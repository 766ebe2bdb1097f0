import random

from ledgerlume.llm import queries, urlfilter


def brute(url, rules, default="allow"):
    host, path = urlfilter.split_url(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def test_split():
    assert urlfilter.split_url("http://A.b.NET/x/?q#f") == ("a.b.net", "/x/")
    assert urlfilter.split_url("http://a#/x") == ("a", "")
    assert urlfilter.split_url("a/b") == urlfilter.split_url(None) == ("", "")
    assert urlfilter.split_url("x://h?u=a://b/c") == ("h", "")


def test_both_ways_against_brute_force(spark):
    r = random.Random(3)
    label, part = ["a", "b", "net", "org", "", "a-b", "a/"[:1]], ["", "/", "/x", "/x/", "/xy", "/x/y/"]
    host = lambda: ".".join(r.choice(label) for _ in range(r.randint(1, 4)))
    rules = [(host(), r.choice(part), r.choice(["allow", "block"])) for _ in range(60)]
    rules += rules[:5] + [(None, "/", "block"), ("a", None, "block"), ("", "/", "block"), ("b", "/", "maybe")]
    own = [x for x in rules if x[0] and x[1] is not None and x[2] != "maybe"]
    urls = [(i, f"http://{host()}{r.choice(part)}{r.choice(part)}{r.choice(['', '?a', '#b'])}") for i in range(300)] + [(i, "http://a.b.net/x/y/") for i in range(300, 500)] + [(500, None), (501, ""), (None, "http://b.net/x"), (500, None)]
    pages = spark.createDataFrame([(i, u, "<p>", "h", "k") for i, u in urls], "page_id long, url string, html string, host string, key string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(map(str, [(i, *brute(u, own)) for i, u in urls]))
    for few in (1000, 0):
        got = urlfilter.judge_urls(pages, table, map_rules=few, range_rows=40)
        assert sorted(map(str, map(tuple, got.collect()))) == want
    assert urlfilter.judge_urls(pages.limit(0), table).count() == 0
    assert urlfilter.judge_urls(pages, table.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


def test_rules_of_the_query(spark):
    pages = spark.createDataFrame([(1, "http://X.Example.NET/en/a"), (2, "http://example.net/de/"), (3, "http://a.org/fr/x"), (4, "http://examplexnet/en/"), (5, "http://m.example.com/de/1")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert [(r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).orderBy("page_id").collect()] == [("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "allow"), ("example.com/de/", "block")]


def _both(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u) for i, u in urls], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(map(str, [(i, *brute(u, rules)) for i, u in urls]))
    for few in (1000, 0):
        got = urlfilter.judge_urls(pages, table, map_rules=few, **more).collect()
        assert sorted(map(str, map(tuple, got))) == want


def test_ids_are_exact_beside_nulls_in_ranges_without_urls(spark):
    rules = [("z.net", "/", "block"), ("a.org", "/x", "allow"), ("m.com", "/", "block")]
    big = 1 << 53
    for ids in ((big + 1, big + 3, None), (None, None), (big + 1,), (-big - 1, None, 2**63 - 1)):
        _both(spark, [(i, "http://a.org/x") for i in ids], rules, range_rows=1)
    _both(spark, [], rules, range_rows=1)
    _both(spark, [(1, None), (None, "http://z.net/")], rules, range_rows=1)


def test_many_rules_of_one_range(spark):
    r = random.Random(5)
    rules = [(f"h{r.randrange(400)}.hot.net", f"/p{i % 50}", r.choice(["allow", "block"])) for i in range(3000)] + [("net", "/", "block"), ("hot.net", "/p", "allow")]
    _both(spark, [(i, f"http://h{r.randrange(500)}.hot.net/p{r.randrange(60)}/q") for i in range(200)] + [(i, "http://h7.hot.net/p1") for i in range(300)], rules, range_rows=100)


def test_rules_too_long_for_a_broadcast_are_swept_by_range(spark):
    rules = [("a.net", "/" + "y" * 300, "block"), ("a.net", "/", "allow")]
    _both(spark, [(1, "http://b.a.net/" + "y" * 301), (2, "http://a.net/q")], rules, map_bytes=100)
