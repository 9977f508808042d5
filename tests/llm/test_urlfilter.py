from pyspark.sql import functions as F

from corpusmill.llm.urlfilter import build_cascade, judge_urls, listed_by_cascade

URLS = [None, "", "no scheme", "http://a.net", "HTTP://A.NET/x", "http://x.Example.NET/en/1?q", "http://example.net/fr/",
        "http://example.com/de/1", "https://b.example.com/de", "http://x.org/fr/2#t", "http://org/fr/", "http://xorg/fr/",
        "http://c.org/en/1", "http://h?x/y", "a://b://c/d", "http://c.org/en/1", "http://c.org/en/2", "://", "http://u:p@n.net:80/"]


def expected(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [h + p for h, p in (("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"))
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, "p", "k") for i, u in enumerate(URLS)] + [(None, URLS[12], "p", "k")],
                                  "page_id long, url string, path string, key string")
    listed = spark.createDataFrame([("c.org/en/1",), ("not/there",), (None,), ("c.org/en/1",)], "key string")
    for limit in (1 << 20, 2):                  # one cascade, and one for each of several parts of the keys
        got = judge_urls(pages, listed, max_filter_bytes=limit).collect()
        assert len(got) == len(URLS) + 1
        for r in got:
            host, path, rule = expected(r["url"])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            own = {"net/": "block", "example.com/de/": "block", "example.net/en/": "allow", "org/fr/": "allow"}
            assert r["verdict"] == own.get(rule, "block" if host + path == "c.org/en/1" else "allow")


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 3 = 0")
    levels = build_cascade(listed, universe, first_rate=0.5, rate=0.5)      # rough levels, so many of them
    assert len(levels) > 4
    wrong = universe.withColumn("got", listed_by_cascade(F.col("key"), levels)) \
        .filter("got <> (hash(key) % 3 = 0)")
    assert wrong.count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "key string")
    pages = spark.createDataFrame([(1, "http://a.de/")], "page_id long, url string")
    assert judge_urls(pages, none).first()["verdict"] == "allow"
    assert judge_urls(pages.limit(0), none).count() == 0
