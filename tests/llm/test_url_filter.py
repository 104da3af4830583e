from kinetra.llm.url_filter import judge_urls, rules_table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("x.org", "", "block"), ("x.org", "/a", "allow"), ("tie.org", "/t", "allow"), ("tie.org", "/t", "block"), (None, "/", "block")]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    path = path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def expected(url):
    host, path = parsed(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if h is not None
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "HTTP://EXAMPLE.COM/en/x?y#z", "https://www.example.com/en/",
        "https://a.b.www.example.com/en/1", "https://notexample.com/en/", "http://net/es/", "http://a.net/es", "http://a.net/es/#f", "ftp://x.org?q=/a",
        "http://x.org/abc", "http://y.x.org", "http://tie.org/tt", "http://É.COM/é", "http://a://b.com/", "http://com/", "http://.com/", "http://a..net/es/1",
        "http://" + ".".join(["l"] * 3000) + ".net/es/", "http://h.com/" + "p/" * 20000, "http://example.com/en/\nx"]


def test_rows_match_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[6]), (3, URLS[6]), (None, URLS[7])]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules_table(spark, RULES))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, u, *expected(u)) for i, u in rows), key=str)


def test_clashing_columns_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([("p", "http://a.net/es/", 1, "old")], "Host string, url string, _host int, rule string")
    assert [tuple(r) for r in judge_urls(pages, rules_table(spark, RULES)).collect()] == [("http://a.net/es/", 1, "a.net", "/es/", "net/es/", "block")]
    none = judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block")
    assert [tuple(r) for r in none.collect()] == [("http://a.net/es/", 1, "a.net", "/es/", None, "block")]
    assert judge_urls(pages.limit(0), rules_table(spark, RULES)).collect() == []
