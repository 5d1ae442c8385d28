import re

from pyspark.sql import functions as F

from claimwright.llm import url_filter


def brute(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, says in url_filter.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[0]):
                best = (rule, says)
    if best:
        return host, path, best[0], best[1]
    name = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html)?/*$", "", path) if host else None
    return host, path, None, "block" if name in listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://example.com/en/", "https://example.com/en",
    "http://a.example.com/en/1?x=://b", "http://notexample.com/", "http://x.net/es/1", "http://x.net/fr/", "http://x.net",
    "http://x.org/a.html", "https://www.x.org/a/", "http://m.x.org/a?utm=1#t", "http://x.org/b", "http://É.net/es/É",
    "a://b://c.net/fr/", "http://com/", "http://x.org?q", "http://x.com#f",
]


def test_matches_brute_force(spark):
    listed = {"x.org/a", "x.org"}
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 3)] + [(None, "http://x.org/a", "h")], "page_id bigint, url string, host string")
    names = spark.createDataFrame([("x.org/a",), ("x.org/a",), ("x.org",), (None,)], "canonical string")
    got = url_filter.judge_urls(pages, names).collect()
    want = sorted([(i, *brute(u, listed)) for i, u in enumerate(URLS * 3)] + [(None, *brute("http://x.org/a", listed))], key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=repr) == want


def test_false_hits_of_a_full_filter_are_removed(spark):
    pages = spark.createDataFrame([(i, f"http://s{i}.org/") for i in range(500)], "page_id bigint, url string")
    names = spark.createDataFrame([(f"s{i}.org",) for i in range(0, 500, 2)], "canonical string")
    got = url_filter.judge_urls(pages, names, blocks=1)
    assert {r["page_id"] for r in got.where(F.col("verdict") == "block").collect()} == set(range(0, 500, 2))


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge_urls(pages, url_filter.listed_pages(pages)).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "canonical string")
    assert url_filter.judge_urls(one, none).first()["verdict"] == "allow"


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")
    plan = url_filter.judge_urls(pages, url_filter.listed_pages(pages))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
