"""Rules against a plain reading; the trees on addresses whose labels they did not see."""

import re
import pytest

from tidemark.llm import urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/1", "https://a.example.com/EN/1", "http://www.example.com/en/x?y=1#z", "http://x.www.example.com/en/",
        "http://m.example.net/es/1", "http://net/fr/", "http://example.com", "http://example.com?en/", "ftp://xcom/a", "http://a.com#/en/", "a://b://c.com/en/",
        "http://notexample.com/en/1", "x\ny://example.com/en/\n?q"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def frame(spark, rows):
    return spark.createDataFrame([(k, u, "x", "x") for k, u in rows], "page_id long, url string, host string, label string")


def test_rules(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[4]), (4, URLS[4])]
    got = urls.judged_urls(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain(dict(rows)[r.page_id] if r.page_id is not None else URLS[4])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.block_score is None) == (rule is not None)


def test_one_class_and_empty(spark):
    got = urls.judged_urls(frame(spark, [(1, "http://a.com/"), (2, "http://b.org/")])).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert urls.judged_urls(frame(spark, [(1, "x")]).filter("false")).count() == 0


def test_trees_learn_lexical_features(spark):
    """Labels by rule for .aa and .bb hosts; .cc hosts with many digits and parameters look like the blocked ones."""
    rules = [urls.UrlRule("allow", "aa", "/"), urls.UrlRule("block", "bb", "/")]
    good = [(i, f"http://site{i % 7}.aa/{'news' if i % 2 else 'talk'}/page") for i in range(200)]
    bad = [(1000 + i, f"http://x{i * 7919}.bb/{i * 104729}/{i}?a={i}&b={i * 3}&c=1") for i in range(200)]
    new = [(5000, "http://other.cc/news/page"), (5001, "http://y99123.cc/88213374/17?a=9&b=27&c=1")]
    got = {r.page_id: r for r in urls.judged_urls(frame(spark, good + bad + new), rules=rules).filter("page_id >= 5000").collect()}
    assert got[5000].verdict == "allow" and got[5001].verdict == "block"


@pytest.mark.parametrize("text,bits", [("", 0.0), ("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0)])
def test_entropy(spark, text, bits):
    from pyspark.sql import functions as F

    assert abs(spark.createDataFrame([(text,)], "t string").select(urls._entropy(F.col("t"))).first()[0] - bits) < 1e-9
