"""URL verdicts against SQL over whole tables and against plain Python on odd urls."""

import os
import re
import sys

import pytest

from decisionlab.llm import queries, url_reputation
from decisionlab.llm.url_reputation import Rule

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import check_oracle  # noqa: E402

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_host_reputation"])
def test_native_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    for step in ("Python", "Pandas", "Arrow", "CartesianProduct"):
        assert step not in plan_of(df)
    got = check_oracle.table(df.columns, [tuple(r) for r in df.collect()])
    result = check_oracle.connect(SF).execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == check_oracle.table(names, result.fetchall())


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = None
    for r in queries.URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.text) > len(best.text):
                best = r
    return best


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme.com/en/", "://", "http://", "http://COM", "http://com/", "https://Example.COM/en/x?y",
        "https://a.example.com/en", "https://www.example.com/en/1#f", "https://x.www.example.com/en/1",
        "http://notexample.com/en/", "ftp://b.net/es/", "http://net/fr/x", "http://b.net?/es/", "http://b.net#/es/",
        "http://ÄB.Net/es/1", "http://b.net/es/http://c.com/", "x" * 50_000 + "://a.net/fr/" + "y" * 50_000,
        "http://b.net/es/1", "http://b.net/es/1",
    ]
    rows = [(i if i != 4 else None, u, "h", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bad int")
    outcomes = spark.createDataFrame([("http://b.net/1", 1), (None, 0), ("http://q.org/", None)], "url string, bad int")
    got = url_reputation.judge(pages, outcomes, queries.URL_RULES).collect()
    want = []
    for key, url, *_ in rows:
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        want.append((key, host, path, rule and rule.text, rule and rule.verdict))
    seen = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got]
    assert sorted(map(repr, seen)) == sorted(map(repr, want))
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert url_reputation.judge(pages.filter("false"), outcomes, []).count() == 0
    none = url_reputation.judge(pages, outcomes.filter("false"), [])
    assert {(r.verdict, r["mean"]) for r in none.collect()} == {("allow", 0.5)}


def test_hosts_shrink_to_their_domain_and_suffix(spark):
    rows = [("a.bad.net", 1)] * 200 + [("b.bad.net", 1)] * 3 + [("c.good.net", 0)] * 300 + [("d.good.net", 1)]
    rows += [("new.bad.net", None), ("new.good.net", None), ("x.other.org", None)] + [("e.mixed.org", i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "host string, bad int")
    got = {r.host: r for r in url_reputation.host_reputation(df).collect()}
    assert got["a.bad.net"].low > 0.9 and got["c.good.net"].high < 0.1
    assert got["new.bad.net"].n == 0 and got["new.bad.net"]["mean"] > 0.5 > got["new.good.net"]["mean"]
    assert got["d.good.net"]["mean"] < 1 and got["d.good.net"].low < 0.5
    assert got["b.bad.net"].low < got["a.bad.net"].low
    assert got["new.good.net"]["mean"] < got["x.other.org"]["mean"] < got["new.bad.net"]["mean"]


def test_long_suffixes(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.uk",), ("",)], "host string")
    from pyspark.sql import functions as F

    got = df.select(
        url_reputation.domain_of(F.col("host"), ("co.uk",)), url_reputation.suffix_of(F.col("host"), ("co.uk",))
    ).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.uk", "uk"), ("", "")]


def test_a_rule_for_everything(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = [Rule("block", "org", ""), Rule("allow", "a.org", "/x")]
    got = url_reputation.judge(pages, pages.selectExpr("url", "0 AS bad"), rules).first()
    assert (got.rule, got.verdict) == ("a.org/x", "allow")
