import re

import duckdb
import pytest
from helpers import with_clashes

from cadence.llm import url_filter as u

URLS = ["http://a.net/x", "https://example.net/en/5", "https://m.example.net/EN/5", "http://EXAMPLE.net/en/1?x=/de/", "http://notexample.net/en/",
        "http://x.example.com/de/9#top", "http://example.com/de", "https://b.org/fr/", "https://borg/fr/", "ftp://net/", "no scheme", "", None, "http://",
        "http://a.net", "http://a.net?x", "x://y://z.net/", "http://ÄB.net/ü", "http://a.net/\nb", "http://a.net/x"]


def plain(url, rules):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if m is None else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])
    fit = [(-len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    _, rule, verdict = min(fit, default=(0, None, u.DEFAULT))
    return host, path, rule, verdict


@pytest.mark.parametrize("rules", [u.QUERY_RULES, [], [("a.net/", "block"), ("b.net/", "allow"), ("a.net/x", "allow")]])
def test_against_plain_rules(spark, rules):
    df = with_clashes(spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[0]), (3, URLS[3])], "page_id long, url string"))
    got = u.filter_urls(df, u.rules_frame(spark, [u.host_rule(*r) for r in rules])).collect()
    want = [(i, *plain(x, rules)) for i, x in [*enumerate(URLS), (None, URLS[0]), (3, URLS[3])]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sql_agrees_on_odd_urls(spark):
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    assert sorted(con.sql(u.SQL).fetchall(), key=repr) == sorted(((i, *plain(x, u.QUERY_RULES)) for i, x in enumerate(URLS)), key=repr)


def test_rules_are_filed_under_the_rarest_token(spark):
    addresses = spark.createDataFrame([("a.example.com/x",)] * 5 + [("rare.com/x",)], "address string")
    rules = [("rare.com/", r"rare\.com", ["rare", "com"], "block"), (".*", ".*", [], "allow"), ("com/", "com", ["com"], "block")]
    got = {r["rule"]: r["token"] for r in u.rule_index(addresses, u.rules_frame(spark, rules)).collect()}
    assert got == {"rare.com/": "rare", ".*": "", "com/": "com"}


def test_unfinished_path_words_are_no_tokens():
    assert u.host_rule("example.net/en", "block")[2] == ["example", "net"]
    assert u.host_rule("example.net/en/", "block")[2] == ["example", "net", "en"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.filter_urls(df, u.rules_frame(spark, [u.host_rule(*r) for r in u.QUERY_RULES])).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    out = u.filter_urls(df, u.rules_frame(spark, [u.host_rule(*r) for r in u.QUERY_RULES]))
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", out._jdf.queryExecution().executedPlan().toString())
