"""Quirks of request operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import requests as r


def one(spark, schema, row, columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("host, handler", [
    ("x.abc.com", "w"), ("abc.com", "w"), ("zzz.com", None), ("a.b.abc.com:8080", "w"), ("xabc.com", None), ("q.org", "e")])
def test_wildcard_matches_suffix_and_apex(spark, host, handler):
    routes = spark.createDataFrame([(2, "*.abc.com", "w"), (1, "q.org", "e"), (3, "*.org", "late")],
                                   "ord int, route string, handler string")
    rows = spark.createDataFrame([(host,)], "host string")
    assert r.domain_routes(rows, routes).first().handler == handler


def test_a_hot_domain_is_joined_once_per_domain(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 > 0, "hot.abc.com").otherwise("b.org").alias("host"))
    routes = spark.createDataFrame([(1, "*.abc.com", "w")], "ord int, route string, handler string")
    got = r.domain_routes(rows, routes).groupBy("handler").count().collect()
    assert {x.handler: x["count"] for x in got} == {"w": 4500, None: 500}


@pytest.mark.parametrize("content_type, expected", [("text/html", None), ("text/html; charset=utf-8", "utf-8"), (None, None)])
def test_charset(spark, content_type, expected):
    assert one(spark, "v string", (content_type,), {"c": r.charset(F.col("v"))}).c == expected
    assert one(spark, "v string", (content_type,), {"c": r.charset(F.col("v"), "utf-8")}).c == "utf-8"


def test_headers(spark):
    headers = {"host": "front.com/front.com", "connection": "keep-alive", "accept-encoding": "gzip", "x": "front.com"}
    new, audit = r.header_rewrite(F.col("h"), r.REQUEST_RULES, "front.com", "back.io", "request")
    row = one(spark, "h map<string,string>", (headers,), {"n": new, "a": audit})
    assert row.n == {"host": "back.io/front.com", "connection": "close", "x": "front.com"}
    assert ("request.headers.accept-encoding", "gzip", None) in [tuple(a) for a in row.a]
    assert ("request.headers.origin", None, None) in [tuple(a) for a in row.a]
    cookies = one(spark, "c array<string>", (["a=1; domain=back.io", "b"],),
                  {"c": r.rewrite_values(F.col("c"), r.RESPONSE_RULES[0], "front.com", "back.io")}).c
    assert cookies == ["a=1; domain=front.com", "b"]


def test_missing_agent_passes_and_hashes_by_its_name(spark):
    assert one(spark, "a string", (None,), {"d": r.agent_denied(F.col("a"), ["bot"])}).d is False
    df = spark.createDataFrame([(0, "/p", "http", "1.2.3.4", {"host": "h"})],
                               "recorded_us bigint, target string, scheme string, peer string, headers map<string,string>")
    row = r.access_rows(df).first()
    assert row.recordtm == "1970-01-01 00:00:00" and row.ipv4 == 16909060 and row.cookie == "" and row.scheme == "http"
    assert row.useragentmd5 == "5e543256c480ac577d30f76f9120eb74"


OUTCOME = "host string, method string, body string, error string, error_status int, status int, response string"


@pytest.mark.parametrize("row, success, status, reason", [
    (("h", None, None, "reset", 601, None, None), False, 601, "http request error: reset"),
    (("h", "POST", None, None, None, 200, "{}"), False, None, "please specify a body string for request method: POST"),
    (("h", None, "b", None, None, 200, '{"success": true}'), True, 200, None),
    (("h", None, "b", None, None, 200, '{"reason": "r"}'), False, 200, "r"),
    (("h", None, "b", None, None, 0, ""), False, 0, "Can not establish a network connection to h")])
def test_http_outcome(spark, row, success, status, reason):
    got = r.http_outcome(spark.createDataFrame([row], OUTCOME), "host").first()
    assert (got.success, got.final_status, got.reason) == (success, status, reason)
    assert got.network_ok == (row[3] is None and row[1] is None or row[4] is not None)


def test_proxy_unset_is_direct(spark):
    assert one(spark, "u string", ("http://x",), {"p": r.proxy_choice(F.col("u"), None)}).p == "direct"
    assert one(spark, "u string", ("http://x",), {"p": r.proxy_choice(F.col("u"), [])}).p == "proxy"


def test_round_robin_over_slices(spark):
    rows = spark.range(100).select(F.col("id"))
    got = {x.id: x.target_box for x in r.round_robin(rows, ["id"], ["a", "b", "c"], 7).collect()}
    assert got == {i: "abc"[i % 3] for i in range(100)}


def test_long_rule_lists_agree_with_short_ones(spark):
    """2,000 rules make a plan that compiles, and the answers of the short form."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(2_000)]
    calls = spark.createDataFrame([(f"//x/{rng.choice('abcd')}{rng.choice(words)}{i}",) for i in range(60)] + [("plain",), (None,)], "call string")
    rules = [r.Intercept(f"r{i}", w + ("$" if i % 2 else "[0-9]"), i % 3 == 0, f"why {i}") for i, w in enumerate(words)]
    got = [(x.call, x.rule, x.forced_success, x.forced_reason) for x in r.intercept(calls, "call", rules).collect()]
    for call, rule, ok, why in got:
        first = next((q for q in rules if call and call.startswith("//") and re.search(q.pattern, call)), None)
        assert (rule, ok, why) == ((first.id, first.success, None if first.success else first.reason) if first else (None, None, None))
    short = words[:30]
    both = []
    for limit in (50, 10):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(r, "SPELLED_OUT", limit)
            patch.setattr("tidewatch.functions.text.SPELLED_OUT", limit)
            both.append(calls.select(
                r.contains_any(F.col("call"), short), r.first_pattern(F.col("call"), ["", *short]), r.first_equal(F.col("call"), [*short, "plain"]),
                r.starts_with_any(F.col("call"), ["//x/a", *short]), r.alias_rewrite(F.lit("h"), F.col("call"), short, "~")).collect())
    assert [tuple(x) for x in both[0]] == [tuple(x) for x in both[1]]
