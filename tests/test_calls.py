"""Goldens of call strings, URLs and paths."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calls as c


def one(spark, value, columns):
    return spark.createDataFrame([(value,)], "v string").select(
        *[x.alias(n) for n, x in columns.items()]).first()


@pytest.mark.parametrize("call, expected", [
    ("///pkg:module?method&forcepackagereload=1&methodnotfoundstatus=404",
     ("///pkg:module", "method", "forcepackagereload=1&methodnotfoundstatus=404",
      {"forcepackagereload": "1", "methodnotfoundstatus": "404"})),
    ("///pkg:module?method&forcepackagereload=1",
     ("///pkg:module", "method", "forcepackagereload=1", {"forcepackagereload": "1"})),
    ("mod", ("mod", "", "", {})), ("a?b?c&d=1", ("a", "b", "", {})), ("a?b&x&y=1=2", ("a", "b", "x&y=1=2", {"y": "1"}))])
def test_method_parts(spark, call, expected):
    assert tuple(one(spark, call, c.method_parts(F.col("v")))) == expected


@pytest.mark.parametrize("uri, expected", [
    ("  HTTP://Host:80/a/b?x=1#f", ("http", "Host:80", "/a/b", "x=1", "f", "/a/b?x=1#f")),
    ("http://host", ("http", "host", "/", "", "", "/")),
    ("//host/p#one#two", ("", "host", "/p", "", "two", "/p#one#two")),
    ("a/b#c", ("", "", "a/b", "", "", "a/b#c")),
    ("ftp://h/?q", ("ftp", "h", "/", "q", "", "/?q")),
    ("http://h/p?a#b#c", ("http", "h", "/p", "a", "c", "/p?a#b#c"))])
def test_uri(spark, uri, expected):
    row = one(spark, uri, c.uri_parts(F.col("v")))
    assert (row.scheme, row.authority, row.path, row.query, row.fragment, row.fullpath) == expected


@pytest.mark.parametrize("path, expected", [
    ("a/b/../c", "a/c"), ("a\\b\\..\\c", "a\\c"), ("a/b/c/../../d", "a/b/../d"), ("plain", "plain"), ("../x", "../x")])
def test_canonical(spark, path, expected):
    assert one(spark, path, {"p": c.canonical_path(F.col("v"))}).p == expected


@pytest.mark.parametrize("rel, mod, expected", [
    ("x", "a/b/c", "a/b/x"), ("../x", "a/b/c", "a/x"), ("..\\x", "a\\b\\c", "a\\x"), ("../../../x", "a/b", "../../x")])
def test_relative_name(spark, rel, mod, expected):
    assert one(spark, rel, {"p": c.resolve_relative(F.col("v"), F.lit(mod))}).p == expected


@pytest.mark.parametrize("full, root, expected", [
    ("\\a\\b\\c", "\\a", "\\b\\c"), ("\\a\\b\\c", "\\a\\x", "\\..\\b\\c"), ("\\a\\b", "", "\\a\\b"),
    ("x:\\a\\b\\..\\c", "\\a", "\\c"), ("\\a", "b", None), ("\\a\\b", "\\c\\d", "\\..\\..\\a\\b")])
def test_relative_path(spark, full, root, expected):
    df = spark.createDataFrame([(full, root)], "f string, r string")
    assert c.with_relative_path(df, "f", "r").first().relative == expected


def test_patterns(spark):
    df = spark.createDataFrame([("abc",), ("",)], "v string")
    got = [tuple(r) for r in df.select(c.first_pattern(F.col("v"), ["", "^b", "c$"]),
                                       c.first_equal(F.col("v"), ["x", "abc"])).collect()]
    assert got == [(2, 1), (0, -1)]
