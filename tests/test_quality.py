"""Expectations and differences."""

import pytest
from pyspark.sql import Row

from tidewatch.operators import quality as q


def first(spark, row, condition, schema=None):
    df = spark.createDataFrame([row], schema)
    v = q.check(df, condition).first().first_violation
    return v and v.reason


SHIPMENT = ("order struct<paid:boolean,lines:int,note:string>, weights array<double>, tags map<string,string>, "
            "open array<string>, cancelled timestamp, route array<struct<stop:string,minutes:int>>, extra struct<>")
GOOD = ((True, 4, "leave at the gate"), [2.5, 12_345_678.0], {"zone": "north", "lane": "7b"}, [], None,
        [("depot", 0), ("harbour", 55)], ())
SUITE = {
    "__contextName__": "shipment",
    "order": {"__operators__": {"lines": "greater than", "note": "contain"}, "paid": True, "lines": 3, "note": "gate"},
    "weights": [2.5, 12_345_678.0], "tags": {"zone": "north", "__operators__": {"lane": "same length"}, "lane": "xx"},
    "open": {}, "cancelled": None, "route": {"1": {"stop": "harbour", "minutes": 55}}}


def test_a_nested_suite(spark):
    assert first(spark, GOOD, SUITE, SHIPMENT) is None
    assert q.outcome(spark.createDataFrame([GOOD], SHIPMENT), SUITE, ["cancelled"]).first().success
    bad = [((True, 2, "at the gate"), "order.lines", "to be greater than 3 but got 2"), ((False, 9, "x"), "order.paid", "to equal true but got false")]
    for order, path, words in bad:
        assert first(spark, (order, *GOOD[1:]), SUITE, SHIPMENT) == f"[shipment] Expected {path} {words}"


@pytest.mark.parametrize("place, value, condition, reason", [
    (1, [2.5, 7.0], {"weights": [2.5, 12_345_678.0]}, " Expected weights.1 to equal 12345678 but got 7"),
    (1, [2.5], {"weights": [2.5, 1.0]}, " Expected number but got undefined at weights.1"),
    (1, [2.5, None], {"weights": [2.5, 1.0]}, " Expected number but got object at weights.1"),
    (1, [12_345_678.0], {"weights": {"0": 5678, "__operators__": {"0": "contain"}}}, None),
    (1, [0.00001], {"weights": [1]}, " Expected weights.0 to equal 1 but got 0.00001"),
    (1, [1.0], {"weights": []}, " Expected an empty array/object for weights but it was non-empty."),
    (2, {"zone": "south"}, {"tags": {"zone": "north"}}, " Expected tags.zone to equal north but got south"),
    (2, {}, {"tags": {"zone": "north"}}, " Expected string but got undefined at tags.zone"),
    (2, {"zone": None}, {"tags": {"zone": "north"}}, " Expected string but got object at tags.zone"),
    (2, {"zone": None}, {"tags": {"zone": None}}, None),
    (0, (True, 1, "n"), {"order": {}}, " Expected an empty array/object for order but it was non-empty."),
    (6, (), {"extra": {}}, None),
    (5, [("depot", 0)], {"route": [{"minutes": 1}]}, " Expected route.0.minutes to equal 1 but got 0")])
def test_lists_maps_and_structs(spark, place, value, condition, reason):
    row = [*GOOD[:place], value, *GOOD[place + 1:]]
    assert first(spark, tuple(row), condition, SHIPMENT) == reason


@pytest.mark.parametrize("value, condition, reason", [
    (6, {"v": 6, "__operators__": {"v": "greater than"}}, None),
    (5, {"v": 6, "__operators__": {"v": "greater than"}}, " Expected v to be greater than 6 but got 5"),
    (6, {"v": 6, "__operators__": {"v": "strictly greater than"}}, " Expected v to be strictly greater than 6 but got 6"),
    (5, {"v": "5"}, " Expected string but got number at v"),
    (None, {"v": 5}, " Expected number but got object at v"),
    (5, {"w": 5}, " Expected number but got undefined at w"),
    (5, {"v": 5, "__operators__": {"v": "close to"}}, ' Unknown operator "close to"'),
    (0, {"v": 1, "__operators__": {"v": "contain"}}, " Expected v to contain 1 but the property was missing."),
    (0, {"v": 1, "__operators__": {"v": "notcontain"}}, " Expected v to contain 1 but the property was missing."),
    (12, {"__contextName__": "ctx", "v": 3, "__operators__": {"v": "contain"}}, "[ctx] Expected v to contain '3'."),
    (5, {"v": None}, " Expected object but got number at v")])
def test_leaves(spark, value, condition, reason):
    assert first(spark, (value,), condition, "v int") == reason


def test_operators_of_a_branch_above_apply_below():
    leaves = q.flatten({"__operators__": {"a": {"b": "contain"}}, "a": {"b": "x", "c": 1}})
    assert [(e.name, e.op) for e in leaves] == [("a.b", "contain"), ("a.c", "equal")]


def test_a_bare_value_compares_the_whole(spark):
    assert first(spark, Row(assertionValue="x"), "x") is None
    assert first(spark, Row(assertionValue="x"), "y") == " Expected assertionValue to equal y but got x"


def test_parity(spark):
    shape = "id int, label string, share double"
    left = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "c", 0.0), (None, "n", 1.0), (7, "p", 1.0), (7, "q", 1.0), (8, "p", 1.0), (8, "p", 1.0)], shape)
    right = spark.createDataFrame([(1, None, 0.5), (2, None, 0.5), (4, "c", 0.0), (None, "n", 2.0), (7, "q", 1.0), (7, "p", 1.0), (8, "p", 1.0)], shape)
    got = {r.subject: r.differing for r in q.parity(left, right, ["id"]).collect()}
    assert got == {"only left": 1, "only right": 1, "repeated keys": 1, "label": 1, "share": 1}
    assert {r.differing for r in q.parity(left, left, ["id"]).collect()} == {0}
    assert q.one_sided(left, left).isEmpty()
    assert sorted((r.side, r.label or "") for r in q.one_sided(left, right).where("id IN (2, 8)").collect()) == [("left", ""), ("left", "p"), ("right", "")]
