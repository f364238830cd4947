"""Nested JSON unfolded and folded, against plain versions."""

import json
import random

import pytest

from tidewatch.operators import nested


def plain_nodes(value, path=""):
    """(path, type) of all nodes below the top, and texts of the scalars that are texts."""
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for name, child in inner:
        at = f"{path}.{name}" if path else str(name)
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
        if at:
            yield at, kinds.get(type(child), "number"), child if isinstance(child, str) else None
        yield from plain_nodes(child, at)


def some_json(rng, depth=0):
    kind = rng.random()
    if depth > 11 or kind < 0.25:
        return rng.choice([1, -2.5, "x", 'é"\\\n', True, False, None, "", "中"])
    if kind < 0.5:
        return [some_json(rng, depth + 1) for _ in range(rng.randint(0, 2))]
    return {rng.choice(["a", "b", "", "c.d", "é"]): some_json(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_all_nodes_of_random_records(spark):
    rng = random.Random(4)
    records = [some_json(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, body string")
    got = sorted((r.id, r.path, r.type, r.value if r.type == "string" else None) for r in
                 nested.json_nodes(df, "id", "body").collect())
    want = sorted(((i, *n) for i, r in enumerate(records) for n in plain_nodes(r)), key=repr)
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("body, leaves", [
    ('{"a": 1.50, "b": 1e21, "c": 1e-7, "d": 12345678901234567890, "e": -0.0, "f": 9007199254740993, "g": 0.1}',
     {"a": "1.5", "b": "1e+21", "c": "1e-7", "d": "12345678901234567000", "e": "0", "f": "9007199254740992", "g": "0.1"}),
    (r'{"lone": "\ud83dx", "pair": "😀"}', {"lone": "?x", "pair": "😀"}),
    ('{"k": {"x": 1}, "k": {"y": [2, 3]}, "z": 1, "z": 2}', {"k.y.0": "2", "k.y.1": "3", "z": "2"}),
    ("[]", {}), ("5", {}), ("", {}), (" ", {}), ("{", {}), ('{"a": NaN}', {}), ('{"a" 1}', {}), ("[1,]", {}), ('"text"', {}),
    (' [ true , { "" : { "" : false } } ] ', {"0": "true", "1..": "false"}),
])
def test_leaves(spark, body, leaves):
    df = spark.createDataFrame([(1, body), (2, None)], "id int, body string")
    assert {r.path: r.value for r in nested.json_to_flat(df, "id", "body").collect()} == leaves


def test_parser_without_a_limit_reads_the_same(spark):
    rng = random.Random(8)
    for _ in range(2_000):
        record = some_json(rng)
        body = json.dumps(record, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        got = [(p, k, v if k == "string" else None) for p, k, v in nested.parse_nodes(body)]
        assert got == list(plain_nodes(record))
        again = [(p, k, v if k == "string" else None) for p, k, v in nested.nodes_of(body)]
        assert sorted(again, key=repr) == sorted(got, key=repr)


@pytest.mark.parametrize("depth", [900, 20_000])
def test_depth_is_not_limited(spark, depth):
    bodies = ['{"a":' * depth + "[1,true]" + "}" * depth, "[" * depth + '"x"' + "]" * depth, "[" * depth]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = {(r.id, r.path): r.value for r in nested.json_to_flat(df, "id", "body").collect()}
    assert rows == {(0, ".".join("a" * depth + "0")): "1", (0, ".".join("a" * depth + "1")): "true", (1, ".".join("0" * depth)): "x"}


# ------------------------------------------------------------------------ folding

def plain_fold(entries):
    """Set path after path, as a program would, and write the object."""
    top = {}
    for _, path, value in sorted(entries, key=lambda e: (e[0], e[1], e[2])):
        *parents, last = path.split(".")
        spot = top
        for name in parents:
            inner = spot.get(name)
            if not isinstance(inner, dict):
                if inner is not None and inner not in nested.ABSENT:
                    spot = None
                    break
                inner = spot[name] = {}
            spot = inner
        if spot is not None:
            spot[last] = value

    def written(node):
        if not isinstance(node, dict):
            return node
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v)}" for k, v in node.items()) + "}"
    return written(top)


def test_folding_equals_setting_path_after_path(spark):
    """Paths above and below each other, set again and again in any order."""
    rng = random.Random(6)
    records = {}
    for i in range(600):
        names = ["a", "b", "é", ""][: rng.randint(2, 4)]
        paths = [".".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        records[i] = [(n if rng.random() < 0.9 else 3, p, rng.choice(['"x"', '""', "0", "null", "false", "7", '"q\\"'.replace("\\", "") + '"']))
                      for n, p in enumerate(paths)]
        records[i] = [(o, p, v if v.count('"') % 2 == 0 else '"y"') for o, p, v in records[i]]
    flat = spark.createDataFrame([(i, p, v, o) for i, e in records.items() for o, p, v in e],
                                 "id int, path string, value string, ord int").repartition(5)
    got = {r.id: r.json for r in nested.flat_to_json(flat, "id").collect()}
    wrong = [(records[i], got[i], plain_fold(e)) for i, e in records.items() if got[i] != plain_fold(e)]
    assert not wrong, wrong[:3]


def test_deep_paths_and_no_paths(spark):
    deep = ".".join("a" * 60)
    flat = spark.createDataFrame([(1, deep, "1", 1), (None, "x", "2", 1), (2, None, "3", 1)],
                                 "id int, path string, value string, ord int")
    got = {r.id: r.json for r in nested.flat_to_json(flat, "id").collect()}
    assert got == {1: '{"a":' * 60 + "1" + "}" * 60, None: '{"x":2}', 2: "{}"}
    assert nested.flat_to_json(flat.where("id > 5"), "id").collect() == []
