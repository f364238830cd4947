"""The split folds against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.ordered import SLICE, chain, cut, running


def _rows(seed, n=600, step=40):
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(6)}"
        clock[key] = clock.get(key, 0) + rng.choice([0, 1, rng.randrange(step), rng.randrange(step * 4) if rng.random() < .1 else 2])
        rows.append((key, clock[key], i, rng.randrange(5), rng.random() < 0.03))
    return rows


@pytest.fixture(scope="module", params=[1, 5, 16])
def table(spark, request):
    rows = _rows(request.param)
    df = spark.createDataFrame(rows, "key string, ts bigint, id bigint, size bigint, bad boolean")
    return rows, cut(df, ["key"], ["ts", "id"], request.param)


def test_hot_key_spans_slices(table):
    rows, df = table
    slices = df.where("key = 'hot'").select(SLICE).distinct().count()
    assert slices == 1 or slices > 2


def test_running(table):
    rows, df = table
    got = running(df, ["key"], ["ts", "id"], sums={"total": F.col("size")},
                  lasts={"seen": F.when(F.col("size") == 3, F.col("id"))},
                  previous={"before": (F.col("id"), 3)}).collect()
    expect, state = {}, {}
    for key, ts, i, size, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, seen, prev = state.get(key, (0, None, []))
        total, seen = total + size, i if size == 3 else seen
        expect[i] = (total, seen, prev[-3:])
        state[key] = (total, seen, prev + [i])
    assert {r["id"]: (r["total"], r["seen"], r["before"]) for r in got} == expect


@pytest.mark.parametrize("width", [0, 7, 60, 500])
@pytest.mark.parametrize("mode", ["plain", "force", "opens"])
def test_chain(table, width, mode):
    rows, df = table
    df = df.withColumn("wide", F.col("size") > 0)
    got = chain(df, ["key"], ["ts", "id"], "ts", width, ["id"],
                force="bad" if mode == "force" else None,
                opens="wide" if mode == "opens" else None).collect()
    expect, state = {}, {}
    for key, ts, i, size, bad in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        a = found = state.get(key)
        new = a is None or ts - a[0] > width or (mode == "force" and bad)
        if mode == "opens" and size == 0:
            new = False
        if new:
            a = state[key] = (ts, i)
        expect[i] = (new, found and found[0], a and a[0], a and a[1])
    assert {r["id"]: (r["is_anchor"], r["anchor_before"], r["anchor"], r["anchor_id"]) for r in got} == expect


def test_many_slices_inside_one_window(spark):
    """A window over many slices of one key: right rows, and one carried row per slice and key."""
    from tidewatch.functions import ordered
    rng, rows, at = random.Random(8), [], 0
    for i in range(1_500):
        at += rng.choice([1, 1, 2, 5])
        rows.append(("hot", at, i, rng.random() < 0.002))
    df = cut(spark.createDataFrame(rows, "key string, ts bigint, id bigint, bad boolean"), ["key"], ["ts", "id"], 40)
    carried, entries = [], ordered._entries
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ordered, "_entries", lambda *a: carried.append(entries(*a)) or carried[-1])
        for force in (None, "bad"):
            got = {r["id"]: (r["is_anchor"], r["anchor"]) for r in chain(df, ["key"], ["ts", "id"], "ts", 900, force=force).collect()}
            anchor = None
            for _, ts, i, bad in rows:
                new = anchor is None or ts - anchor > 900 or (force and bad)
                anchor = ts if new else anchor
                assert got[i] == (bool(new), anchor)
    for table in carried:
        assert table.count() <= 40 and not any("array" in kind for _, kind in table.dtypes)


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_attach(spark, hot_rows):
    from tidewatch.functions.skew import attach
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    per_key = rows.where("key <> 'k0'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = {r.id: r.first for r in attach(rows, per_key, ["key"], "n", ["id"], hot_rows).collect()}
    first = {}
    for i in range(2000):
        key = "hot" if i % 3 else f"k{i % 700}"
        first.setdefault(key, i)
        assert got[i] == (None if key == "k0" else first[key])
