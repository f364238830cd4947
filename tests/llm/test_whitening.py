"""Whitening against exact fractions and a plain eigendecomposition."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import whitening
from tidewatch.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


def brute_force(rows, components=8):
    """(id, component) to (n, deviation, |whitened|, explained) for vectors of one length."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, d = x.shape
    s = x.sum(axis=0)
    c = n * x - s
    v = np.array([[float(Fraction(int((c[:, j] * c[:, k]).sum()), n**3)) for k in range(d)] for j in range(d)])
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    out = {}
    for (key, _), row in zip(rows, c):
        for m, at in enumerate(order, 1):
            turned = abs(float((row / n).astype(float) @ axes[:, at]) / np.sqrt(e[at]))
            out[key, m] = (n, int((row * row).sum()), turned, e[at] / np.trace(v))
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, turned, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error <= 1e-9
        assert abs(r.whitened) == pytest.approx(turned, abs=1e-7) and r.explained == pytest.approx(share, rel=1e-9)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5).flatmap(lambda d: st.lists(
    st.lists(st.one_of(st.integers(-3, 3), st.integers(-(1 << 62), 1 << 62)), min_size=d, max_size=d), min_size=1, max_size=150)))
def test_scatter_is_exact(rows):
    sums, products = whitening.scatter(np.array(rows, np.int64) // 2)
    x = np.array(rows, np.int64).astype(object) // 2
    assert sums.tolist() == x.sum(axis=0).tolist()
    j, k = np.triu_indices(x.shape[1])
    assert products[j, k].tolist() == (x.T @ x)[j, k].tolist()


@given(st.lists(st.integers(-(1 << 100), 1 << 100), min_size=1))
def test_limbs_carry_any_number(numbers):
    a0, a1, a2 = (p.to_pylist() for p in whitening.limbs(np.array(numbers, object)))
    assert [x + (y << 40) + (z << 80) for x, y, z in zip(a0, a1, a2)] == numbers


def test_query_equals_a_plain_version(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op13_whitening"](spark, folder).collect(), brute_force(rows))


def test_odd_vectors(spark):
    """Null, non-finite and empty vectors give no rows; lengths are fits of their own."""
    rng = np.random.default_rng(2)
    three = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    one = [(100 + i, [float(i * i)]) for i in range(5)]
    alone = [(200, [1.0, 2.0])]
    bad = [(300, None), (301, []), (302, [1.0, None, 2.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame(three + one + alone + bad, SCHEMA).repartition(4)
    rows = whitening.whiten_report(table).collect()
    check([r for r in rows if r.vec_id < 100], brute_force(three))
    check([r for r in rows if 100 <= r.vec_id < 200], brute_force(one))
    lonely = [r for r in rows if r.vec_id >= 200]
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lonely} == {
        (200, 1, 1, 0, None, 0.0, None), (200, 2, 1, 0, None, 0.0, None)}


def test_models_in_several_passes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=1 + i % 5).tolist()) for i in range(100)]
    table = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(str, whitening.whiten(table).collect()))
    assert sorted(map(str, whitening.whiten(table, model_bytes=1).collect())) == one and len(one) == 100


def test_identity_error_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 3))
    rows = [(3, r.tolist()) for r in x] + [(1, [None])] * 3
    found = set()
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        for parts in (1, 5, 8):
            table = spark.createDataFrame(order, "d int, whitened array<double>").coalesce(parts)
            found.add(tuple(sorted((r.d, r.identity_error) for r in whitening.identity_errors(table, 4).collect())))
    assert len(found) == 1
    (one, nothing), (three, error) = found.pop()
    assert (one, nothing, three) == (1, None, 3) and abs(error - np.abs(np.cov(x.T, bias=True) - np.eye(3)).max()) < 1e-14


def test_repeated_rows_null_ids_and_flat_dimensions(spark):
    """Repeats count in the fit; a dimension without spread has no whitened value."""
    rows = [(None, [1.0, 5.0])] * 3 + [(1, [2.0, 5.0])] * 2
    got = whitening.whiten_report(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS key", "'own' AS d")).collect()
    assert len(got) == 10 and {r.n for r in got} == {5}
    assert {(r.component, r.whitened is None, r.explained) for r in got} == {(1, False, 1.0), (2, True, 0.0)}
    by_id = {r.vec_id: r.deviation for r in got}
    assert by_id == {None: (5 * 1 - 7) ** 2 * 1024**2, 1: (5 * 2 - 7) ** 2 * 1024**2}


def test_huge_components(spark):
    """Beyond a long, the deviation is null and the rest still stands."""
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 1].deviation is None and got[1, 1].explained == pytest.approx(1.0) and len(got) == 6


def test_no_vectors(spark):
    assert whitening.whiten_report(spark.createDataFrame([], SCHEMA)).collect() == []
