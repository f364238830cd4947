"""Near-duplicates, repeated passages, lines and shards against plain versions."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidewatch.llm import components, embeddings, lines, sharding, simhash, substrings

ALL = (1 << 64) - 1


@settings(max_examples=300, deadline=None)
@given(st.integers(0, ALL), st.sets(st.integers(0, 63), max_size=2))
def test_masks_cover_the_radius(bits, flips):
    other = bits ^ sum(1 << i for i in flips)
    assert any(bits & (m & ALL) == other & (m & ALL) for m in simhash.masks())


def test_fingerprint_by_hand():
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(b" \n") == 0
    one = simhash.xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b"A  b") & ALL == one
    hashes = [simhash.xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c a", b"c a b", b"a b c")]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > 4)
    assert simhash.fingerprint(b"a b c A b c") & ALL == want


@pytest.mark.parametrize("paired", [2, 48])
def test_links_connect_all_pairs_within_the_radius(spark, paired):
    """Chains, dense groups and single flips, with and without the way for large buckets."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:6]:
        prints |= {base ^ (1 << i) for i in rng.sample(range(64), 12)}
        step = base
        for _ in range(8):
            step ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(step)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "bits bigint")
    roots = {r.node: r.root for r in components.components(simhash.links(df, paired)).collect()}
    got = Counter(roots.get(s[0], s[0]) for s in signed)
    group = {p: p for p in prints}
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2 and group[a] != group[b]:
            old, new = group[a], group[b]
            group = {k: new if v == old else v for k, v in group.items()}
    assert sorted(got.values()) == sorted(Counter(group.values()).values())


def test_simhash_of_documents(spark, make, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    near = [(10_000 + i, t + " one more word") for i, t in rows[:80]]
    docs = make([(i, t, "s") for i, t in rows + near])
    got = [tuple(r)[:3] for r in simhash.near_duplicate_report(docs).collect()]
    assert sorted(got) == sorted(simhash.brute_force(rows + near))


def test_simhash_of_odd_documents(odd, make):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicate_report(odd).collect()}
    assert rows[(1, "0" * 16)] == rows[(2, "0" * 16)] == rows[(3, "0" * 16)] == rows[(None, "0" * 16)] == 1
    assert {c for (i, _), c in rows.items() if i == 6} == {5} and {c for (i, _), c in rows.items() if i == 8} == {7}
    assert {c for (i, f), c in rows.items() if i is None and f != "0" * 16} == {None}
    assert simhash.near_duplicate_report(make([])).count() == 0


def test_one_of_each_group_stays(make):
    docs = make(ODD, clash=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 9, 10] and ids.count(None) == 1


def test_unrelated_texts_with_equal_or_no_ids_stay(make):
    rows = [(None, "one text without an id", "a"), (None, "quite another thing nobody has numbered", "b"),
            (3, "first text under this number", "a"), (3, "unrelated words that share the number", "b"),
            (4, "first text under this number", "c")]
    kept = sorted(r.text for r in simhash.keep_one(make(rows)).collect())
    assert kept == sorted(t for _, t, _ in rows[:4])


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (8, 7), (39, 41)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "x bigint, y bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [*range(7, 40), 41]}
    assert components.components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def vectors_by_hand(rows, cosine=0.9):
    good = {}
    for n, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            good[n] = x / np.sqrt(x @ x)
    group, count = list(range(len(rows))), [0] * len(rows)
    for a, b in itertools.combinations(good, 2):
        if len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
            count[a], count[b] = count[a] + 1, count[b] + 1
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    return sorted((i, c, least[g], i == least[g]) for (i, _), c, g in zip(rows, count, group))


def test_vector_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * rng.choice([0.02, 0.25, 0.6])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [(400, [2 * c for c in rows[5][1]])]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0.0]), (504, [1.0, float("nan"), 0.0]),
             (505, [float("inf"), 1.0, 0.0]), (506, [3e38] * 6), (507, [1.0] * 6), (508, [1.0, 2.0]), (509, [2.0, 4.0]),
             (5, rows[7][1])]
    want = vectors_by_hand(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    for block, run, part in ((2_048, 256, 50_000), (16, 4, 100)):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "RUN", run)
        monkeypatch.setattr(embeddings, "PART_ROWS", part)
        assert sorted(tuple(r) for r in embeddings.near_vectors(df).collect()) == want


def test_vector_join_drops_distant_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    rows = [(i, (centres[i // 40] + rng.normal(size=8) * 0.01).tolist()) for i in range(320)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr(
        "vec_id AS id", "1L AS n", "embedding AS v")
    turn = embeddings.axes(df, 8)
    table = embeddings.blocks(df, turn, np.sqrt(0.2)).cache()
    pairs = embeddings.near_blocks(table, 8, np.sqrt(0.2)).count()
    assert pairs < 0.3 * table.count() * (table.count() + 1) / 2


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0


text = st.lists(st.sampled_from("a b c".split()), max_size=40)


@settings(max_examples=200, deadline=None)
@given(text, text, text, text, text, st.integers(2, 9))
def test_equal_windows_have_equal_names(left, passage, right, left2, right2, window):
    """Whatever stands around a passage, its windows get the same names."""
    def names(before, after):
        ws = before + passage + after
        arr = np.array([hash(w) & ALL for w in ws] or [0], np.uint64)
        found, whole = substrings.window_names(arr, np.zeros(len(arr), int), window)
        count = max(0, len(passage) - window + 1)
        return found[len(before):len(before) + count].tolist(), whole[len(before):len(before) + count].tolist()
    assert names(left, right) == names(left2, right2)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_all_windows(spark, make, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range((2, 12, 400)[seed])]
    base = [rng.choice(vocabulary) for _ in range(600)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            at, n = rng.randrange(500), rng.choice([12, 13, 14, 20, 60])
            words += base[at:at + n] + [rng.choice(vocabulary) for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(80), " ".join(words), "s"))
    rows += [(100 + i, rows[3][1], "s") for i in range(5)] + [(200, "one " * 40, "s"), (201, "one " * 30, "s")]
    got = sorted(tuple(r) for r in substrings.repeat_report(make(rows, parts=5)).collect())
    assert got == sorted(substrings.brute_force([r[:2] for r in rows]))


def test_repeats_in_odd_documents(odd, make):
    got = sorted((tuple(r) for r in substrings.repeat_report(odd).collect()), key=str)
    want = [(None if w[0] == substrings.NULL_ID else w[0], *w[1:]) for w in substrings.brute_force([r[:2] for r in ODD])]
    assert got == sorted(want, key=str)
    assert substrings.repeat_report(make([])).count() == 0


def test_lines_near_and_far_from_the_threshold(spark, make):
    """Exact on both sides of the threshold, where sketches are estimates."""
    rows = [(n * 1_000 + i, f"line {n}\nown {n} {i}", f"site{i}") for n in (279, 299, 300, 301, 340) for i in range(n)]
    docs = make(rows, parts=4)
    left = {r.doc_id: r.text for r in lines.strip_boilerplate(docs, least=300)[0].collect()}
    for n in (279, 299, 300, 301, 340):
        assert left[n * 1_000] == (f"own {n} 0" if n >= 300 else f"line {n}\nown {n} 0")


def test_lines_of_odd_documents(make):
    rows = [(i, f"\n same \r\nline {i}\n\nsame", f"s{i}") for i in range(3)]
    rows += [(3, "same", None), (None, "same\nkept", "s0"), (4, None, "s1"), (5, "", "s2"), (6, "same\n", "s0"), (6, "same\n", "s0")]
    docs = make(rows, clash=True)
    stripped, counted, removed = lines.strip_boilerplate(docs, least=3)
    assert stripped.columns[:len(docs.columns)] == docs.columns and stripped.first()["n_lines"] == "own n_lines"
    got = Counter((r.doc_id, r.text, r[counted], r[removed]) for r in stripped.collect())
    want = [(i, f"\nline {i}\n", 5, 2) for i in range(3)] + [(3, "", 1, 1), (None, "kept", 2, 1), (4, None, 0, 0), (5, "", 1, 0)]
    assert got == Counter(want + [(6, "", 2, 1)] * 2)
    assert lines.line_report(make([])).count() == 0


def test_shards_hold_the_mixture(make):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(50), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(3_000)]
    rows += [(5, "again", "a"), (5, "again", "a"), (None, None, None)]
    sources = {i: s for i, _, s in rows}
    for bucket in (100_000, 37):
        got = sharding.shard_documents(make(rows), bucket_rows=bucket).collect()
        sizes = Counter(r.shard for r in got)
        assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
        for shard, n in sizes.items():
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
        for source, total in Counter(s for _, _, s in rows).items():
            counts = Counter(r.shard for r in got if sources[r.doc_id] == source)
            assert all(abs(counts[k] - total / 24) <= 2 for k in range(24))
        texts = Counter((i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        assert texts == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
        assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_buckets_do_not_change_shards(make):
    rows = [(i, str(i), "ab"[i % 3 == 0]) for i in range(700)]
    one, many = (sorted(tuple(r) for r in sharding.shard_documents(make(rows), bucket_rows=b).collect()) for b in (10**6, 11))
    assert [r[:-1] for r in one] == [r[:-1] for r in many]


def test_few_and_no_rows_to_shard(make, odd):
    assert sharding.shard_documents(make([])).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shard_documents(make([(1, "a", "s"), (2, "b", "s")])).collect()) == [(0, 0), (12, 0)]
    assert sharding.shard_documents(odd).agg(F.countDistinct("shard", "slot")).first()[0] == 14


def test_texts_without_ids_are_told_apart(spark, make):
    """Two texts without an id under one tag; one repeats a document, the other repeats nothing."""
    texts = spark.range(250_000).select(F.concat_ws(" ", *[
        F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(16)]).alias("text"))
    tags = texts.select("text", substrings.text_tag("text").alias("tag"))
    pair = tags.groupBy("tag").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    rows = [(1, pair[0], "a"), (None, pair[0], "a"), (None, pair[1], "b"), (None, pair[1], "c")]
    got = sorted((tuple(r) for r in substrings.repeat_report(make(rows)).collect()), key=str)
    want = sorted(substrings.brute_force([r[:2] for r in rows]), key=str)
    assert got == want and sorted(r[2] for r in got) == [0, 0, 0, 16]
