"""Near copies against brute force, and through the pipeline's stage."""

import itertools
import random

import numpy as np

import corpus_pipeline
from tests.llm.conftest import ODD
from tidewatch.llm import lines, near_copies


def changed(words, share, rng):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def by_hand(texts):
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if group[i] != group[j] and near_copies.similar(texts[i].encode(), texts[j].encode()):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    return group


def test_groups_against_all_pairs(make):
    rng = random.Random(8)
    texts = []
    for i in range(40):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([3, 6, 12, 40, 200, 900]))]
        texts += [" ".join(base)] + [" ".join(changed(base, rng.choice([0, 0.005, 0.015, 0.022, 0.03, 0.1]), rng)) for _ in range(6)]
        texts.append(" ".join(base + base[:rng.randrange(len(base))]))
    # One group of many near copies: larger than any bucket that is compared pair by pair.
    base = [f"hot{i}" for i in range(120)]
    texts += [" ".join(changed(base, 0.01, rng)) for _ in range(150)]
    want = by_hand(texts)
    got = {r.id: r.root for r in near_copies.groups(make([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts) and len(set(zip(want, (got[i] for i in range(len(texts)))))) == len(set(want)) == len(set(got.values()))


def test_chains_of_copies_need_several_pivots(make, monkeypatch):
    """Steps of a walk are alike, its ends are not; with no pivots at all the groups are the same."""
    rng, texts = random.Random(15), []
    for walk in range(3):
        words = [f"walk{walk}x{i}" for i in range(90)]
        for step in range(25):
            at = rng.randrange(90)
            words = [*words[:at], f"step{walk}x{step}", *words[at + 1:]]
            texts.append(" ".join(words))
    want = by_hand(texts)
    docs = make([(i, t, "s") for i, t in enumerate(texts)])
    for pivots in (3, 0):
        monkeypatch.setattr(near_copies, "PIVOTS", pivots)
        got = {r.id: r.root for r in near_copies.groups(docs).collect()}
        assert len(set(zip(want, (got[i] for i in range(len(texts)))))) == len(set(want)) == len(set(got.values()))


def test_a_bucket_of_sets_with_words_of_their_own_makes_no_square(make, monkeypatch):
    """All sets share band keys and none are alike: the pairs compared grow with the sets."""
    core = " ".join(f"core{i}" for i in range(134))
    docs = make([(i, " ".join([core, *[f"own{i}x{k}" for k in range(20)]]), "s") for i in range(80)])
    plain, counts = near_copies.confirmed, []

    def counted(pairs, bodies):
        counts.append(pairs.count())
        return plain(pairs, bodies)

    monkeypatch.setattr(near_copies, "confirmed", counted)
    assert len({r.root for r in near_copies.groups(docs).collect()}) == 80
    assert sum(counts) < 80 * 79 // 4


def test_rare_shingles_lose_no_similar_pair(spark):
    rng, sets = random.Random(21), []
    for base in range(12):
        words = [base * 1_000 + i for i in range(rng.choice([4, 9, 40, 150]))]
        for _ in range(8):
            kept = [w for w in words if rng.random() > 0.08] + [rng.randrange(100_000, 100_400) for _ in range(rng.randrange(1 + len(words) // 12))]
            sets.append(sorted({*kept, 7}))
    nodes = spark.createDataFrame([(i, len(s), i, 1, True) for i, s in enumerate(sets)],
                                  "node long, n long, root long, size long, apart boolean")
    bodies = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>")
    got = {(min(r.node, r.pivot), max(r.node, r.pivot)) for r in near_copies.rare_pairs(nodes, bodies).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
            if 9 * len({*sets[i]} & {*sets[j]}) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(want) > 50 and want <= got and len(got) < len(sets) * (len(sets) - 1) // 4


def test_fingerprints_link_without_band_keys(make, monkeypatch):
    """The SimHash step by itself: sets within 2 bits and alike are linked, others not."""
    monkeypatch.setattr(near_copies, "band_keys", lambda sets: [[] for _ in sets])
    words = [f"long{i}" for i in range(3_000)]
    texts = [" ".join([*words[:at], f"other{at}", *words[at + 1:]]) for at in range(0, 3_000, 250)]
    texts += [" ".join(f"far{i}x{k}" for k in range(40)) for i in range(4)]
    bits = [near_copies.majority([near_copies.shingle_set(t.encode())]) for t in texts]
    want = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if ((bits[i] ^ bits[j]) & ((1 << 64) - 1)).bit_count() <= 2 and near_copies.similar(texts[i].encode(), texts[j].encode()):
            want = [want[i] if g == want[j] else g for g in want]
    got = {r.id: r.root for r in near_copies.groups(make([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(set(want)) < len(texts) - 3
    assert len(set(zip(want, (got[i] for i in range(len(texts)))))) == len(set(want)) == len(set(got.values()))


def test_similar_sizes_are_in_neighbouring_steps(spark):
    rows = spark.range(1, 3_000).selectExpr("id AS a", "id * 5 div 4 AS b").select(
        near_copies.size_step("a").alias("a"), near_copies.size_step("b").alias("b"))
    assert rows.where("b - a NOT IN (0, 1)").isEmpty()


def test_chance_to_share_a_key():
    """Pairs at a similarity of 0.8 to 0.82 share a band key, as many as were made."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(400):
        own = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        sets += [np.unique(own[:100]), np.unique(own[10:])[:99]]
    keys = near_copies.band_keys(sets)
    near = [(a, b) for a, b in zip(range(0, 800, 2), range(1, 800, 2))
            if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert len(near) == 400 and all(set(keys[a]) & set(keys[b]) for a, b in near)


def test_long_sets_have_the_minima_of_their_parts():
    rng = np.random.default_rng(4)
    long = np.unique(rng.integers(0, 1 << 63, 3 * near_copies.CHUNK, dtype=np.uint64))
    plus, times = near_copies.factors()
    got = near_copies.minima([long[:7], long, long[5:60]])
    for k in (0, 50, len(plus) - 1):
        assert got[:, k].tolist() == [((s ^ plus[k]) * times[k]).min() for s in (long[:7], long, long[5:60])]


def test_near_copies_go_from_the_pipeline(spark, make):
    words = [f"quite{i}" for i in range(300)]
    rows = [(900_001, " ".join(words), "src0"), (900_002, " ".join(words), "src1"), (900_003, " ".join([*words, words[7]]), "src2"),
            (900_004, " ".join([*words[:150], "but", *words[150:]]), "src3"), (900_005, " ".join(words[:200]), "src4"),
            (None, "no number and one thing to say in it", "a"), (None, "another thing that was never numbered by anyone", "b")]
    kept = [r.doc_id for r in corpus_pipeline.simhash_stage(spark, make(rows), "").collect()]
    assert sorted(i for i in kept if i) == [900_001, 900_005] and kept.count(None) == 2


def test_a_text_copied_to_many_sites_stays_whole_once(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = "\n".join(" ".join(f"copied{i}x{k}" for k in range(20)) for i in range(8))
    rows = [(920_000 + i, text, f"site{i}") for i in range(12)]
    rows += [(930_000 + i, "standing on every page\n" + " ".join(f"own{i}x{k}" for k in range(30)), f"site{i}") for i in range(12)]
    more = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path)).cache()
    left = {r.doc_id: r.text for r in table.where("doc_id >= 920000").collect()}
    assert left[920_000] == text and len(left) == 13
    assert all(left[930_000 + i].startswith(f"own{i}x0") for i in range(12))


def test_texts_near_and_far_from_the_threshold(make):
    """Lines on many sites, in a number of distinct texts on both sides of the threshold."""
    rows = [(n * 1_000 + i, f"line {n}\nown {n} {i % n}", f"site{i}") for n in (1, 9, 10, 11, 30) for i in range(60)]
    rows += [(90_000 + i, f"few sites\nown {i}", f"site{i % 9}") for i in range(60)]
    left = {r.doc_id: r.text for r in lines.strip_boilerplate(make(rows), least=10, least_texts=10)[0].collect()}
    assert all(left[i] == (t if i < 10_000 or i >= 90_000 else t.split("\n")[1]) for i, t, _ in rows)


def test_one_of_each_group_of_odd_documents(make):
    docs = make(ODD, clash=True)
    kept = near_copies.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 9, 10] and ids.count(None) == 1
    assert near_copies.keep_one(make([])).count() == 0
