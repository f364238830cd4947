"""Language labels, toxicity and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD
from tidewatch.llm import language, toxicity


def by_enumeration(scores, transitions):
    n, k = scores.shape
    total, mass, moves = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(sum(scores[i, p] for i, p in enumerate(path))
                        + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for i, p in enumerate(path):
            mass[i, p] += weight
        for a, b in zip(path, path[1:]):
            moves[a, b] += weight
    return mass / total, moves / total, np.log(total)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.integers(0, 1000))
def test_forward_backward_against_all_paths(lengths, seed):
    rng = np.random.default_rng(seed)
    transitions, scores = rng.normal(size=(3, 3)), rng.normal(size=(sum(lengths), 3))
    gamma, moves, log_sum = language.forward_backward(scores, np.array(lengths), transitions, edges=True)
    want_moves, want_sum, at = np.zeros((3, 3)), 0.0, 0
    for n in lengths:
        g, m, z = by_enumeration(scores[at:at + n], transitions)
        assert np.allclose(gamma[at:at + n], g)
        want_moves, want_sum, at = want_moves + m, want_sum + z, at + n
    assert np.allclose(moves, want_moves) and np.isclose(log_sum, want_sum)


SYLLABLES = {"xx": "ka lo mi te".split(), "yy": "sch ung ver ein".split()}


def made_text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 3))) for _ in range(n))


def test_code_switched_text_gets_spans():
    rng = random.Random(1)
    model = language.fit([(made_text(k, 60, rng).encode(), k) for k in SYLLABLES for _ in range(30)])
    text = made_text("xx", 30, rng) + " " + made_text("yy", 20, rng)
    lang, score, spans = language.Labeller(model).label([text.encode()])[0]
    assert lang == "xx" and 0.5 < score < 0.7
    assert [s["lang"] for s in spans] == ["xx", "yy"] and abs(spans[0]["end"] - 30) <= 1 and spans[1]["end"] == 50
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_held_out_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert found.where("score < 0 OR score > 1").count() == 0 and found.count() == docs.count()


def test_languages_of_odd_documents(odd, make):
    rows = language.language_report(odd).collect()
    und = [r.doc_id for r in rows if r.lang_pred == "und"]
    assert len(rows) == len(ODD) and sorted(i for i in und if i) == [1, 2, 3] and und.count(None) == 1
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.language_report(make([])).count() == 0
    unlabelled = make([(1, "word", "s"), (2, "123", "s")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_report(unlabelled).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), max_size=5), st.lists(st.text("abc", min_size=4, max_size=4), max_size=1),
       st.text("abcd", max_size=10))
def test_matcher_against_edit_distance(words, stems, word):
    got = toxicity.Matcher(words, stems, set()).match(word)
    if word in words or any(word.startswith(s) for s in stems):
        assert got == 1
    else:
        assert got == (2 if any(distance(word, w) <= toxicity.edits(w) for w in words) else 0)


def test_exceptions_are_no_misspellings():
    assert toxicity.Matcher(["loser"], [], set()).match("loses") == 2
    assert toxicity.Matcher(["loser"], [], {"loses"}).match("loses") == 0


def labelled(make, spark, n=400):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in "ba no ri tu le".split() for b in "dan mok pel sir".split()]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0 or i % 7 == 0
        if bad:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "wicht", "lumpen" + rng.choice(plain)]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    return make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), plain


def test_toxicity_of_held_out_misspelled_and_quoted_text(make, spark):
    docs, labels, plain = labelled(make, spark)
    rows = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.predicted == r.toxic for r in rows) and len(rows) > 50
    model = toxicity.train(docs, labels)
    text = " ".join(plain)
    more = make([(1, text, "s"), (2, text + " you are a gorbian and a grobain", "s"), (3, text + " du grobiian", "s"),
                 (4, f'{text} someone said "grobian" there', "s"), (5, text + " wicht " + text, "s"), (6, None, "s"), (7, "", "s")])
    scored, name = toxicity.score(more, model)
    got = {r.doc_id: r[name]["score"] for r in scored.collect()}
    assert got[3] >= 0.5 and got[5] >= 0.5
    assert all(got[i] < 0.5 for i in (1, 4, 6, 7))


def test_toxicity_without_labels_and_documents(make, spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity_report(odd, none).collect()
    assert len(rows) == len(ODD) and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    docs, labels, _ = labelled(make, spark, 100)
    assert toxicity.toxicity_report(make([]), labels).count() == 0
    nulls = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0)], labels.schema))
    kept = toxicity.drop_toxic(docs, nulls)
    assert kept.columns == docs.columns and 0 < kept.count() < 100


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, table = docs.columns, None, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder).cache()
        assert out.columns == columns, name
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and (ids is None or set(kept) <= ids) and len(kept) > 0.5 * docs.count()
        ids, table = set(kept), out
    rows = corpus_pipeline.STAGES[-1][1](spark, table, folder).collect()
    assert {r.doc_id for r in rows} == ids and all(len(r.ids) == r.n_tokens for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids


def test_pipeline_takes_out_planted_cases(spark, folder, tmp_path):
    """Copies, near copies, benchmark text, toxic text and boilerplate, among untouched documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = docs.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic = 1 AND text LIKE '%idiot%'")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    words = [f"quite{i}" for i in range(300)]
    own = " ".join(words)
    rows = [(900_001, own, "src0"), (900_002, own, "src1"), (900_003, own + " " + words[7], "src2"),
            (900_004, "some words around " + item, "src3"), (900_005, toxic.first()["text"], "src4")]
    rows += [(910_000 + i, f"read more on this site\nand unlike {' '.join(f'u{i}x{k}' for k in range(40))}", f"site{i}") for i in range(12)]
    more = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path)).cache()
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in table.where("doc_id >= 910000").collect()}
            assert len(texts) == 12 and all(t.startswith("and unlike") for t in texts.values())
    left = {r.doc_id for r in table.where("doc_id >= 900000").collect()}
    assert 900_001 in left and not left & {900_002, 900_004, 900_005} and len(left & set(range(910_000, 910_012))) == 12


@pytest.mark.parametrize("name", ["op1_simhash", "op2_language", "op3_license_scan", "op8_toxicity", "pipeline"])
def test_queries_without_a_statement_return_every_document(spark, folder, name):
    from tidewatch.llm.queries import QUERIES
    query = (QUERIES | corpus_pipeline.QUERIES)[name]
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    got = query(spark, folder).count()
    assert got == n if name != "pipeline" else 0 < got < n
