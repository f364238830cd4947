"""Benchmark search, license wording and BPE against plain versions."""

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, decontaminate, licenses
from tidewatch.llm.queries import VOCABULARY

words = st.lists(st.sampled_from("a b c d".split()), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(1, 5))
def test_search_finds_every_window(text, items, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    tables = decontaminate.searches([(i, t.encode()) for i, t in named], window)
    split = decontaminate.alnum_words(text.encode())
    spans, names = [], set()
    for search in tables:
        for at, found in search.occurrences(split):
            spans.append((at, at + search.length))
            names |= found
    covered = sum(b - a for a, b in decontaminate.merged(spans))
    assert [(len(split), covered, sorted(names))] == decontaminate.brute_force([text], named, window)


def test_blocks_of_items_give_the_same_rows(spark, make, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    columns = ["doc_id", "found.n_words", "found.spans", "found.items"]
    one, _ = decontaminate.find_items(docs, items)
    many, _ = decontaminate.find_items(docs, items, block_bytes=2_000)
    assert sorted(map(str, one.select(*columns).collect())) == sorted(map(str, many.select(*columns).collect()))


def test_short_items_and_odd_documents(spark, odd):
    items = spark.createDataFrame([(1, "One"), (2, ""), (3, None), (None, "no id"), (4, "!!"), (5, "same text")],
                                  "item_id bigint, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.contamination_report(odd, items).collect()}
    assert rows[(4, 1)].contaminated and rows[(4, 1)].items_sha256 == decontaminate.digest(["1"])
    assert rows[(None, 3)].n_items == 1 and rows[(None, 3)].items_sha256 == decontaminate.digest([""])
    assert not rows[(1, 0)].contaminated and rows[(5, 5)].n_hit == 2
    assert rows[(7, 150_000)].n_hit == 0


def test_decontamination_keeps_columns(spark, make):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = make([(1, passage, "a"), (2, "clean text", "a"), (3, passage + " pad" * 13 * 19, "a"),
                 (4, passage + " pad" * (13 * 19 + 1), "a")], clash=True)
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_no_items_and_no_documents(spark, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in decontaminate.contamination_report(make([(1, "a b", "s")]), none).collect()] == [0]
    assert decontaminate.contamination_report(make([]), none).count() == 0


@pytest.mark.parametrize("template, text, length", [
    ("alpha beta", "alpha beta gamma", 2), ("alpha beta", "alpha gamma", None),
    ("alpha <<optional>> beta <</optional>> gamma", "alpha gamma", 2),
    ("alpha <<optional>> beta <</optional>> gamma", "alpha beta gamma", 3),
    ("alpha <<var:2>> gamma", "alpha x gamma", 3), ("alpha <<var:2>> gamma", "alpha x y gamma", 4),
    ("alpha <<var:2>> gamma", "alpha gamma", None), ("alpha <<var:0-2>> gamma", "alpha gamma", 2),
    ("alpha <<optional>> b <<optional>> c <</optional>> <</optional>> d", "alpha b d", 3),
    ("alpha <<optional>> b <<optional>> c <</optional>> <</optional>> d", "alpha c d", None),
    ("alpha <<var:3>>", "alpha x y z w", 4)])
def test_template_regions(template, text, length):
    assert licenses.Automaton(template).run([w.encode() for w in text.split()], 0) == length


def test_template_markup_is_checked():
    for bad in ("<<optional>> a <</optional>>", "a <<optional>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("cc by mit license apache gnu general public x - é".split()), max_size=30))
def test_base_phrases(parts):
    text = " ".join(parts)
    found = licenses.Scanner(licenses.BASE, licenses.TEMPLATES).scan(text.encode())
    split = text.replace("-", " ").split()
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(split))
              if split[i:i + phrase.count(" ") + 1] == phrase.split()]
    assert found["n_words"] == len(split) and found["n_base"] == len(places)
    assert found["base_labels"] == sorted({p[1] for p in places}) and set(found["base_labels"]) <= set(found["labels"])
    assert found["first_word"] == min((p[0] for p in places), default=None)
    assert found["last_word"] == max((p[0] for p in places), default=None)
    assert 0 <= found["score"] <= 1


def test_notices():
    scan = licenses.Scanner(licenses.BASE, licenses.TEMPLATES).scan
    assert scan(b"Licensed under CC BY-NC 4.0.")["labels"] == ["cc-by", "cc-by-nc"]
    assert {"gpl", "gpl-3.0", "gpl-notice"} <= set(
        scan(b"This work is licensed under the GNU General Public License, version 3.")["labels"])
    assert {"apache", "apache-2.0", "apache-notice"} <= set(scan(b"Licensed under the Apache License, Version 2.0.")["labels"])
    assert scan(b"Released under the MIT License.")["score"] == 1.0
    assert scan(None)["labels"] == [] and scan(b"")["score"] == 0.0


def test_license_report_on_odd_documents(odd, make):
    rows = licenses.license_report(odd).collect()
    assert len(rows) == 14 and all(r.labels == "" and r.first_word is None for r in rows)
    assert licenses.license_report(make([])).count() == 0


@pytest.fixture(scope="module")
def library():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file")
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file")
    return bpe.packed_encoder(bpe.Vocabulary(VOCABULARY))


PARTS = ["a", "aa", "ab", "the", " ", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "<|endo", "1", "22", "'s", "'S", "!!", "ՙ", "中",
         "😀", "\x00", "\x1c", "\x85", "ing", "tion", "�", "ab" * 50]


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_ids_equal_the_library(library, encoder, text):
    assert bpe.np.frombuffer(encoder(text), bpe.np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_equals_the_library(library, encoder, text):
    assert bpe.np.frombuffer(encoder(text), bpe.np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_documents(spark, odd, make, library, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    for table in (docs, odd):
        texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()): r.text or "" for r in table.collect()}
        got = bpe.round_trip(table, VOCABULARY).collect()
        assert len(got) == table.count()
        for r in got:
            ids = library.encode(texts[(r.doc_id, r.decoded_sha256)], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(make([]), VOCABULARY).count() == 0


def test_encode_keeps_other_columns(make, library):
    docs = make([(1, "some text", "a"), (2, None, "b")], clash=True)
    rows = {r.doc_id: r for r in bpe.encode(docs, VOCABULARY).collect()}
    assert rows[1].ids == library.encode("some text").ids and rows[2].ids == [] and rows[1].encoded == "own encoded"
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()}
    assert back == {1: "some text", 2: ""}


def test_round_trip_is_one_python_step(make, odd):
    """A second step in a row would be a second worker for each task, with its own memory."""
    for keep_ids in (False, True):
        plan = bpe.round_trip(odd, VOCABULARY, keep_ids)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    docs = make([(1, "One two \u4e2d", "a"), (2, None, "b"), (3, "", "c")]).selectExpr("*", "'mine' AS ids", "'own' AS decoded")
    both = bpe.encode(docs, VOCABULARY, decoded="decoded")
    apart = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY, ids="_ids")
    assert both.columns == apart.columns and sorted(both.collect()) == sorted(apart.collect())
    assert {(r.ids, r.decoded, r._decoded) for r in both.collect()} == {("mine", "own", "One two \u4e2d"), ("mine", "own", "")}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x557), max_size=60))
def test_settled_pattern_cuts_alike(text):
    import regex
    assert bpe.settled_pattern().findall(text) == regex.findall(bpe.PIECE, text)


def test_own_columns_with_the_names_of_results(spark, make):
    docs = make([(1, "One two", "a")]).selectExpr("*", "'mine' AS ids", "'own' AS decoded")
    row = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY, ids="_ids").first()
    assert (row.ids, row.decoded, row._decoded) == ("mine", "own", "One two")


def test_pieces_come_back_from_the_older_generation(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    pieces = bpe.Pieces(bpe.Encoder(bpe.Vocabulary(VOCABULARY)))
    names = [" a", " b", " c", " dd", " a", " ee", " b", " ff", " a"]
    first = {n: bpe.Encoder(bpe.Vocabulary(VOCABULARY)).piece(n.encode()).tobytes() for n in set(names)}
    assert [pieces[n] for n in names] == [first[n] for n in names] and len(pieces) <= 3 and len(pieces.older) <= 3
