"""Token counts against the tokenizer library."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import token_counts
from tidewatch.llm.queries import QUERIES, WORDS

LIBRARY = Tokenizer.from_file(WORDS)
VOCABULARY = token_counts.WordVocabulary(WORDS)
COUNTER = token_counts.Counter(VOCABULARY)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


signs = st.one_of(
    st.characters(codec="utf-8"), st.sampled_from("aAbeht'sİΣςσé́̀ͅι ı½²_\x85\x1c  "),
    st.sampled_from(["'re", "<|startoftext|>", "<|endoftext|>", "<|endoftext", "中文", "الع", "ผู้", "👩‍👧", "!!!", "2024"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(signs, max_size=60).map("".join))
def test_counts_equal_the_library(text):
    assert COUNTER.count([text]).tolist() == [expected(text)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abn !", min_size=1, max_size=400))
def test_long_words_merge_alike(text):
    merger, raw = token_counts.Merger(VOCABULARY), text.encode()
    assert merger.count_long(raw) == merger.count_short([raw])[0]


@pytest.mark.parametrize("text", [
    "x" * 30_000, "ab" * 20_000, "中文字漢日本語" * 6_000, "a" * 512 + "b", "!" * 4_000 + "a" * 700,
    "".join(random.Random(5).choices("etaoinshrdlu", k=40_000))])
def test_very_long_words(text):
    assert COUNTER.count([text, text[:600]]).tolist() == [expected(text), expected(text[:600])]


def test_stretches_and_generations_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeé中", k=rng.randint(1, 9))) for _ in range(200)) for _ in range(30)]
    whole = token_counts.Counter(VOCABULARY).count(texts).tolist()
    for name, value in (("STRETCH", 50), ("WORDS", 7), ("KEPT_WORDS", 20), ("KEPT_WORD", 3)):
        monkeypatch.setattr(token_counts, name, value)
    counter = token_counts.Counter(VOCABULARY)
    assert counter.count(texts).tolist() == whole == [expected(t) for t in texts]
    assert len(counter.new) <= 30 and all(len(w) <= 3 for w in counter.new)


def test_odd_documents(spark, odd):
    rows = token_counts.count_report(odd, WORDS).collect()
    texts = [r.text for r in odd.collect()]
    assert sorted(((r.n_bytes, r.n_tokens, r.over_limit) for r in rows)) == sorted(
        (len((t or "").encode()), expected(t), expected(t) > 2048) for t in texts)


def test_own_columns_stay(spark, make):
    docs = make([(1, "One two", "a"), (2, None, "a")], clash=True).selectExpr("*", "'mine' AS n_tokens", "'own' AS counted")
    rows = token_counts.count_tokens(docs, WORDS).collect()
    assert {(r.n_tokens, r.counted, r._n_tokens) for r in rows} == {("mine", "own", 2), ("mine", "own", 0)}


def test_no_documents(spark, make):
    assert token_counts.count_report(make([]), WORDS).collect() == []


def test_merges_of_later_symbols_are_refused(tmp_path):
    import json
    content = json.loads(VOCABULARY.content)
    content["model"]["merges"].reverse()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    with pytest.raises(ValueError):
        token_counts.WordVocabulary(str(path))


def test_query_equals_the_library(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_token_counts"](spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: expected(t) for i, t in texts.items()} and len(rows) == len(texts)
