"""Languages of text without spaces."""

import random

from pyspark.sql import functions as F

from tests.llm.test_models import SYLLABLES, made_text
from tidewatch.llm import language


def test_a_run_without_spaces_is_labelled_by_all_of_it():
    rng = random.Random(2)
    model = language.fit([(made_text(k, 60, rng).encode(), k) for k in SYLLABLES for _ in range(30)])
    run = (made_text("xx", 30, rng) + made_text("yy", 90, rng)).replace(" ", "")
    lang, score, spans = language.Labeller(model).label([run.encode()])[0]
    assert lang == "yy" and 0.5 < score < 1
    assert [s["lang"] for s in spans] == ["xx", "yy"]


def test_units_hold_every_feature_once():
    """The units of a run have the n-grams and affixes that the run has as one word."""
    rng = random.Random(3)
    for n in (65, 66, 80, 81, 129, 1_000):
        run = "".join(rng.choice("abcd\u4e2d\u6587") for _ in range(n))
        parts = language.words_of(run.encode())
        got = sorted(f for p in parts for f in language.feature_ids(p, set()))
        kind = language.zlib.crc32(b"#a") & ((1 << language.BITS) - 1)
        assert len(parts) > 1 and "".join(p.decode().removeprefix("-").partition("-")[0] for p in parts) == run
        assert got == sorted(language.feature_ids(run.encode(), set()) + [kind] * (len(parts) - 1))
    assert language.words_of(b"a " + b"b" * 64) == [b"a", b"b" * 64]


def test_a_long_text_leaves_out_no_shorter_ones(spark, make):
    ids = spark.range(60).where(~language.held_out("id"))
    first = ids.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).first()[0]
    ids = [r.id for r in ids.collect()]
    docs = make([(i, "very long " * 200 if i == first else f"short {i}", "s") for i in ids])
    found = [t for t, _ in language.training_texts(docs, size=1_500)]
    assert sorted(found) == sorted(f"short {i}".encode() for i in ids if i != first)


def test_features_of_many_words_are_those_of_each():
    text = "the straße ñandú 中文字 x 123 ١٢ 😀😀 Ωmega " + "".join(chr(0x4E00 + i) for i in range(150)) + " y" * 3
    words = list(dict.fromkeys(language.words_of(text.encode())))
    assert any(b"-" in w for w in words) and any(len(w) > 3 for w in words)
    owner, ids = language.all_feature_ids(words, {words[0], words[3]})
    for i, word in enumerate(words):
        assert sorted(ids[owner == i].tolist()) == sorted(language.feature_ids(word, {words[0], words[3]}))
    assert [len(x) for x in language.all_feature_ids([], set())] == [0, 0]
