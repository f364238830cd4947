"""Looking up patterns by the texts they need."""

import random
import re

import pytest

from tidewatch.functions import patterns
from tidewatch.operators.requests import first_pattern


@pytest.mark.parametrize("pattern, texts", [
    ("abcd", ["abcd"]), ("^abc$", ["abc"]), ("ab+cde", ["cde"]), ("abx(cd)+ef", ["abxcd"]), ("abc|def", []), ("(abc)?d", []),
    ("a.bcd[xy]efg", ["bcd", "efg"]), ("(?i)abcd", []), ("[", []), (r"abc\.def", ["abc.def"]), ("abc(?=def)xyz", ["abc", "xyz"]),
    ("(?:abc|x)def", ["def"]), ("ab{2,3}cde", ["cde"]), (r"\Qabc\E", []), ("ab", [])])
def test_texts_that_a_match_holds(pattern, texts):
    assert patterns.needed_texts(pattern) == texts


def test_first_pattern_of_many(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    rules = [rng.choice([word(4), f"^{word(3)}", f"{word(3)}.{word(3)}", f"{word(2)}$", f"({word(3)}|{word(4)})c", f"{word(3)}+b", ""])
             for _ in range(300)]
    texts = [word(rng.randrange(0, 14)) for _ in range(200)] + ["", "zz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, texts[0])], "id int, text string")
    got = {r.id: r.found for r in patterns.with_first_pattern(rows, "text", rules, "found", first_pattern).collect()}
    for i, t in enumerate(texts):
        assert got[i] == next((n for n, p in enumerate(rules) if (re.search(p, t) if p else t == "")), -1)
    assert got[-1] == -1 and got[-2] == got[0]
