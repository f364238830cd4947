"""Importance resampling against a plain version."""

import hashlib
import math
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import resampling


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(docs, target, longest=1, percent=10, least=20, buckets=10_000):
    """(id, features, weight, score, rank) per row; rows that tie in id and score share any order."""
    def spots(text):
        w = words_of(text)
        return [crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = {}, {}
    for texts, counts in ((docs, s), (target, t)):
        for row in texts:
            for b in spots(row[1]):
                counts[b] = counts.get(b, 0) + 1
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        gains = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (ss + buckets) / ((s.get(b, 0) + 1) * (tt + buckets))))
                 for b in spots(text)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = [i for i, d in enumerate(docs) if len(words_of(d[1])) >= least]
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, i))
    for rank, i in enumerate(fit[:percent * len(fit) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(spark, docs, target, longest=1, percent=10, least=20, accuracy=resampling.ACCURACY, reach=resampling.REACH):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for _, t in target], "text string")
    weighed, name = resampling.weigh(table, aim, longest=longest)
    drawn, rank = resampling.draw(weighed.drop("text"), name, percent=percent, least_words=least, accuracy=accuracy, reach=reach)
    rows = drawn.select("doc_id", f"{name}.n_features", f"{name}.weight", f"{name}.score", rank).collect()
    return sorted(map(tuple, rows), key=repr)


def some_docs(n):
    return [(i, " ".join(f"W{(i * j * 7919 + j) % (5 + i % 40)}" for j in range(i % 45))) for i in range(n)]


ODD = [(None, None), (None, "a " * 30), (None, "a " * 30), (900, ""), (901, "é ß 中文 " * 10), (902, "same " * 50), (902, "same " * 50),
       (903, "-- !!"), (904, "lorem ipsum " * 40_000)]
TARGET = [(0, "w1 w2 w3 w1 same"), (1, None), (2, "")]


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_draw_equals_a_sort_of_everything(spark, longest, percent):
    docs = some_docs(300) + ODD
    assert rows_of(spark, docs, TARGET, longest, percent) == brute_force(docs, TARGET, longest, percent)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    """A sketch that errs by half of all rows, and a bracket without any width."""
    docs = some_docs(200)
    assert rows_of(spark, docs, TARGET, percent=35, least=1, accuracy=2, reach=0.01) == brute_force(docs, TARGET, percent=35, least=1)


def test_all_rows_alike(spark):
    """One id and one text in all rows: ranks are distinct all the same."""
    docs = [(7, "w1 " * 25)] * 100
    ranks = sorted(r[4] for r in rows_of(spark, docs, TARGET, percent=30) if r[4])
    assert ranks == list(range(1, 31))


def test_bracket_counts_are_exact(spark):
    scores = spark.range(10_000).select((F.col("id") % 500).alias("score"))
    low, high, over = resampling.bracket(scores, 10_000, 1_000)
    values = sorted((i % 500 for i in range(10_000)), reverse=True)
    assert over == sum(v > high for v in values) < 1_000
    assert low <= values[999] <= high


@pytest.mark.parametrize("docs, target", [([], TARGET), (some_docs(60), []), ([], []), ([(1, None)], [(1, None)])])
def test_empty_sides(spark, docs, target):
    assert rows_of(spark, docs, target, percent=50, least=0) == brute_force(docs, target, percent=50, least=0)


def test_drawn_documents_keep_their_columns(spark, make):
    docs = make([(i, f"w{i % 3} " * (20 + i), "a") for i in range(40)], clash=True)
    docs = docs.withColumns({c: F.lit(c) for c in ("importance", "weighed", "falling", "unnamed", "row", "nth", "weight")})
    aim = spark.createDataFrame([("w1 w1 w1",)], "text string")
    kept = resampling.resample(docs, aim, percent=25)
    assert kept.columns == docs.columns and kept.count() == 10
    assert {r.importance for r in kept.collect()} == {"importance"}
