"""Resampling documents towards a target distribution by importance weights.

A text's features are its runs of words, hashed into buckets. A bucket's gain is the scaled
logarithm of its share in the target over its share in the documents; a text's weight is the
floored mean of its features' gains, looked up in an array. Gumbel noise made of the row's id
turns "the highest scores" into a draw in proportion to the weights.

The cutoff is found without sorting the scores. A quantile sketch gives a bracket around it;
exact counts above and inside tell whether the cutoff is in there, and the bracket is widened
until it is. Only the bracket's rows are sorted. Rows that are drawn are numbered over slices
of bounded size, so ties and repeated ids do not meet in one task.

A null text has no features and weight 0; without any feature on one side the gains follow from
the counts of the other. A null id takes noise of its own, the same for all of them, and comes
after the others in a tie. Repeated rows are drawn one by one, in an order fixed when they are
written. Own columns stay; results take a name that the table does not have.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.ordered import SLICE, cut, running
from tidewatch.llm.texts import add_result, alnum_words, as_bytes, bound_batches, fresh
from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

BUCKETS, RUN, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
# The sketch errs by one row in this many; the first bracket reaches this many such errors
# to either side, and twice as far each time it is widened.
ACCURACY, REACH = 10_000, 2
UNIT, TWO32 = 1000, 4294967296.0


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` words, repeats included."""
    runs = [np.fromiter(map(crc32, words), np.int64, len(words))]
    for n in range(2, longest + 1):
        grams = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
        runs.append(np.fromiter(map(crc32, grams), np.int64, len(grams)))
    return np.concatenate(runs) % buckets


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts. A task sends one row per bucket it has met."""
    bound_batches(texts)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for content in as_bytes(batch.column(0)):
                if content:
                    total += np.bincount(feature_buckets(alnum_words(content), longest, buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    parts = texts.select(text).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket; both shares are smoothed by one feature per bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratios = [float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))
              for a, b in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(UNIT * math.log(r)) for r in ratios], np.int64)


def scorer(gains: np.ndarray, longest: int) -> Callable[[list[bytes | None]], list[pa.Array]]:
    """A function from texts to their words, features and weights: one look-up for all of them."""
    def score(texts):
        words = [alnum_words(t) if t else [] for t in texts]
        spots = [feature_buckets(w, longest, len(gains)) for w in words]
        sizes = np.array([len(s) for s in spots], np.int64)
        upto = np.append(0, np.cumsum(gains[np.concatenate(spots)] if spots else gains[:0]))
        ends = np.cumsum(sizes)
        sums = upto[ends] - upto[ends - sizes]
        weights = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
        return [pa.array([len(w) for w in words], pa.int64()), pa.array(sizes), pa.array(weights)]
    return score


def noise(key: str, seed: int) -> F.Column:
    """Scaled Gumbel noise of an id, the same wherever the row is."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(TWO32)))).cast("bigint")


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
          longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> tuple[DataFrame, str]:
    """Append a struct of n_words, n_features, weight and score; the table and the struct's name."""
    source = bucket_counts(docs, text, longest, buckets)
    gains = bucket_gains(source, bucket_counts(target, target_text, longest, buckets))
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])
    raw, name = fresh(docs, "weighed"), fresh(docs, "importance")
    weighed = add_result(docs, text, kind, raw, lambda: scorer(gains, longest))
    parts = [F.col(raw)[n].alias(n) for n in kind.names]
    score = (F.col(raw)["weight"] + noise(key, seed)).alias("score")
    return weighed.withColumn(name, F.struct(*parts, score)).drop(raw), name


def bracket(scores: DataFrame, n: int, k: int, accuracy: int = ACCURACY, reach: int = REACH):
    """(low, high, rows above high): scores low to high hold the k-th highest of n; None is no bound."""
    below, above = reach / accuracy, reach / accuracy
    while True:
        fractions = 1 - k / n - below, 1 - k / n + above
        inside = [f for f in fractions if 0 < f < 1]
        found = iter(scores.agg(F.percentile_approx("score", inside, accuracy)).first()[0] if inside else [])
        low, high = (next(found) if 0 < f < 1 else None for f in fractions)
        over = F.lit(False) if high is None else F.col("score") > high
        within = ~over if low is None else ~over & (F.col("score") >= low)
        counts = scores.agg(F.count_if(over).alias("over"), F.count_if(within).alias("within")).first()
        if counts["over"] >= k:
            above *= 2
        elif counts["over"] + counts["within"] < k:
            below *= 2
        else:
            return low, high, counts["over"]


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 1 in order, over slices of bounded size."""
    return running(cut(rows, [], order), [], order, sums={name: F.lit(1).cast("bigint")}).drop(SLICE)


def draw(weighed: DataFrame, name: str, key: str = "doc_id", percent: int = PERCENT,
         least_words: int = LEAST_WORDS, accuracy: int = ACCURACY, reach: int = REACH) -> tuple[DataFrame, str]:
    """Append the rank of each row that is drawn, else null; the table and the rank's name.

    Of the rows with enough words, ``percent`` in a hundred with the highest scores are drawn.
    The table is written once with the columns it has; leave out those that are not needed."""
    rank, marks = fresh(weighed, "rank"), {n: fresh(weighed, n) for n in ("falling", "unnamed", "row")}
    score = F.col(name)["score"]
    table = checkpointed(weighed.withColumns({
        marks["falling"]: -score, marks["unnamed"]: F.col(key).isNull(), marks["row"]: F.monotonically_increasing_id()}))
    order = [marks["falling"], marks["unnamed"], key, marks["row"]]
    fit = F.col(name)["n_words"] >= least_words
    scores = table.where(fit).select((-F.col(marks["falling"])).alias("score"), *order)
    n = scores.count()
    k = percent * n // 100
    if k == 0:
        return table.withColumn(rank, F.lit(None).cast("bigint")).drop(*marks.values()), rank
    low, high, over = bracket(scores.select("score"), n, k, accuracy, reach)
    within = scores
    if low is not None:
        within = within.where(F.col("score") >= low)
    if high is not None:
        within = within.where(F.col("score") <= high)
    nth = fresh(within, "nth")
    last = numbered(within.select(*order), order, nth).where(F.col(nth) == k - over).first()
    edge = F.struct(*[F.lit(last[c]).cast(table.schema[c].dataType).alias(c) for c in order])
    taken = fit & (F.struct(*order) <= edge)
    chosen = numbered(table.where(taken), order, rank)
    others = table.where(~F.coalesce(taken, F.lit(False))).withColumn(rank, F.lit(None).cast("bigint"))
    return chosen.unionByName(others).drop(*marks.values()), rank


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, **settings) -> DataFrame:
    """The documents that are drawn, with their own columns."""
    weighed, name = weigh(docs, target, key, text, **settings)
    drawn, rank = draw(weighed, name, key, percent, least_words)
    return drawn.where(F.col(rank).isNotNull()).select(*docs.columns)


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """A row per document: features, weight, score, and rank in the draw."""
    weighed, name = weigh(docs.select("doc_id", "text"), target)
    drawn, rank = draw(weighed.drop("text"), name)
    return drawn.select("doc_id", *[F.col(name)[c].alias(c) for c in ("n_features", "weight", "score")],
                        F.col(rank).alias("rank"))
