"""Toxicity by a learned lexicon, matched with spelling errors and judged in context.

Training reads a bounded sample of labelled rows. Words and word beginnings that mark
toxic documents form the lexicon. Its words are laid out as a trie; stepping through the
trie with a count of edits is the product of the trie with the Levenshtein automata of
all its words, whose states are made as texts ask for them. Short words must match
exactly, longer ones within one or two edits; words that clean documents use themselves
are no misspellings. Each match is looked at in its surroundings: inside quotation marks,
or close to a reporting verb, it counts as quoted. A logistic regression weighs plain,
misspelled and quoted matches.

A null or empty text has no matches. Without labelled rows of both kinds nothing is
learned and every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.texts import ALNUM, add_result, alnum_words, as_bytes, fresh
from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

# Bounds of what training holds at once: labelled rows in the sample, keys that are looked
# up in clean documents, lexicon entries, and clean words that look like misspellings.
SAMPLE_ROWS, CANDIDATES, LEXICON, EXCEPTIONS = 10_000, 20_000, 2_000, 50_000
STEMS = range(4, 9)
# A mark has to stand in so many toxic documents and surroundings, and in this share of the
# documents, so that copies of one document mark nothing.
LEAST_ROWS, LEAST_SHARE, LEAST_Z = 5, 0.01, 4.0
# And in so many times as many toxic as clean documents.
PURITY = 10
# A stem with more lexicon words than this stands for them.
FORMS = 4
CONTEXT = 6
KNOWN_WORDS = 150_000

REPORTING = set(b"said says say wrote writes called calls quoted quotes quote reported word term phrase "
                b"sagte sagt schrieb nannte wort dit dits disait mot dijo dice escribio palabra".split())
ADDRESSED = set(b"you your youre are du dein bist ihr tu te toi vous votre es eres usted".split())
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_QUOTED = re.compile('"[^"\n]{1,400}"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n]{1,400}»'.encode())


def edits(word: str) -> int:
    """Edits within which a lexicon word still matches."""
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


class Matcher:
    """Lexicon trie times Levenshtein automata, made deterministic step by step.

    A state is a set of (trie node, edits so far). ``match`` gives 1 for a lexicon word or
    a word that begins with a stem, 2 for a misspelled lexicon word, else 0.
    """

    def __init__(self, words: list[str], stems: list[str], exceptions: set[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_edits: list[int] = [-1]
        self.stem: list[bool] = [False]
        for word in words:
            self.word_edits[self._node(word)] = edits(word)
        for stem in stems:
            self.stem[self._node(stem)] = True
        self.most = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.most[node] = max([self.word_edits[node], 0, *[self.most[c] for c in self.children[node].values()]])
        self.exceptions = exceptions
        self.states = {self._close({(0, 0)}): 0}
        self.sets = [next(iter(self.states))]
        self.steps: list[dict[str, int]] = [{}]

    def _node(self, word: str) -> int:
        at = 0
        for sign in word:
            if sign not in self.children[at]:
                self.children[at][sign] = len(self.children)
                self.children.append({})
                self.word_edits.append(-1)
                self.stem.append(False)
            at = self.children[at][sign]
        return at

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the states reached by leaving out signs of a lexicon word."""
        least: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            node, used = todo.pop()
            if used > self.most[node] or least.get(node, 99) <= used:
                continue
            least[node] = used
            todo += [(child, used + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _step(self, state: int, sign: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, used in self.sets[state]:
            children = self.children[node]
            if sign in children:
                after.add((children[sign], used))
            if used < self.most[node]:
                after.add((node, used + 1))
                after |= {(child, used + 1) for child in children.values()}
        closed = self._close(after)
        if closed not in self.states:
            self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.steps.append({})
        to = self.steps[state][sign] = self.states[closed]
        return to

    def match(self, word: str) -> int:
        state, plain = 0, 0
        for sign in word:
            plain = self.children[plain].get(sign, -1) if plain >= 0 else -1
            if plain >= 0 and self.stem[plain]:
                return 1
            to = self.steps[state].get(sign)
            state = self._step(state, sign) if to is None else to
            if not self.sets[state]:
                return 0
        if plain >= 0 and self.word_edits[plain] >= 0:
            return 1
        if any(0 <= used <= self.word_edits[node] for node, used in self.sets[state]):
            return 0 if word in self.exceptions else 2
        return 0


class Codes(dict):
    """Word to its kind of match, worked out on first sight."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: bytes) -> int:
        # No lexicon word is this long; a stem decides within its own length.
        code = self.matcher.match(word.decode("utf-8", "replace"))
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    exceptions: set[str] = field(default_factory=set)
    weights: np.ndarray | None = None

    def matcher(self) -> Matcher:
        return Matcher(self.words, self.stems, self.exceptions)


FEATURES = 6


def context_features(text: bytes, codes: Codes) -> np.ndarray:
    """Features of one document that has matches."""
    spots = [(m.start(), m.end(), m.group().translate(ALNUM)) for m in _WORD.finditer(text)]
    quotes = [m.span() for m in _QUOTED.finditer(text)]
    plain = misspelled = quoted = addressed = 0
    for i, (start, end, word) in enumerate(spots):
        code = codes[word]
        if not code:
            continue
        near = {w for _, _, w in spots[max(0, i - CONTEXT):i + CONTEXT + 1]}
        if any(a < start and end < b for a, b in quotes) or near & REPORTING:
            quoted += 1
        elif code == 1:
            plain += 1
        else:
            misspelled += 1
        addressed += bool(near & ADDRESSED)
    return np.array([1.0, math.log1p(plain), math.log1p(misspelled), math.log1p(quoted), plain > 0,
                     math.log1p(addressed) if plain + misspelled else 0.0])


def features(text: bytes | None, codes: Codes) -> np.ndarray:
    if not text or not any(map(codes.__getitem__, text.translate(ALNUM).split())):
        return np.array([1.0, 0, 0, 0, 0, 0])
    return context_features(text, codes)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards weights that fit the meaning of
    the features: matches are bad, misspelled ones too, quoted ones are not."""
    prior = np.array([-2.0, 1.5, 1.5, 0.0, 1.5, 0.0])
    strength = np.array([0.01, 0.1, 1.0, 1.0, 0.1, 1.0])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the rows that no label is learned from. A null id has no label anyway."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Text and label of about ``rows`` documents at most, chosen by a hash of the id.

    The labels are thinned out first; what is broadcast are the ids of the sample."""
    own = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
           .groupBy("doc_id").agg(F.max("toxic").alias("y")))
    own = checkpointed(own.select("doc_id", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).alias("u")))
    total = own.count()
    chosen = own.where(F.col("u") < rows / max(1, total)).limit(2 * rows).select("doc_id", "y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def keys_of(words: list[str]) -> list[tuple[str, int]]:
    """Words of four letters or more and their beginnings (with a trailing star), each with
    the place it stands at."""
    out = []
    for i, word in enumerate(words):
        if len(word) >= STEMS.start:
            out.append((word, i))
            out += [(word[:n] + "*", i) for n in STEMS if n < len(word)]
    return out


def toxic_marks(sample: DataFrame, least: int) -> DataFrame:
    """(word, n_toxic) of keys in ``least`` toxic documents and different surroundings or more.

    ``n_toxic`` is the smaller of both numbers: copies of a document share the words next to
    a key, and a key repeated in one document stands in one document."""
    def run(batches):
        for batch in batches:
            found = set()
            for text, row in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words = [w.decode("utf-8", "replace") for w in alnum_words(text or b"")]
                around = ["", *words, ""]
                for key, i in keys_of(words):
                    found.add((key, zlib.crc32(f"{around[i]} {around[i + 2]}".encode()), row))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["word", "around", "row"])

    rows = sample.where("y > 0").select("text", F.xxhash64("text").alias("row")).mapInArrow(
        run, "word string, around bigint, row bigint")
    n = F.least(F.countDistinct("around"), F.countDistinct("row"))
    return rows.groupBy("word").agg(n.alias("n_toxic")).where(F.col("n_toxic") >= least)


def clean_counts(sample: DataFrame, marks: list[str] | None) -> DataFrame:
    """(word, n_clean): clean documents with each of the marks, or with any word if None."""
    wanted = None if marks is None else set(marks)

    def run(batches):
        for batch in batches:
            counts = Counter()
            for text in as_bytes(batch.column(0)):
                words = list({w.decode("utf-8", "replace") for w in alnum_words(text or b"")})
                counts.update(words if wanted is None else {k for k, _ in keys_of(words) if k in wanted})
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "n_clean"])

    rows = sample.where("y <= 0").select("text").mapInArrow(run, "word string, n_clean bigint")
    return rows.groupBy("word").agg(F.sum("n_clean").alias("n_clean"))


def lexicon(entries: list[tuple[str, int, int]]) -> tuple[list[str], list[str]]:
    """Words and stems from (key, toxic, clean) counts. A stem is left out where a shorter
    one marks as many toxic documents for its clean ones. The many forms of one stem are
    left to the stem; words of their own are kept, to be matched with misspellings."""
    stems: dict[str, tuple[int, int]] = {}
    for key, bad, good in sorted(entries, key=lambda e: (len(e[0]), e[0])):
        if not key.endswith("*"):
            continue
        shorter = [stems[key[:n]] for n in range(STEMS.start, len(key) - 1) if key[:n] in stems]
        if not any(b >= bad and g * bad <= (good + 1) * b for b, g in shorter):
            stems[key[:-1]] = (bad, good)
    words = [k for k, _, _ in entries if not k.endswith("*")]
    prefixes = [next((w[:n] for n in STEMS if w[:n] in stems), w) for w in words]
    forms = Counter(prefixes)
    return sorted(w for w, p in zip(words, prefixes) if forms[p] <= FORMS), sorted(stems)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = checkpointed(training_sample(docs, labels, rows))
    totals = {bool(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = totals.get(True, 0), totals.get(False, 0)
    if not n_bad or not n_good:
        return Model()
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * n_bad))
    found = toxic_marks(sample, least).orderBy(F.desc("n_toxic"), "word").limit(CANDIDATES).collect()
    n_toxic = {r["word"]: r["n_toxic"] for r in found}
    n_clean = {r["word"]: r["n_clean"] for r in clean_counts(sample, list(n_toxic)).collect()}
    kept = []
    for word, bad in n_toxic.items():
        good = n_clean.get(word, 0)
        a, b = bad + 0.5, good + 0.5
        odds = math.log(a / (n_bad + 1 - a)) - math.log(b / (n_good + 1 - b)) if a < n_bad + 1 and b < n_good + 1 else 0.0
        # Mostly seen in toxic documents, and not by chance.
        if bad >= PURITY * good and odds / math.sqrt(1 / a + 1 / b) >= LEAST_Z:
            kept.append({"word": word, "n_toxic": bad, "n_clean": good})
    kept = sorted(kept, key=lambda r: (-r["n_toxic"], r["word"]))[:LEXICON]
    words, stems = lexicon([(r["word"], r["n_toxic"], r["n_clean"]) for r in kept])
    model = Model(words, stems)

    def near(batches):
        matcher = model.matcher()
        for batch in batches:
            yield batch.filter(pa.array([matcher.match(w) == 2 for w in batch.column(0).to_pylist()], pa.bool_()))

    clean = clean_counts(sample, None)
    alike = clean.mapInArrow(near, clean.schema).orderBy(F.desc("n_clean"), "word").limit(EXCEPTIONS)
    model.exceptions = {r["word"] for r in alike.collect()}

    def measured(batches):
        codes = Codes(model.matcher())
        for batch in batches:
            x = [features(t, codes) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in x], pa.list_(pa.float64())),
                                              batch.column(1).cast(pa.int64())], names=["x", "y"])

    points = sample.mapInArrow(measured, "x array<double>, y bigint").collect()
    model.weights = fit(np.array([r["x"] for r in points]), np.array([float(r["y"] > 0) for r in points]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """All rows with a struct column holding the score, and its name. No shuffle."""
    name = fresh(docs, "toxicity")

    def start():
        codes = Codes(model.matcher())

        def compute(texts):
            if model.weights is None:
                return [pa.array([0.0] * len(texts), pa.float64())]
            x = np.array([features(t, codes) for t in texts])
            return [pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))]

        return compute

    return add_result(docs, text, T.StructType([T.StructField("score", T.DoubleType())]), name, start), name


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document with its score and verdict."""
    scored, name = score(docs.select("doc_id", "text"), train(docs, labels))
    value = F.col(name)["score"]
    return scored.select("doc_id", held_out().alias("held_out"), value.alias("score"),
                         (value >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below a half, with the columns they came with."""
    scored, name = score(docs, train(docs, labels))
    return scored.where(F.col(name)["score"] < 0.5).drop(name)
