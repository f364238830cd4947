"""Language of words and texts by a linear-chain conditional random field.

A word's features are its prefixes and suffixes, the n-grams of its letters and, if it is
frequent in the training sample, the word itself (the lexicon). The chain adds a learned
weight for going from one language to the next. Forward-backward gives each word the
probability of each language; a text's language is the one with the largest mean, which
is also the score. Runs of words with the same likeliest language are the spans of a
code-switched text.

Labels are known per document only, so training sequences are cut from documents and
spliced: half of them change language once or more, which is what the transition weights
are learned from. The sample is bounded per language by rows and bytes; the number of
languages is bounded too.

Words end at ASCII signs, so scripts without spaces give long runs. A run of more than
``LONGEST`` characters is cut into units of about ``UNIT`` characters, which stand in the
chain, and are counted in spans, like words. All of its n-grams and its true ends are features.

A text that is null or has no letter is ``und`` with score 0. If nothing can be learned,
every text is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.texts import ALNUM, add_result, fresh
from tidewatch.session import with_tasks

with_tasks(__name__)

# Bounds of the training sample and of what a task remembers.
LANGUAGES, SAMPLE_ROWS, SAMPLE_BYTES = 64, 150, 600_000
LEXICON = 4_000
BITS = 15
LONGEST, UNIT = 64, 16
SEQUENCE, EPOCHS, RATE, DECAY = 64, 30, 0.15, 1e-4
# Words are remembered in two generations of this many.
KNOWN_WORDS = 250_000
UNKNOWN = "und"


def units(word: bytes) -> list[bytes]:
    """A word, or the units of a long one. A sign that no word has, ``-``, stands where a unit
    was cut off; the two characters after a cut follow it, for the n-grams across."""
    run = word.decode("utf-8", "replace")
    if len(run) <= LONGEST:
        return [word]
    count = -(-len(run) // UNIT)
    cuts = [len(run) * i // count for i in range(count + 1)]
    return [("-" * (lo > 0) + run[lo:hi] + ("-" + run[hi:hi + 2]) * (hi < len(run))).encode()
            for lo, hi in zip(cuts, cuts[1:])]


def words_of(text: bytes) -> list[bytes]:
    words = text.decode("utf-8", "replace").lower().encode().translate(ALNUM).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [u for w in words for u in (units(w) if len(w) > LONGEST else (w,))]


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(map(str.isalpha, text.decode("utf-8", "replace")))


def feature_ids(raw: bytes, lexicon: set[bytes]) -> list[int]:
    """Hashed features of a word: affixes, letter n-grams, lexicon entry, kind."""
    word = raw.decode("utf-8", "replace")
    body, cut, ahead = word.removeprefix("-").partition("-")
    names = [] if word[:1] == "-" else [f"^{body[:n]}" for n in (1, 2, 3, 4) if n <= len(body)]
    names += [] if cut else [f"{body[-n:]}$" for n in (1, 2, 3, 4) if n <= len(body)]
    run = body + ahead
    names += [run[i:i + n] for n in (1, 2, 3) for i in range(min(len(body), len(run) - n + 1))]
    names.append("#0" if body.isdigit() else "#a")
    if raw in lexicon:
        names.append("=" + word)
    mask = (1 << BITS) - 1
    return [zlib.crc32(n.encode()) & mask for n in names]


class Crc:
    """CRC-32 of many stretches of one text at once, taken on sign by sign."""

    def __init__(self, text: str):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        self.table = table
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[self.size]
        self.bytes = [lead | code >> (6 * (self.size - 1)).astype(np.uint32)]
        for k in range(1, 4):
            shift = (6 * np.maximum(self.size - 1 - k, 0)).astype(np.uint32)
            self.bytes.append(0x80 | (code >> shift) & 0x3F)

    def byte(self, state: np.ndarray, value) -> np.ndarray:
        return self.table[(state ^ value) & 0xFF] ^ (state >> np.uint32(8))

    def sign(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """States after the signs at some places."""
        state, size = self.byte(state, self.bytes[0][at]), self.size[at]
        for k in range(1, int(size.max()) if len(size) else 0):
            more = np.flatnonzero(size > k)
            state[more] = self.byte(state[more], self.bytes[k][at[more]])
        return state


def all_feature_ids(words: list[bytes], lexicon: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of the features of many words, the same as word by word."""
    mask = (1 << BITS) - 1
    cut = [i for i, w in enumerate(words) if b"-" in w]
    found = [(np.full(len(ids), i), np.array(ids, np.int64)) for i in cut for ids in [feature_ids(words[i], lexicon)]]
    plain = [i for i, w in enumerate(words) if b"-" not in w] if cut else range(len(words))
    texts = [words[i].decode("utf-8", "replace") for i in plain]
    number = np.array(plain, np.int64)
    length = np.array([len(t) for t in texts], np.int64)
    crc, end = Crc("".join(texts)), np.cumsum(length)
    begin, owner = end - length, np.repeat(np.arange(len(texts)), length)
    start = np.uint32(0xFFFFFFFF)

    def add(of: np.ndarray, state: np.ndarray) -> None:
        found.append((number[of], (~state & np.uint32(mask)).astype(np.int64)))

    at = np.arange(int(end[-1]) if len(texts) else 0)
    state = np.full(len(at), start)
    for n in (1, 2, 3):
        state = crc.sign(state, at + n - 1)
        add(owner[at], state)
        inside = at + n < end[owner[at]]
        at, state = at[inside], state[inside]
    of = np.arange(len(texts))
    state = crc.byte(np.full(len(of), start), ord("^"))
    for n in (1, 2, 3, 4):
        state, of = state[length[of] >= n], of[length[of] >= n]
        state = crc.sign(state, begin[of] + n - 1)
        add(of, state)
        tail = np.full(len(of), start)
        for k in range(n, 0, -1):
            tail = crc.sign(tail, end[of] - k)
        add(of, crc.byte(tail, ord("$")))
    kinds = np.array([zlib.crc32(b"#a") & mask, zlib.crc32(b"#0") & mask])
    found.append((number, kinds[np.array([t.isdigit() for t in texts], np.int64)]))
    known = [i for i in plain if words[i] in lexicon]
    found.append((np.array(known, np.int64), np.array([zlib.crc32(b"=" + words[i]) & mask for i in known], np.int64)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass
class Field:
    """A trained model: feature weights, transition weights and the lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: set[bytes]


def word_scores(ids: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """A row of language scores per word: the mean of its features' weights, scaled by their root number."""
    sizes = np.array([len(i) for i in ids])
    flat = np.fromiter((f for i in ids for f in i), np.int64, int(sizes.sum()))
    sums = np.add.reduceat(weights[flat], np.cumsum([0, *sizes[:-1]]), axis=0)
    return sums / np.sqrt(sizes)[:, None]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray,
                     edges: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Language probabilities of each word, transition totals and log partition sum.

    ``scores`` holds the words of all sequences one after the other. All sequences move on
    by a word together, the longest first in line.
    """
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    top = scores.max(axis=1)
    e = np.exp(np.maximum(scores - top[:, None], -30.0))
    move = np.exp(transitions)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    alpha, scale = np.empty_like(e), np.empty(len(e))
    a = None
    for t in range(steps):
        at = first[:active[t]] + t
        a = e[at] if t == 0 else (a[:active[t]] @ move) * e[at]
        scale[at] = s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[at] = a
    gamma = np.empty_like(e)
    totals = np.zeros_like(move) if edges else None
    b = np.ones((0, e.shape[1]))
    for t in range(steps - 1, -1, -1):
        n, known = active[t], len(b)
        at = first[:n] + t
        full = np.ones((n, e.shape[1]))
        if known:
            after = first[:known] + t + 1
            ahead = b * e[after] / scale[after][:, None]
            full[:known] = ahead @ move.T
            if edges:
                totals += (alpha[at[:known]].T @ ahead) * move
        gamma[at] = alpha[at] * full
        b = full
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, totals, float(np.log(scale).sum() + top.sum())


def splice(docs: list[tuple[list[int], int]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of word numbers and their languages, half of them of several documents."""
    count = max(8, sum(len(w) for w, _ in docs) // SEQUENCE)
    x, y = np.empty((count, SEQUENCE), np.int64), np.empty((count, SEQUENCE), np.int64)
    by_language: dict[int, list[int]] = {}
    for i, (_, language) in enumerate(docs):
        by_language.setdefault(language, []).append(i)
    known = list(by_language)
    for row in range(count):
        parts = 1 if row % 2 else int(rng.integers(2, 5))
        cuts = [0, *np.sort(rng.integers(1, SEQUENCE, parts - 1)), SEQUENCE]
        for lo, hi in zip(cuts, cuts[1:]):
            language = known[int(rng.integers(len(known)))]
            words = docs[by_language[language][int(rng.integers(len(by_language[language])))]][0]
            start = int(rng.integers(len(words)))
            x[row, lo:hi] = np.resize(words[start:start + hi - lo], hi - lo)
            y[row, lo:hi] = language
    return x, y


def fit(texts: list[tuple[bytes, str]], seed: int = 7) -> Field | None:
    """Train on (text, language) pairs by gradient steps on the likelihood of the sequences."""
    texts = [(words_of(t), language) for t, language in texts]
    texts = [(w, language) for w, language in texts if w]
    languages = sorted({language for _, language in texts})
    if not languages:
        return None
    counts = Counter(w for words, _ in texts for w in words)
    lexicon = {w for w, _ in counts.most_common(LEXICON)}
    number = {w: i for i, w in enumerate(counts)}
    docs = [([number[w] for w in words], languages.index(language)) for words, language in texts]
    x, y = splice(docs, np.random.default_rng(seed))
    ids = [feature_ids(w, lexicon) for w in counts]
    sizes = np.array([len(i) for i in ids])
    flat = np.fromiter((f for i in ids for f in i), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(ids)), sizes)
    n, labels = len(languages), y.ravel()
    gold = np.zeros((n, n))
    np.add.at(gold, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    weights, transitions = np.zeros((1 << BITS, n)), np.zeros((n, n))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, transitions)]
    lengths = np.full(len(x), SEQUENCE)
    for epoch in range(1, EPOCHS + 1):
        scores = word_scores(ids, weights)
        gamma, totals, _ = forward_backward(scores[x.ravel()], lengths, transitions, edges=True)
        gamma[np.arange(len(labels)), labels] -= 1
        per_word = np.stack([np.bincount(x.ravel(), gamma[:, k], len(ids)) for k in range(n)], axis=1)
        per_word /= np.sqrt(sizes)[:, None]
        slope = np.stack([np.bincount(flat, per_word[owner, k], 1 << BITS) for k in range(n)], axis=1)
        slopes = slope / len(labels) + DECAY * weights, (totals - gold) / len(labels) + DECAY * transitions
        for param, gradient, moments in zip((weights, transitions), slopes, state):
            moments[0] += 0.1 * (gradient - moments[0])
            moments[1] += 0.01 * (gradient**2 - moments[1])
            unbiased = moments[0] / (1 - 0.9**epoch), moments[1] / (1 - 0.99**epoch)
            param -= RATE * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-8)
    return Field(languages, weights, transitions, lexicon)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the rows no language is learned from. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[bytes, str]]:
    """About ``rows`` whole texts per language, of ``size`` bytes in all (or one text). Texts of
    more than a third of ``size`` come last, so they leave out no shorter ones.

    Rows are thinned out by a hash of the id and the count of their language, so what is
    sorted and collected is bounded whatever the size of the table."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    if not counts:
        return []
    shares = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, rows / n))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    thin = known.withColumn("u", u).where(F.col("u") < F.coalesce(shares[F.col("lang")], F.lit(0.0)))
    order = Window.partitionBy("lang").orderBy(F.octet_length("text") > size // 3, "u", "doc_id", "text")
    thin = thin.withColumns({"nth": F.row_number().over(order), "sum": F.sum(F.octet_length("text")).over(order)})
    taken = thin.where((F.col("nth") == 1) | ((F.col("nth") <= 2 * rows) & (F.col("sum") <= size)))
    return [(r["text"].encode(), r["lang"]) for r in taken.orderBy("lang", "nth").collect()]


class Labeller:
    """Applies a model; scores of words are worked out on first sight."""

    def __init__(self, model: Field):
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.scores = np.empty((0, len(model.languages)))
        self.older = self.rows, self.scores

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.rows) > KNOWN_WORDS:
            # Words that come again are taken over from the older generation.
            self.older = self.rows, self.scores
            self.rows, self.scores = {}, self.scores[:0]
        rows, (older, scores) = self.rows, self.older
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            kept, cold = [w for w in new if w in older], [w for w in new if w not in older]
            more = [scores[[older[w] for w in kept]]] if kept else []
            more += [self.scores_of_new(cold[i:i + 50_000]) for i in range(0, len(cold), 50_000)]
            self.scores = np.concatenate([self.scores, *more])
            for word in [*kept, *cold]:
                rows[word] = len(rows)
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def scores_of_new(self, words: list[bytes]) -> np.ndarray:
        owner, ids = all_feature_ids(words, self.model.lexicon)
        weights = self.model.weights
        sums = np.stack([np.bincount(owner, weights[ids, k], len(words)) for k in range(weights.shape[1])], axis=1)
        return sums / np.sqrt(np.bincount(owner, minlength=len(words)))[:, None]

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float, list[dict]]]:
        split = [words_of(t) if has_letter(t) else [] for t in texts]
        lengths = np.array([len(w) for w in split])
        if not lengths.sum():
            return [(UNKNOWN, 0.0, []) for _ in texts]
        scores = self.scores_of([w for words in split for w in words])
        gamma, _, _ = forward_backward(scores, lengths[lengths > 0], self.model.transitions)
        best = gamma.argmax(axis=1)
        out, at = [], 0
        for n in lengths.tolist():
            if not n:
                out.append((UNKNOWN, 0.0, []))
                continue
            mean = gamma[at:at + n].mean(axis=0)
            top = int(mean.argmax())
            runs = np.flatnonzero(np.diff(best[at:at + n], prepend=-1))
            ends = [*runs[1:].tolist(), n]
            spans = [{"start": int(a), "end": int(b), "lang": self.model.languages[best[at + a]]}
                     for a, b in zip(runs, ends)]
            out.append((self.model.languages[top], min(1.0, float(mean[top])), spans))
            at += n
        return out

    def scores_of(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers(words)
        return self.scores[numbers]


FOUND = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("lang", T.StringType())])))])


def label_languages(docs: DataFrame, model: Field | None, text: str = "text") -> tuple[DataFrame, str]:
    """All rows with a struct column (lang, score, spans of words), and its name. No shuffle."""
    name = fresh(docs, "language")

    def start():
        labeller = Labeller(model) if model else None
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

        def compute(texts):
            rows = labeller.label(texts) if labeller else [(UNKNOWN, 0.0, []) for _ in texts]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.list_(span))]

        return compute

    return add_result(docs, text, FOUND, name, start), name


def language_report(docs: DataFrame) -> DataFrame:
    """A row per document: held out or not, predicted language, score."""
    found, name = label_languages(docs.select("doc_id", "text"), fit(training_texts(docs)))
    return found.select("doc_id", held_out().alias("held_out"), F.col(name)["lang"].alias("lang_pred"),
                        F.col(name)["score"].alias("score"))
