"""Token counts by merging whole arrays of pre-tokens, rank by rank.

Texts are normalised and cut into words as the vocabulary's file says. The distinct words of
a batch are one ragged array of symbols. In each round every word finds its lowest-rank pair
of neighbours, and all places of these pairs are merged at once; words without a pair that can
be merged leave the array with the number of their symbols. A very long word keeps the places
of its pairs by rank, so that a round touches only the places it merges.

Within a word a pair's places are merged from the left, without overlap, which is what merging
one place after the other gives. This needs merges to use only symbols made before; a vocabulary
with other merges is refused.

Rows stay where they are: no shuffle. A null text is the empty text, with no tokens. Texts of any
length are counted whole, a stretch at a time. Strings of special tokens inside a text count as
one token each. Repeated rows and ids are rows of their own; an own column with the name of the
result stays, and the result takes the name with an underscore before it.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewatch.llm.bpe import byte_signs
from tidewatch.llm.texts import add_result, fresh
from tidewatch.session import with_tasks

with_tasks(__name__)

LIMIT = 2048
# Texts are cut at blanks into stretches of about this many characters, and words are counted
# this many at a time.
STRETCH, WORDS = 1 << 16, 1 << 17
# Words up to this size are remembered, in two generations of this many.
KEPT_WORD, KEPT_WORDS = 48, 120_000
# Words of more bytes than this are merged by their pairs' places.
LONG_WORD = 512
# Below this code point all Unicode versions agree; later ones are left to the tokenizer library.
SETTLED = "՘"
NEVER = np.int32(2**31 - 1)


class WordVocabulary:
    """Symbols, merges and word pattern of a word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.content = file.read()
        content = json.loads(self.content)
        model, ids = content["model"], content["model"]["vocab"]
        steps = [s["type"] for s in content["normalizer"]["normalizers"]]
        split, signs = content["pre_tokenizer"]["pretokenizers"]
        if (steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]
                or signs["type"] != "ByteLevel" or signs["use_regex"] or signs["add_prefix_space"]):
            raise ValueError(f"{path}: not a vocabulary of lower-case words with word ends")
        self.pattern = split["pattern"]["Regex"]
        self.special = [t["content"] for t in content["added_tokens"]]
        end, byte_of = model["end_of_word_suffix"], byte_signs()
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for sign, byte in byte_of.items():
            self.inner[byte], self.final[byte] = ids[sign], ids[sign + end]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            made.setdefault(a + b, rank)
        for rank, pair in enumerate(merges):
            for part in pair:
                if made.get(part, -1) >= rank or (part not in made and len(part.removesuffix(end)) > 1):
                    raise ValueError(f"{path}: merge {rank} uses the symbol {part!r}, which is not made before it")
        self.left, self.right, self.whole = (
            np.array([ids[t] for t in side], np.int64)
            for side in zip(*[(a, b, a + b) for a, b in merges]))
        self.size = max(ids.values()) + 1


class Merger:
    """Counts the symbols that are left of words once all merges are done."""

    def __init__(self, vocabulary: WordVocabulary):
        v = self.v = vocabulary
        keys = v.left * v.size + v.right
        # Of a pair listed twice, the first merge counts.
        self.keys, first = np.unique(keys, return_index=True)
        self.key_rank = first.astype(np.int32)
        self.made = v.whole.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.v.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that are not empty, one after the other, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, ends = self.v.inner[raw], np.cumsum(sizes) - 1
        symbols[ends] = self.v.final[raw[ends]]
        return symbols, np.repeat(np.arange(len(words), dtype=np.int32), sizes)

    def count(self, words: list[bytes]) -> np.ndarray:
        counts = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if short:
            counts[short] = self.count_short([words[i] for i in short])
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                counts[i] = self.count_long(word)
        return counts

    def count_short(self, words: list[bytes]) -> np.ndarray:
        """All words at once; in each round every word merges its lowest-rank pair."""
        counts = np.zeros(len(words), np.int64)
        symbol, word = self.symbols(words)
        rank = self._beside(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            first = np.append(True, word[1:] != word[:-1])
            starts, nth = np.flatnonzero(first), np.cumsum(first) - 1
            lowest = np.minimum.reduceat(rank, starts)[nth]
            done = lowest == NEVER
            if done.any():
                counts += np.bincount(word[done], minlength=len(words))
                symbol, word, rank, lowest = symbol[~done], word[~done], rank[~done], lowest[~done]
            at = _apart(np.flatnonzero(rank == lowest))
            if not len(at):
                break
            symbol[at] = self.made[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            moved = np.cumsum(stays)[at] - 1
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            rank[changed] = self._beside(symbol, word, changed)
        return counts

    def _beside(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at ``at``; a word's last symbol begins none."""
        after = np.minimum(at + 1, len(symbol) - 1)
        same = (word[after] == word[at]) & (after > at)
        return np.where(same, self.ranks(symbol[at], symbol[after]), NEVER)

    def count_long(self, raw: bytes) -> int:
        """One word: the places of its pairs wait by rank, the lowest rank is merged everywhere."""
        symbol, _ = self.symbols([raw])
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank != NEVER], rank[rank != NEVER]
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.diff(rank[order])) + 1
            for places in np.split(order, cuts) if len(order) else ():
                r = int(rank[places[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(at[places])

        wait(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[(symbol[at] == self.v.left[rank]) & (symbol[after[at]] == self.v.right[rank])]
            if not len(at):
                continue
            # Places that follow each other overlap if the second begins with the first one's end.
            follows = np.append(False, after[at[:-1]] == at[1:])
            at = at[_odd_free(follows)]
            gone = after[at]
            symbol[at], alive[gone] = self.made[rank], False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            wait(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return int(alive.sum())


def _odd_free(follows: np.ndarray) -> np.ndarray:
    """True for the first, third, ... of each run; ``follows`` marks members that are not first."""
    nth = np.arange(len(follows))
    first = np.maximum.accumulate(np.where(follows, 0, nth))
    return (nth - first) % 2 == 0


def _apart(at: np.ndarray) -> np.ndarray:
    """Leave out places that overlap the one before them; neighbours in a word have one rank."""
    return at[_odd_free(np.append(False, np.diff(at) == 1))] if len(at) else at


class Counter:
    """Numbers of tokens of texts, with a memory for words in two generations."""

    def __init__(self, vocabulary: WordVocabulary):
        self.merger = Merger(vocabulary)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.cut = regex.compile(vocabulary.pattern)
        self.later = re.compile(f"[{SETTLED}-\U0010ffff]")
        self.library = Tokenizer.from_str(vocabulary.content)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def words(self, text: str):
        """Lists of words of a text without special tokens."""
        at = 0
        while at < len(text):
            # No word and no composed character reaches over a blank.
            end = text.find(" ", at + STRETCH)
            end = len(text) if end < 0 else end
            part = text[at:end] if at or end < len(text) else text
            at = end
            if self.later.search(part):
                part = self.library.normalizer.normalize_str(part)
                yield [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
            else:
                if not part.isascii():
                    # Lower case sign by sign: a sigma at a word's end is a sigma like any other.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                yield self.cut.findall(part.lower())

    def numbers(self, words: list[str]) -> np.ndarray:
        """Tokens per word."""
        fresh_words, large = [], []
        for word in set(words):
            if word in self.new:
                continue
            if word in self.old:
                self.new[word] = self.old[word]
            else:
                fresh_words.append(word)
                if len(word) > KEPT_WORD:
                    large.append(word)
        if fresh_words:
            counts = self.merger.count([w.encode() for w in fresh_words])
            self.new.update(zip(fresh_words, counts.tolist()))
        out = np.fromiter(map(self.new.__getitem__, words), np.int64, len(words))
        for word in large:
            del self.new[word]
        if len(self.new) > KEPT_WORDS:
            self.new, self.old = {}, self.new
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[int] = []
        sizes: list[int] = []

        def settle():
            if words:
                numbers = self.numbers(words)
                np.add.at(totals, np.repeat(owner, sizes), numbers)
                words.clear(), owner.clear(), sizes.clear()

        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                totals[i] += len(self.special.findall(text))
                parts = self.special.split(text)
            for part in parts:
                for found in self.words(part):
                    words += found
                    owner.append(i)
                    sizes.append(len(found))
                    if len(words) >= WORDS:
                        settle()
        settle()
        return totals


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Append the number of tokens of each text."""
    vocabulary = WordVocabulary(path)
    name, into = fresh(docs, "counted"), fresh(docs, into)

    def start():
        counter = Counter(vocabulary)
        return lambda texts: [pa.array(counter.count([t.decode() if t else "" for t in texts]))]

    kind = T.StructType([T.StructField("n", T.LongType())])
    return add_result(docs, text, kind, name, start).withColumn(into, F.col(name)["n"]).drop(name)


def count_report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """A row per document: bytes and tokens of its text, and whether it has too many tokens."""
    counted = count_tokens(docs.select("doc_id", "text"), path)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
