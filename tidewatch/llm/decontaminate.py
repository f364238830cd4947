"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: ``window`` consecutive words, or
the whole of a shorter item. Windows of one length form a search of their own. Its
shift table tells from a block of two words how far the search may move on without
passing an occurrence; where the shift is none, the windows that end in this block and
start with the same block are compared word by word.

Nulls have no words and are never hit. Items without words have no window. Equal items
count once, a null item id counts as the empty id.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.texts import add_result, alnum_words, fresh
from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

WINDOW = 13
# Items are searched in blocks of about this many bytes of item text. One block's tables are
# what a task holds; more items make more passes over the documents.
BLOCK_BYTES = 8 << 20

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
                      T.StructField("items", T.ArrayType(T.StringType()))])


class Search:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            ends = words[-self.block:], words[:self.block]
            self.buckets[ends].append((list(words), items))

    def occurrences(self, words: list[bytes]):
        """(start, items) of every occurrence, from left to right."""
        length, block, default = self.length, self.block, self.default
        shift, at, n = self.shift, self.length, len(words)
        while at <= n:
            step = shift.get(tuple(words[at - block:at]), default)
            if step:
                at += step
                continue
            start = at - length
            ends = tuple(words[at - block:at]), tuple(words[start:start + block])
            for pattern, items in self.buckets.get(ends, ()):
                if words[start:at] == pattern:
                    yield start, items
            at += 1


def searches(items: list[tuple[str, bytes]], window: int) -> list[Search]:
    patterns: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = tuple(alnum_words(text))
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            patterns[length][words[start:start + length]].add(item)
    return [Search(length, found) for length, found in sorted(patterns.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _scan(docs: DataFrame, text: str, block: list[tuple[str, bytes]], window: int, name: str) -> DataFrame:
    def start():
        tables = searches(block, window)

        def compute(texts):
            counts, spans, items = [], [], []
            for value in texts:
                words = alnum_words(value or b"")
                hits, names = [], set()
                for table in tables:
                    for at, found in table.occurrences(words):
                        hits.append((at, at + table.length))
                        names |= found
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(hits)])
                items.append(sorted(names))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

        return compute

    return add_result(docs, text, FOUND, name, start)


def blocks(items: DataFrame, text: str, item_id: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The distinct items in lists of bounded size; one list is on the driver at a time."""
    rows = (items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
            .where(F.col("t").isNotNull()).distinct())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == number) if count > 1 else rows
        yield [(r["i"], r["t"].encode()) for r in part.collect()]


def _union(found: str, more: str) -> F.Column:
    """Results of two passes as one; spans are merged again."""
    def join(acc, span):
        last = F.element_at(acc, -1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))
        return F.when((F.size(acc) > 0) & (span["start"] <= last["end"]), grown).otherwise(
            F.concat(acc, F.array(span)))

    kind = FOUND["spans"].dataType.simpleString()
    spans = F.array_sort(F.concat(F.col(found)["spans"], F.col(more)["spans"]))
    return F.struct(F.col(found)["n_words"].alias("n_words"),
                    F.aggregate(spans, F.array().cast(kind), join).alias("spans"),
                    F.array_sort(F.array_union(F.col(found)["items"], F.col(more)["items"])).alias("items"))


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
               item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """All rows of ``docs`` with a struct column (n_words, spans, items), and its name.

    ``spans`` are the word ranges that occurrences cover, ``items`` the ids of the items
    found. The documents do not move; each block of items is one pass over them.
    """
    name = None
    for block in blocks(items, item_text, item_id, block_bytes):
        if name is None:
            name = fresh(docs, "found")
            docs = _scan(docs, text, block, window, name)
            continue
        docs = checkpointed(docs)
        more = fresh(docs, "more")
        docs = _scan(docs, text, block, window, more)
        docs = docs.withColumn(name, _union(name, more)).drop(more)
    return docs, name


def n_hit(found: str) -> F.Column:
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(found: str, share: int = 20) -> F.Column:
    """True if one word in ``share`` or more is covered."""
    return (n_hit(found) > 0) & (n_hit(found) * share >= F.col(found)["n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found, name = find_items(docs, items, text)
    return found.where(~contaminated(name)).drop(name)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document: words, covered words, items found and the verdict."""
    found, name = find_items(docs.select("doc_id", "text"), items)
    ids = F.array_join(F.col(name)["items"], ",")
    return found.select(
        "doc_id", F.col(name)["n_words"].alias("n_words"), n_hit(name).alias("n_hit"),
        F.size(F.col(name)["items"]).cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), contaminated(name).alias("contaminated"))


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """(words, covered words, sorted items) by trying every place; for tests."""
    out = []
    for text in texts:
        words = alnum_words((text or "").encode())
        hit, names = np.zeros(len(words), bool), set()
        for item, value in items:
            sought = alnum_words((value or "").encode())
            length = min(window, len(sought))
            for i in range(len(sought) - length + 1 if length else 0):
                for at in range(len(words) - length + 1):
                    if words[at:at + length] == sought[i:i + length]:
                        hit[at:at + length] = True
                        names.add(item)
        out.append((len(words), int(hit.sum()), sorted(names)))
    return out


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
