"""Repeated passages by recompression.

Texts are shrunk in rounds. A run of one word becomes a symbol, and then, round by round,
neighbours whose classes are (left, right) become one symbol; a symbol's class is a bit
of its name. Names are hashes of what they stand for, so every task gives equal parts
the same name without asking. Each symbol also knows its context: the words that have to
be the same for it to come about. If a passage occurs twice, all symbols whose context
lies inside it are the same in both places, whatever stands around it.

Every window of words is named after one interior symbol and the words of its context:
the one with the shortest context of ``CONTEXT`` words or more, else the longest. Windows
of equal words therefore have equal names, and equal names are rare otherwise.
Neighbouring windows with one name form a run, and only runs are shuffled: where the
whole run stands in a document with a smaller id too, all its windows are repeats. Where
documents share a name but not the run, at the ends of a repeat, the windows of each
different run are compared one by one by a 128-bit hash of their words.

Runs that a task has seen from a smaller document itself are settled before the shuffle,
so a passage in a third of all rows costs one row per batch. Nulls have no words. Null
ids are larger than all others; rows of one id never count as repeats of each other, and
are told apart by 31 bits of a hash of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.texts import as_bytes, pieces
from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

WINDOW = 13
ROUNDS = 8
# Null ids count as one id, above all others, but rows without an id are told apart by a hash of
# their text: ids from NULL_ID on stand for null.
NULL_ID = (1 << 63) - (1 << 31)
FAR = 1 << 40
# Words of context from which a symbol names a window well.
CONTEXT = 6
# The upper bits of a window's name rank the symbol, the others are a hash.
RANK_BITS = 5
# A spot is first word * 32 + windows * 2 + settled, under the tag of the text. This bounds
# a text to 2^27 words and a run to 15 windows.
MOST_WINDOWS, TAG = 15, 0x7FFFFFFF


def mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = a * u(0x9E3779B97F4A7C15) + b * u(0xC2B2AE3D27D4EB4F) + u(salt * 0x165667B19E3779F9 % (1 << 64))
        x = (x ^ (x >> u(29))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(32))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(29))


def rounds(words: np.ndarray, doc: np.ndarray, window: int):
    """Symbols whose context fits a window, as (name, context start, context end), round by round."""
    n = len(words)
    start = np.ones(n, bool)
    start[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    b = np.flatnonzero(start)
    e = np.append(b[1:], n)
    length = (e - b).astype(np.uint64)
    name = np.where(length == 1, words[b], mix(words[b], length, 1))
    doc = doc[b]
    # That a run ends is known from the words next to it; at the end of a text it never is.
    first = np.append(True, doc[1:] != doc[:-1])
    last = np.append(first[1:], True)
    low, high = np.where(first, -FAR, b - 1), np.where(last, FAR, e + 1)
    zero = np.zeros(1, np.uint64)
    for level in range(ROUNDS):
        fits = high - low <= window
        if not fits.any():
            return
        yield name[fits], low[fits], high[fits]
        right = (mix(name, zero, 2 + level) & np.uint64(1)).astype(bool)
        pair = ~right & np.append(right[1:], False) & ~last
        second = np.append(False, pair[:-1])
        # A left symbol depends on the one after it, paired or not; a right symbol that is not
        # the second of a pair on the one before. Where a text ends there is none.
        after, before = np.append(high[1:], FAR), np.append(-FAR, low[:-1])
        high = np.where(right, high, np.where(last, FAR, after))
        low = np.where(right & ~second, np.where(first, -FAR, before), low)
        at = np.flatnonzero(pair)
        name = name.copy()
        name[at] = mix(name[at], name[at + 1], 100 + level)
        keep = ~second
        name, low, high, doc = (x[keep] for x in (name, low, high, doc))
        first = np.append(True, doc[1:] != doc[:-1])
        last = np.append(first[1:], True)


def stretches(words: np.ndarray, window: int) -> list[np.ndarray]:
    """Hashes of 1, 2, 4, ... words from each word on, up to the window."""
    out, width = [words], 1
    while 2 * width <= window:
        after = np.append(out[-1][width:], np.zeros(min(width, len(words)), np.uint64))
        out.append(mix(out[-1], after, 20 + width))
        width *= 2
    return out


def hash_between(powers: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words from low to high, from two stretches that cover them."""
    length = high - low
    power = np.minimum(np.floor(np.log2(length)).astype(int), len(powers) - 1)
    out = np.empty(len(low), np.uint64)
    for k, stretch in enumerate(powers):
        at = np.flatnonzero(power == k)
        out[at] = mix(stretch[low[at]], stretch[high[at] - (1 << k)], 40)
    return mix(out, length.astype(np.uint64), 41)


def window_names(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, hash) of the window that starts at each word; at the end of all words there is none."""
    n = len(words)
    best = np.zeros(n, np.uint64)
    powers = stretches(words, window)
    for name, low, high in rounds(words, doc, window):
        context = high - low
        rank = np.where(context >= CONTEXT, 2 * window - context, np.minimum(context, window - 1))
        rank = np.minimum(rank, (1 << RANK_BITS) - 1).astype(np.uint64)
        value = mix(name, hash_between(powers, low, high), 3) >> np.uint64(RANK_BITS)
        value |= rank << np.uint64(64 - RANK_BITS)
        # A symbol is inside the windows that start from high - window to low.
        least = np.maximum(high - window, 0)
        for step in range(window):
            at = least + step
            inside = at <= low
            if not inside.any():
                break
            np.maximum.at(best, at[inside], value[inside])
    hashes = np.zeros(n, np.uint64)
    at = np.arange(max(0, n - window + 1))
    hashes[at] = hash_between(powers, at, at + window)
    return np.where(best == 0, hashes >> np.uint64(RANK_BITS), best), hashes


def runs_of(texts: list[bytes | None], window: int = WINDOW):
    """Runs of windows with one name: (text number, first word, windows, name, hash of the run)."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) if len(w) >= window else 0 for w in split])
    n = int(sizes.sum())
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, empty, empty
    digest = xxhash.xxh3_64_intdigest
    words = np.fromiter((digest(w) for ws, k in zip(split, sizes.tolist()) if k for w in ws), np.uint64, n)
    doc = np.repeat(np.arange(len(split)), sizes)
    begin = np.cumsum(sizes) - sizes
    names, hashes = window_names(words, doc, window)
    at = np.flatnonzero(np.arange(n) + window <= (begin + sizes)[doc])
    names, doc = names[at], doc[at]
    head = np.ones(len(at), bool)
    head[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    # A run is no longer than a window, so that its first and last window cover all its words.
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    head |= since % min(window, MOST_WINDOWS) == 0
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(at)))
    whole = mix(hashes[at[first]], hashes[at[first + count - 1]], 7) ^ count.astype(np.uint64)
    return doc[first], at[first] - begin[doc[first]], count, names[first].view(np.int64), whole.view(np.int64)


def settle(ids: np.ndarray, doc: np.ndarray, name: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """True for runs that a smaller id of the same batch has too."""
    ids = np.minimum(ids, NULL_ID)
    order = np.lexsort((ids[doc], whole, name))
    n, w, i = name[order], whole[order], ids[doc][order]
    head = np.ones(len(order), bool)
    head[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
    least = i[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = i > least
    return out


def row_id(id_column: str, text: str) -> F.Column:
    """The id, or for null a number from NULL_ID on that hangs on the text."""
    spread = F.xxhash64(F.lit(1), F.col(text)).bitwiseAND(F.lit(TAG))
    known = F.least(F.col(id_column).cast("bigint"), F.lit(NULL_ID - 1))
    return F.when(F.col(id_column).isNull(), F.lit(NULL_ID) + spread).otherwise(known)


def rank(ids: str) -> F.Column:
    """The id by which rows are compared."""
    return F.least(F.col(ids), F.lit(NULL_ID))


def text_tag(text: str) -> F.Column:
    return F.xxhash64(text).bitwiseAND(F.lit(TAG))


def all_runs(docs: DataFrame, window: int) -> DataFrame:
    """Runs of all texts as (name, whole, id, spot). A settled run has a name of its own,
    under which it meets nothing."""
    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for lo, hi in pieces(texts):
                doc, start, count, name, whole = runs_of(texts[lo:hi], window)
                found.append((doc + lo, start * 32 + count * 2, name, whole))
            if not found:
                continue
            doc, spot, name, whole = (np.concatenate(x) for x in zip(*found))
            done = settle(ids, doc, name, whole)
            spot = (tags[doc] << 32) + spot + done
            own = mix(ids[doc].view(np.uint64), spot.view(np.uint64), 9).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(done, own, name)), pa.array(np.where(done, own, whole)), pa.array(ids[doc]),
                 pa.array(spot)], names=["name", "whole", "id", "spot"])

    return docs.mapInArrow(run, "name bigint, whole bigint, id bigint, spot bigint")


def judged_runs(runs: DataFrame) -> DataFrame:
    """(id, tag, repeated, open): whole repeats, and runs whose windows are still to be
    compared, as arrays of first word * 16 + windows. Runs that share nothing are dropped.

    Windows have to be compared only under names that stand in different runs whose
    smallest ids differ; the smallest id's run takes part, as the others are held against it."""
    by_name = Window.partitionBy("name")
    # One shuffle by name serves both windows.
    told = runs.repartition("name").withColumn("least", F.min(rank("id")).over(Window.partitionBy("name", "whole")))
    told = told.withColumns({"smallest": F.min("least").over(by_name), "largest": F.max("least").over(by_name)})
    repeated = (F.col("spot") % 2 == 1) | (rank("id") > F.col("least"))
    undecided = ~repeated & (F.col("smallest") < F.col("largest"))
    place = F.shiftright(F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    return (told.where(repeated | undecided)
            .select("id", F.shiftright("spot", 32).alias("tag"), F.when(repeated, place).alias("r"),
                    F.when(~repeated, place).alias("o"))
            .groupBy("id", "tag").agg(F.collect_list("r").alias("repeated"), F.collect_list("o").alias("open")))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """True for words under a window; ``counts`` windows start from each start on."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def without(words: list[bytes], mask: np.ndarray) -> str:
    return b" ".join([w for w, m in zip(words, mask.tolist()) if not m]).decode()


def first_pass(docs: DataFrame, window: int) -> DataFrame:
    """Texts with their runs: what is decided already, else the text, the runs covered so
    far and the 128-bit hashes of the windows in question."""
    schema = ("id bigint, tag bigint, n_words bigint, n_removed bigint, kept string, text string, spots array<bigint>, "
              "windows array<struct<start:bigint,h1:bigint,h2:bigint>>")
    cell = pa.list_(pa.struct([("start", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]))

    def hashed(words, spots):
        out = []
        for spot in spots:
            for start in range(spot // 16, spot // 16 + spot % 16):
                value = xxhash.xxh3_128_digest(b" ".join(words[start:start + window]))
                h1, h2 = np.frombuffer(value, np.int64).tolist()
                out.append({"start": start, "h1": h1, "h2": h2})
        return out

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(2))
            repeated, undecided = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for lo, hi in pieces(texts):
                rows = []
                for i in range(lo, hi):
                    words = (texts[i] or b"").split()
                    if undecided[i]:
                        text = (texts[i] or b"").decode()
                        rows.append((len(words), None, None, text, repeated[i] or [], hashed(words, undecided[i])))
                        continue
                    spots = np.array(repeated[i] or [], np.int64)
                    mask = covered(len(words), spots // 16, spots % 16, window)
                    rows.append((len(words), int(mask.sum()), without(words, mask), None, None, None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), cell]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns],
                    names=["id", "tag", "n_words", "n_removed", "kept", "text", "spots", "windows"])

    return docs.mapInArrow(run, schema)


def last_pass(rows: DataFrame, window: int) -> DataFrame:
    """Rows whose windows have been compared; ``starts`` are the windows found to be repeats."""
    def run(batches):
        for batch in batches:
            out = []
            texts = as_bytes(batch.column(1))
            for text, spots, starts in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, spots = (text or b"").split(), np.array(spots or [], np.int64)
                starts = np.array(starts or [], np.int64)
                mask = covered(len(words), np.concatenate([spots // 16, starts]),
                               np.concatenate([spots % 16, np.ones(len(starts), np.int64)]), window)
                out.append((len(words), int(mask.sum()), without(words, mask)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: id, n_words, n_removed and the kept words joined by spaces.

    A word is removed if a window over it also starts in a document with a smaller id."""
    rows = docs.select(row_id(id_column, text).alias("id"), text_tag(text).alias("tag"), F.col(text).alias("text"))
    judged = judged_runs(all_runs(rows, window))
    joined = rows.join(judged, ["id", "tag"], "left").select("id", "tag", "text", "repeated", "open")
    first = checkpointed(first_pass(joined, window))
    done = first.where(F.col("text").isNull()).select("id", "n_words", "n_removed", "kept")
    left = first.where(F.col("text").isNotNull()).select("id", "tag", "text", "spots", "windows")

    windows = left.select("id", "tag", F.explode("windows").alias("w")).select("id", "tag", "w.start", "w.h1", "w.h2")
    least = windows.groupBy("h1", "h2").agg(F.min(rank("id")).alias("least"), F.max(rank("id")).alias("most")).where("least < most")
    hits = (windows.join(least.drop("most"), ["h1", "h2"]).where(rank("id") > F.col("least"))
            .groupBy("id", "tag").agg(F.collect_set("start").alias("starts")))
    closed = last_pass(left.join(hits, ["id", "tag"], "left").select("id", "text", "spots", "starts"), window)
    return done.union(closed).select(F.when(F.col("id") < NULL_ID, F.col("id")).alias(id_column), "n_words", "n_removed", "kept")


def repeat_report(docs: DataFrame) -> DataFrame:
    """A row per document: words, words removed, digest of what is kept."""
    found = remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """(id, words, words removed, digest) from a table of all windows; for tests."""
    split = [(NULL_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (given, _), (i, words) in zip(rows, split):
        mask = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            if least[tuple(words[s:s + window])] < i:
                mask[s:s + window] = True
        kept = without(words, mask)
        out.append((given, len(words), int(mask.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out
