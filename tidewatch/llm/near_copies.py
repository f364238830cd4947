"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one row before the search, which has three steps; every link is confirmed by
the exact similarity of the two sets, by a join.

1. SimHash: a set's fingerprint of 64 bits is the majority of its shingles' hashes. Covering
   hashing (``simhash.links``) finds all fingerprints within 2 bits. Equal ones are compared with
   the first of them. What is linked here is not compared again.
2. MinHash, as a pair at 0.8 differs in about 15 percent of its SimHash bits, a radius no covering
   scheme reaches with few tables. Each of ``BANDS`` keys of a set is made of ``ROWS`` minima, and a
   pair of similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, which is 1 - 3e-6 at
   0.8. Sets that share a key are a bucket. Each set is compared with one set of each of its
   buckets: the one whose buckets are the fullest, which is near the middle of a group of copies.
3. What is apart from a bucket's largest group then (``PIVOTS`` further members of which may be
   tried first) is looked up by its rarest shingles. Shingles are ordered by the number of sets
   that hold them. Two similar sets have a shingle in common so early in both of their orders that
   what follows is long enough (a prefix filter). Sets that differ in shingles of their own share
   none so early, so a bucket's pairs are not written down, and no similar pair is left out.

Words are told apart after lower-casing A-Z. Fewer than five words make one shingle; texts
without words (or null) are equal to each other. A null id is larger than every other id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.components import components
from tidewatch.llm.simhash import links as fingerprint_links
from tidewatch.llm.simhash import majority
from tidewatch.llm.texts import add_result, fresh
from tidewatch.session import checkpointed, drop_checkpoints, tables_written, with_tasks

with_tasks(__name__)

SHINGLE, SEED = 5, 42
# Similarity as a fraction: 4 / 5.
PART, WHOLE = 4, 5
ROWS, BANDS = 5, 32
# Pivots of a bucket's largest group that are tried, after the bucket's own, on what is apart from it.
# Each costs a join of shingles; with three, a table with one very large group took too much disk.
PIVOTS = 0
# Classes of size within the ratio that sizes of similar sets may have.
FINE = 4
CHUNK = 1 << 15
NO_ID = (1 << 63) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers in which all bits depend on each other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    rolled = np.full(count, width, np.uint64)
    for i in range(width):
        rolled = mixed(rolled * STEP + hashes[i:i + count])
    return np.unique(rolled)


def factors() -> tuple[np.ndarray, np.ndarray]:
    """A number to add and an odd number to multiply with, for each minimum."""
    numbers = mixed(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * STEP)
    return numbers[::2], numbers[1::2] | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ROWS * BANDS minima per set; sets are not empty."""
    plus, times = factors()
    out = np.full((len(sets), len(plus)), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= CHUNK):
            size, last = size + len(sets[last]), last + 1
        group = sets[first:last]
        starts = np.cumsum([0, *[len(s) for s in group[:-1]]])
        # Only a set that is a group of its own is longer than a chunk.
        flat = group[0] if len(group) == 1 else np.concatenate(group)
        for at in range(0, len(flat), CHUNK):
            part = flat[at:at + CHUNK]
            for k in range(len(plus)):
                least = np.minimum.reduceat((part ^ plus[k]) * times[k], starts if at == 0 else [0])
                out[first:last, k] = np.minimum(out[first:last, k], least)
        first = last
    return out


def band_keys(sets: list[np.ndarray]) -> list[list[int]]:
    """BANDS signed numbers per set; none for an empty set."""
    full = [s for s in sets if len(s)]
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS))
    found = minima(full).reshape(len(full), BANDS, ROWS)
    for r in range(ROWS):
        keys = mixed(keys * STEP + found[:, :, r])
    rows = iter(keys.view(np.int64).tolist())
    return [next(rows) if len(s) else [] for s in sets]


FOUND = T.StructType([T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
                      T.StructField("n", T.LongType()), T.StructField("bits", T.LongType()),
                      T.StructField("keys", T.ArrayType(T.LongType()))])
BODY = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])


def add_sets(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """All rows with a struct column: two hashes of the shingle set, its size, its fingerprint and its band keys."""
    name = fresh(docs, "shingle_set")

    def start():
        def compute(texts):
            sets = [shingle_set(t) for t in texts]
            digests = np.array([[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets],
                               np.uint64).reshape(-1, 2).view(np.int64)
            return [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([majority(s[at:at + CHUNK] for at in range(0, len(s), CHUNK)) for s in sets], pa.int64()),
                    pa.array(band_keys(sets), pa.list_(pa.int64()))]
        return compute

    return add_result(docs, text, FOUND, name, start), name


def add_shingles(rows: DataFrame, text: str) -> DataFrame:
    """Rows (node, text) as (node, shingles)."""
    def start():
        def compute(texts):
            sets = [shingle_set(t) for t in texts]
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
            return [pa.ListArray.from_arrays(ends, pa.array(flat))]
        return compute

    return add_result(rows, text, BODY, "body", start).select("node", F.col("body")["shingles"].alias("shingles"))


def confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb), sizes in any order, whose sets (node, shingles) are similar enough.

    Pairs are written first: few of them then bring few sets together."""
    pairs = checkpointed(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    near = bodies.join(ends, "node", "left_semi")
    left = near.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = near.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return (pairs.join(left, "a").join(right, "b")
            .where(common * (PART + WHOLE) >= PART * (F.col("na") + F.col("nb"))).select("a", "b"))


def ordered(x: str, y: str, low: str, high: str) -> list[F.Column]:
    return [F.least(x, y).alias(low), F.greatest(x, y).alias(high)]


def size_step(n: str, parts: int = 1) -> F.Column:
    """Steps of the ratio that sizes of similar sets may have: theirs are equal or neighbours. With
    ``parts``, each step is cut into as many."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(WHOLE / PART)) * parts + 1e-9).cast("int")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (node, n, pivot, np) that connect all sets whose fingerprints are within 2 bits."""
    prints = checkpointed(sets.groupBy("bits").agg(F.min(F.struct("node", "n")).alias("first"))
                          .select("bits", F.col("first.node").alias("pivot"), F.col("first.n").alias("np")))
    equal = sets.join(prints, "bits").where("node <> pivot").select("node", "n", "pivot", "np")
    left = prints.select(F.col("bits").alias("a"), F.col("pivot").alias("node"), F.col("np").alias("n"))
    near = fingerprint_links(prints.select("bits")).join(left, "a").join(prints.withColumnRenamed("bits", "b"), "b")
    return equal.union(near.select("node", "n", "pivot", "np"))


def rare_shingles(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """``nodes`` (node, n, ...) with a row for each shingle that a set as large as theirs may have in
    common first, rare shingles before frequent ones; ``after`` counts it and those that follow and
    stand in other sets too. Sets with too few such shingles have no row."""
    held = bodies.join(nodes.select("node"), "node").select("node", F.explode("shingles").alias("shingle"))
    sharers = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("sharers")).where("sharers > 1")
    # One set's shingles at a time, so no longer than one text.
    order = held.join(sharers, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sharers", "shingle"))).alias("order"))
    count = F.size("order").cast("bigint")
    early = F.slice("order", F.lit(1), F.greatest(count - F.ceil(F.col("n") * PART / WHOLE) + 1, F.lit(0)).cast("int"))
    rows = nodes.join(order, "node").select(*nodes.columns, count.alias("count"), F.posexplode(early).alias("nth", "s"))
    return rows.select(*nodes.columns, F.col("s.shingle").alias("shingle"), (F.col("count") - F.col("nth")).alias("after"))


def long_enough(common: F.Column, other: F.Column) -> F.Column:
    """Whether so many common shingles are enough for sets of ``n`` and ``other``."""
    return common * (PART + WHOLE) >= PART * (F.col("n") + other)


def rare_pairs(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (node, n, pivot, np) of different groups that may be similar by their rarest shingles.

    ``nodes`` has node, n, root and size of its group and whether it is apart from some larger group."""
    rows = checkpointed(rare_shingles(nodes, bodies).withColumn("own", size_step("n", FINE)))
    # A row for each class of sizes for which what follows a shingle is long enough.
    steps = F.sequence(F.col("own") - FINE - 1, F.col("own") + FINE + 1)
    fits = F.filter(steps, lambda q: long_enough(F.col("after"), F.pow(F.lit(WHOLE / PART), q / FINE) * (1 - 1e-6)))
    rows = rows.withColumn("other", F.explode(fits))
    x = rows.where("apart").select("shingle", "own", "other", "node", "n", F.col("after").alias("ax"),
                                   F.col("root").alias("rx"), F.col("size").alias("gx"))
    y = rows.select("shingle", F.col("other").alias("own"), F.col("own").alias("other"), F.col("node").alias("pivot"),
                    F.col("n").alias("np"), F.col("after").alias("ay"), F.col("root").alias("ry"), F.col("size").alias("gy"))
    return (x.join(y, ["shingle", "own", "other"])
            .where((F.struct("gx", "rx") < F.struct("gy", "ry")) & long_enough(F.least("ax", "ay"), F.col("np")))
            .select("node", "n", "pivot", "np"))


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar sets that share a band key or have like fingerprints.

    ``sets`` has node, n, bits, keys and (id, h1, h2) of one of its documents; ``docs`` has id, h1,
    h2 and t. Only texts of sets that are compared are turned into shingles again."""
    near = checkpointed(fingerprint_pairs(sets))
    spread = sets.select("node", "n", F.explode("keys").alias("key"))
    full = spread.groupBy("key").agg(F.count(F.lit(1)).alias("full")).where("full > 1")
    shared = checkpointed(spread.join(full, "key"))
    weight = shared.groupBy("node").agg(F.sum("full").alias("weight"))
    middle = F.max_by(F.struct("node", "n"), F.struct("weight", F.xxhash64("key", "node"), "node"))
    buckets = shared.join(weight, "node").groupBy("key").agg(middle.alias("pivot")).select(
        "key", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("np"))
    members = checkpointed(shared.drop("full").join(buckets, "key").where("node <> pivot"))
    ends = members.select("node").union(members.select("pivot")).union(near.select("node")).union(near.select("pivot")).distinct()
    wanted = checkpointed(sets.join(ends, "node").select("node", "id", "h1", "h2"))
    here = Window.partitionBy("id", "h1", "h2").orderBy("node")
    texts = docs.join(wanted, ["id", "h1", "h2"]).withColumn("nth", F.row_number().over(here)).where("nth = 1")
    bodies = checkpointed(add_shingles(texts.select("node", "t"), "t"))

    # Sets are no more alike than their sizes are.
    alike = F.least("na", "nb") * WHOLE >= F.greatest("na", "nb") * PART

    def compared(x: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """Similar ones of pairs (node, n, pivot, np), which may come from several buckets, but for
        those with one root already."""
        pairs = x.select(*ordered("node", "pivot", "a", "b"), *ordered("n", "np", "na", "nb")).where(alike).distinct()
        if roots is not None:
            pairs = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
            pairs = pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "na", "nb")
        return confirmed(pairs, bodies)

    found = checkpointed(compared(near))
    found = checkpointed(found.union(compared(members, components(found))))
    for nth in range(PIVOTS + 1):
        roots = components(found)
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        placed = members.join(roots.join(sizes, "root"), "node", "left").select(
            "key", "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
        apart = (placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("size", "root")).alias("most"))
                 .where("r0 <> r1").select("key", F.col("most.root").alias("main")))
        others = checkpointed(placed.join(apart, "key"))
        if others.isEmpty():
            return found
        if nth == PIVOTS:
            break
        # Another pivot of the largest group, with which only sets outside that group are compared.
        turn = F.struct(F.xxhash64("key", "node", F.lit(nth + 1)), "node", "n")
        pivots = others.where("root = main").groupBy("key").agg(F.min(turn).alias("p")).select(
            "key", F.col("p.node").alias("pivot"), F.col("p.n").alias("np"))
        found = checkpointed(found.union(compared(others.where("root <> main").join(pivots, "key"))))
    nodes = checkpointed(others.groupBy("node", "n", "root", "size").agg(F.bool_or(F.expr("root <> main")).alias("apart")))
    return found.union(compared(rare_pairs(nodes, bodies)))


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h1, h2, root): a row per document; ids as given but for null (``NO_ID``), two hashes
    of the text, and a number that the documents of a group share.

    What is written on the way is dropped once the groups are known."""
    key = F.coalesce(F.col(id_column), F.lit(NO_ID)).alias("id")
    plain = docs.select(key, *text_hashes(text), F.col(text).alias("t"))
    named, name = add_sets(plain, "t")
    rows = checkpointed(named.select("id", "h1", "h2", *[F.col(name)[f].alias(f) for f in FOUND.names]))
    one = F.min(F.struct("id", "h1", "h2")).alias("doc")
    mark = tables_written()
    sets = rows.groupBy("s1", "s2").agg(*[F.first(c).alias(c) for c in ("n", "bits", "keys")], one)
    sets = checkpointed(sets.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "bits", "keys", "doc.*"))
    roots = components(links(sets, plain))
    until = tables_written()
    placed = checkpointed(sets.select("node", "s1", "s2").join(roots, "node", "left").select(
        "s1", "s2", F.coalesce("root", "node").alias("root")))
    drop_checkpoints(docs.sparkSession, mark, until)
    return rows.select("id", "h1", "h2", "s1", "s2").join(placed, ["s1", "s2"]).select("id", "h1", "h2", "root")


def text_hashes(text: str) -> list[F.Column]:
    return [F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")]


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with: the one with the smallest
    id. Texts move once, by id and hashes."""
    keepers = (groups(docs, id_column, text).groupBy("root").agg(F.min(F.struct("id", "h1", "h2")).alias("k"))
               .select("k.id", "k.h1", "k.h2"))
    taken = [fresh(docs, n) for n in ("keep_id", "keep_h1", "keep_h2", "keep_nth")]
    keepers = keepers.toDF(*taken[:3])
    h1, h2 = text_hashes(text)
    same = ((F.coalesce(F.col(id_column), F.lit(NO_ID)) == F.col(taken[0])) & (h1 == F.col(taken[1]))
            & (h2 == F.col(taken[2])))
    here = Window.partitionBy(*taken[:3]).orderBy(F.xxhash64(*docs.columns))
    return (docs.join(keepers, same).withColumn(taken[3], F.row_number().over(here))
            .where(F.col(taken[3]) == 1).select(*docs.columns))


def similar(a: bytes | None, b: bytes | None) -> bool:
    """Whether two texts are near copies, from their words; for tests."""
    x, y = (set(zip(*[w[i:] for i in range(min(SHINGLE, len(w)))])) if (w := (t or b"").lower().split()) else set()
            for t in (a, b))
    return len(x & y) * WHOLE >= len(x | y) * PART
