"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint bit is set if more than half of a text's shingle hashes have it set. Two
fingerprints within the radius r are found by 2^(r+1) - 1 tables. Every bit position gets
a non-zero vector of r+1 bits; the table of a non-zero vector v looks at the positions
whose vector has an odd product with v. The at most r positions in which a pair differs
span less than the whole space, so some v is orthogonal to all of them, and in its table
the pair falls into one bucket: no pair within the radius is missed.

Equal fingerprints are one row before the search. In buckets up to a stated size all
pairs are compared. In larger ones no pairs are formed: each fingerprint writes down
itself and its neighbours at distance one, and fingerprints that share such a point are
linked to the smallest of them. For the radius 2 this is exact too: two fingerprints are
within 2 bits if and only if some point is within 1 bit of both.

Fewer words than a shingle make one shingle; no words (or a null text) make fingerprint
zero, which is linked like any other. A null id is larger than every other id.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.components import components
from tidewatch.llm.texts import add_result, fresh
from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

SHINGLE, SEED, RADIUS = 3, 42, 2
# Distinct fingerprints in a bucket up to which pairs are compared.
PAIRED = 48
CHUNK = 1 << 16
NO_ID = (1 << 63) - 1


def shingles(words: list[bytes], width: int = SHINGLE) -> list[bytes]:
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """A signed number with the bits that more than half of the hashes, given in parts, have set."""
    counts, total = np.zeros(64, np.int64), 0
    for part in hashes:
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts, total = counts + bits.sum(axis=0, dtype=np.int64), total + len(part)
    value = np.packbits(2 * counts > total, bitorder="little")
    return int(value.view(np.int64)[0])


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64 bits as a signed number."""
    found = shingles((text or b"").lower().split(), width)
    parts = (found[at:at + CHUNK] for at in range(0, len(found), CHUNK))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part)) for part in parts)


def add_fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> tuple[DataFrame, str]:
    """All rows with a struct column holding ``bits``, and its name. No shuffle."""
    name = fresh(docs, "simhash")

    def start():
        return lambda texts: [pa.array([fingerprint(t, width) for t in texts], pa.int64())]

    return add_result(docs, text, T.StructType([T.StructField("bits", T.LongType())]), name, start), name


def masks(radius: int = RADIUS) -> list[int]:
    """One mask of 64 bits (signed) per table."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(64)]
    out = []
    for v in range(1, size):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``bits`` within 2 bits."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(masks())])
    rows = prints.select("bits", F.explode(tables).alias("e")).select("bits", "e.t", "e.key")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = checkpointed(rows.join(sizes, ["t", "key"]))
    few = sized.where(F.col("n") <= paired)
    a = few.select("t", "key", F.col("bits").alias("a"))
    b = few.select("t", "key", F.col("bits").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    many = sized.where(F.col("n") > paired).select("bits").distinct()
    signed = [(1 << i) - ((1 << 64) if i == 63 else 0) for i in range(64)]
    points = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(s)) for s in signed])
    around = many.select("bits", F.explode(points).alias("point"))
    least = around.groupBy("point").agg(F.min("bits").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = around.join(least, "point").where("bits <> b").select(F.col("bits").alias("a"), "b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bits, component, root): a row per document, ids as given but for null (``NO_ID``).

    ``component`` is the smallest id that can be reached by links; several groups can have
    the same one. ``root`` is the smallest fingerprint of the group and tells groups apart."""
    named, name = add_fingerprints(docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")), "t")
    key = F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id")
    rows = checkpointed(named.select(key, F.col(name)["bits"].alias("bits")))
    prints = checkpointed(rows.groupBy("bits").agg(F.min("id").alias("least")))
    roots = components(links(prints.select("bits")))
    rooted = prints.join(roots, prints["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    placed = rooted.join(smallest, "root").select("bits", "component", "root")
    return rows.join(placed, "bits").select("id", "bits", "component", "root")


def hex_bits(bits: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(bits)), 16, "0"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """A row per document: fingerprint and the smallest id of its group."""
    found = near_duplicates(docs)
    given = [F.nullif(F.col(c), F.lit(NO_ID)).alias(n) for c, n in (("id", "doc_id"), ("component", "component_id"))]
    return found.select(given[0], hex_bits("bits").alias("fingerprint"), given[1])


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with: the one with the smallest
    id. Texts move once, by id and fingerprint."""
    found = near_duplicates(docs, id_column, text)
    keepers = found.groupBy("root").agg(F.min(F.struct("id", "bits")).alias("k")).select("k.id", "k.bits")
    named, name = add_fingerprints(docs, text)
    taken = [fresh(named, n) for n in ("keep_id", "keep_bits", "keep_nth")]
    keepers = keepers.toDF(*taken[:2])
    same = (F.coalesce(F.col(id_column), F.lit(NO_ID)) == F.col(taken[0])) & (F.col(name)["bits"] == F.col(taken[1]))
    order = [F.xxhash64(*docs.columns)]
    here = Window.partitionBy(*taken[:2]).orderBy(*order)
    return (named.join(keepers, same).withColumn(taken[2], F.row_number().over(here))
            .where(F.col(taken[2]) == 1).select(*docs.columns))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """(id, fingerprint, component) by comparing all pairs; for tests."""
    bits = [fingerprint(None if t is None else t.encode()) & ((1 << 64) - 1) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= RADIUS and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = reduce(lambda d, p: d | {p[0]: min(p[1], d.get(p[0], p[1]))},
                   zip(group, (r[0] for r in rows)), {})
    return [(r[0], f"{b:016x}", least[g]) for r, b, g in zip(rows, bits, group)]
