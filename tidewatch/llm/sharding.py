"""Shards of equal row counts in which every source has its share.

Proportional stratified interleaving: the rows of a source are put in a seeded random
order and numbered r = 0, 1, ...; the fractional rank of a row is (r + 1/2) / rows of its
source. Sorted by fractional rank, any stretch of the table holds every source in
proportion, so cutting the sequence into equal counts gives shards that all match the
mixture. This is the law ``rows``: shard sizes differ by one row at most. Equal texts are
not kept together, as that could break the counts.

No window holds a whole source or the whole table. Random ranks are even, so their leading
digits cut a source into buckets of bounded size, and fractional ranks do the same for
the table; a row's number is the count before its bucket plus its place in the bucket.

Null sources are a source of their own. Null texts have no bytes and checksum 0. Rows
that are equal in all of id, text checksum and size may take each other's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpointed

SHARDS, SEED = 24, 17
# Rows that one task numbers, give or take the chance of the hash.
BUCKET_ROWS = 100_000
# Running counts over buckets are taken in two steps of so many buckets.
STRIDE = 2_048


def before(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Add ``before``, the rows in earlier buckets of the same keys, to (keys, bucket, n).

    Counts are summed within strides of buckets and over strides, so that no task reads
    all buckets of a key."""
    strided = counts.withColumn("stride", F.floor(F.col(bucket) / STRIDE))
    sums = strided.groupBy(*keys, "stride").agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy(*keys).orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "stride", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("whole"))
    within = Window.partitionBy(*keys, "stride").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    strided = strided.withColumn("part", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return (strided.join(sums, [*keys, "stride"])
            .select(*keys, bucket, (F.col("whole") + F.col("part")).alias("before")))


def uniform(digits: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of a hash."""
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") / float(1 << 52)


def interleaved(rows: DataFrame, source: str, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``rank`` (0, 1, ... over the whole table) to rows with a ``digits`` column, the
    random hash by which they are shuffled; ``order`` breaks its ties. ``source`` has no nulls."""
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows"))
    sized = checkpointed(rows.join(sizes, source))
    parts = F.ceil(F.col("rows") / bucket_rows)
    sized = sized.withColumn("slot", F.floor(uniform(F.col("digits")) * parts))
    offsets = before(sized.groupBy(source, "slot").agg(F.count(F.lit(1)).alias("n")), [source], "slot")
    here = Window.partitionBy(source, "slot").orderBy("digits", *order)
    placed = sized.withColumn("place", F.row_number().over(here)).join(offsets, [source, "slot"])
    fraction = (F.col("before") + F.col("place") - 0.5) / F.col("rows")
    ranked = checkpointed(placed.withColumn("fraction", fraction).drop("slot", "before", "place"))

    total = max(1, ranked.count())
    ranked = ranked.withColumn("slot", F.floor(F.col("fraction") * -(-total // bucket_rows)))
    counts = ranked.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    offsets = before(counts, ["all"], "slot").drop("all")
    here = Window.partitionBy("slot").orderBy("fraction", source, "digits", *order)
    return (ranked.withColumn("place", F.row_number().over(here)).join(offsets, "slot")
            .withColumns({"rank": F.col("before") + F.col("place") - 1, "total": F.lit(total)})
            .drop("slot", "before", "place"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id",
                    text: str = "text", source: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row per document: id, size, text_crc32, law, shard, slot (0, 1, ... in the shard)
    and grown_shard, which this law leaves null. Only narrow columns are moved."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        # A sign in front keeps a null source apart from every other one.
        F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"))
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    ranked = interleaved(rows.withColumn("digits", digits), "stratum",
                         ["doc_id", "text_crc32", "size"], bucket_rows)
    # Shard k takes the ranks from ceil(k * total / shards) on.
    shard = F.expr(f"(rank * {shards}) div total")
    start = F.expr(f"(((rank * {shards}) div total) * total + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("rank") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
