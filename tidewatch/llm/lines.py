"""Boilerplate lines: lines that stand on many different sites.

Every line hash gets a HyperLogLog sketch of the sites it occurs on. Sketches merge by
aggregation, partly before the shuffle, so a line that stands in a third of all rows
costs one small sketch per task. Where the estimate is clearly under or over the
threshold it decides; lines near it get an exact count of distinct sites.

A line can also be asked to stand in a number of distinct texts (``least_texts``), counted
in the same way, so that the copies of one text, on however many sites, mark none of its
lines. The pipeline asks for it; the statement of op4 counts sites only.

A line is the text between line feeds, without spaces, tabs and carriage returns at its
ends; lines that are empty then are always kept. Lines are told apart by a 64-bit hash
and their length. Rows without a site count for none. A null text stays null and has no
lines. All occurrences of a boilerplate line are removed, the other lines stay in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.texts import fresh
from tidewatch.session import checkpointed

LEAST_SITES = 10
# Distinct texts that a line has to stand in where copies must not count (the pipeline).
LEAST_TEXTS = 10
# Sketches of 2^12 registers are within 1.6 percent in two cases of three; a line within
# eight times that of the threshold is counted exactly.
REGISTERS, NEAR = 12, 0.13
BLANK = " \t\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def line_key(line: Column) -> Column:
    """Hash and length of a line; null for an empty one."""
    body = trimmed(line)
    return F.when(body != "", F.struct(F.xxhash64(body).alias("hash"), F.octet_length(body).alias("size")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(lines: DataFrame, site: str = "site", least: int = LEAST_SITES, least_texts: int = 1) -> DataFrame:
    """Keys (hash, size) of the lines on ``least`` sites or more and in ``least_texts`` distinct
    texts or more. ``lines`` has hash, size, text_key and site."""
    known = lines.where(F.col(site).isNotNull())
    # What is sketched, what is counted, and the threshold; any line stands in one text.
    measures = {"sites": (F.col(site), site, least)}
    if least_texts > 1:
        measures["texts"] = (F.col("text_key")["h1"], "text_key", least_texts)
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(REGISTERS))).alias(n) for n, (c, _, _) in measures.items()]
    rough = known.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), *sketches)
    # Fewer rows than the threshold can't stand on that many sites; most lines end here.
    for name, (_, _, most) in measures.items():
        rough = rough.where((F.col("n") >= most) & (F.col(name) >= most * (1 - NEAR)))
    found = checkpointed(rough)
    for name, (_, column, most) in measures.items():
        sure = found.where(F.col(name) > most * (1 + NEAR))
        near = found.where(F.col(name) <= most * (1 + NEAR))
        pairs = known.join(near, ["hash", "size"], "left_semi").groupBy("hash", "size", column).agg(F.lit(1))
        exact = pairs.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= most)
        found = sure.union(near.join(exact.select("hash", "size"), ["hash", "size"]).select(*found.columns))
    return found.select("hash", "size")


def strip_boilerplate(docs: DataFrame, least: int = LEAST_SITES, text: str = "text",
                      site: str = "source", least_texts: int = 1) -> tuple[DataFrame, str, str]:
    """All rows with the boilerplate lines taken out of the text, and the names of two more
    columns: lines before, and lines taken out.

    Only hashes are exploded and joined: of the line, and of the text it stands in. A text
    then meets its own boilerplate hashes; equal texts meet one row of them."""
    names = {n: fresh(docs, n) for n in ("n_lines", "n_removed", "bad", "kept", "text_key")}
    text_key = F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2"))
    exploded = (docs.select(text_key.alias("text_key"), F.col(site).cast("string").alias("site"),
                            F.explode(F.transform(lines_of(F.col(text)), line_key)).alias("line"))
                .where(F.col("line").isNotNull())
                .select("text_key", "site", F.col("line.hash").alias("hash"), F.col("line.size").alias("size")))
    exploded = checkpointed(exploded)
    found = checkpointed(boilerplate(exploded, least=least, least_texts=least_texts))
    per_text = (exploded.join(found, ["hash", "size"], "left_semi")
                .groupBy("text_key").agg(F.collect_set(F.struct("hash", "size")).alias(names["bad"]))
                .withColumnRenamed("text_key", names["text_key"]))
    joined = docs.join(per_text, text_key == F.col(names["text_key"]), "left")
    lines = lines_of(F.col(text))
    touched = F.col(names["bad"]).isNotNull()
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(names["bad"], line_key(line)), F.lit(False)))
    joined = joined.withColumn(names["kept"], F.when(touched, kept))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    joined = joined.withColumns({
        names["n_lines"]: n_lines.cast("bigint"),
        names["n_removed"]: F.when(touched, F.size(lines) - F.size(names["kept"])).otherwise(0).cast("bigint")})
    joined = joined.withColumn(text, F.when(touched, F.array_join(names["kept"], "\n")).otherwise(F.col(text)))
    return joined.select(*docs.columns, names["n_lines"], names["n_removed"]), names["n_lines"], names["n_removed"]


def line_report(docs: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """A row per document: lines, lines removed, digest of the text that is left."""
    stripped, lines, removed = strip_boilerplate(docs.select("doc_id", "text", "source"), least)
    left = F.coalesce(F.col("text"), F.lit(""))
    return stripped.select("doc_id", lines, removed, F.sha2(left.cast("binary"), 256).alias("kept_sha256"))
