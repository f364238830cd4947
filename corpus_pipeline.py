"""From documents to token ids: five stages, each over all that the one before kept.

Toxic documents go, boilerplate lines are taken out of the texts, one document of each
group of near-duplicates stays, documents that hold benchmark passages go, and what is
left is encoded. Each stage's rows are written as Parquet in the checkpoint folder and
read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, lines, near_copies, toxicity
from tidewatch.llm.queries import VOCABULARY
from tidewatch.session import checkpointed
from tidewatch.sources.tables import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half, by a model learned from the labels of ``sf_dir``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that stand on many sites, and not in copies of a few texts only, are
    out of their texts."""
    stripped, _, removed = lines.strip_boilerplate(docs, least_texts=lines.LEAST_TEXTS)
    length = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return stripped.withColumn("n_chars", length).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that are alike by 0.8 or more in their
    five-word shingles. SimHash fingerprints of these shingles, linked by op1's covering hashing, come
    first, MinHash reaches what differs in more than two bits; the exact similarity decides."""
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text they decode to."""
    return bpe.round_trip(docs, VOCABULARY, keep_ids=True)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_stage), ("simhash", simhash_stage),
          ("decontamination", decontamination_stage), ("bpe", bpe_stage)]

# A trained score decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
CHECKS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
