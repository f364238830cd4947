import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# Names the operators use themselves.
CLASHES = ("found", "more", "simhash", "bits", "id", "row", "t", "k", "toxicity", "score", "licenses", "language", "encoded",
           "bad", "kept", "text_key", "n_lines", "n_removed", "site", "hash", "size", "keep_id", "keep_bits", "keep_nth",
           "rank", "total", "y", "u", "spots")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, over several partitions, with every clashing name as a column."""
    def build(rows, parts=3, clash=False):
        from pyspark.sql import functions as F
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clash else df
    return build


LONG = "lorem ipsum dolor sit amet " * 30_000
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One", "b"), (4, "One", "b"), (5, "same text of two rows", "a"),
       (5, "same text of two rows", "a"), (6, "same text of two rows", "c"), (None, "no id here", "b"), (None, None, None),
       (7, LONG, "a"), (8, LONG, "b"), (9, "x" * 200_000, "c"), (10, "é ß 中文 😀 \x00 \x1c", "c")]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
