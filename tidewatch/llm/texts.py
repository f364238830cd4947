"""Texts as bytes in Arrow batches, their words, and rows passed through Python with new columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.session import with_tasks

with_tasks(__name__)

# Rows go to Python in batches of about this many bytes, and are handled in pieces of about
# this many bytes of text, whole texts each.
BATCH_BYTES, PIECE_BYTES = 8 << 20, 4 << 20


def _fold() -> tuple[bytes, bytes]:
    """Byte tables: A-Z to a-z, and the same with every other ASCII sign but 0-9 as a space."""
    lower = bytes(range(256)).lower()
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 256))
    return lower, bytes(b if b in keep else 0x20 for b in lower)


LOWER, ALNUM = _fold()


def space_words(text: bytes) -> list[bytes]:
    """Words between white space (0x20, 0x09-0x0D)."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of a-z, 0-9 and non-ASCII characters."""
    return text.translate(ALNUM).split()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def pieces(texts: list[bytes | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of about ``limit`` bytes of text; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def bound_batches(df: DataFrame) -> None:
    """Texts are long: the engine's own limit on a batch is more than a worker should hold."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def add_result(df: DataFrame, column: str, result: T.StructType, name: str,
               start: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]]) -> DataFrame:
    """Append the struct column ``name``, computed from the texts in ``column``.

    ``start`` is called once per task and gives a function from a list of texts (UTF-8
    or None) to one Arrow array per field. Rows stay where they are: no shuffle.
    """
    bound_batches(df)
    out = T.StructType([*df.schema.fields, T.StructField(name, result)])
    arrow, at = to_arrow_schema(out), df.columns.index(column)
    kind = arrow.field(len(arrow) - 1).type

    def run(batches):
        compute = start()
        for batch in batches:
            texts = as_bytes(batch.column(at))
            for lo, hi in pieces(texts):
                parts = compute(texts[lo:hi])
                cells = pa.StructArray.from_arrays(
                    [p.cast(f.type) for p, f in zip(parts, kind)], fields=list(kind))
                rest = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[c.cast(f.type) for c, f in zip(rest.columns, arrow)], cells], schema=arrow)

    return df.mapInArrow(run, out)
