"""Scripts of expected texts and patterns, walked through by the chunks of each connection."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.functions.automata import Script, compiled
from tidewatch.functions.links import follow
from tidewatch.functions.ordered import SLICE, slice_count
from tidewatch.operators.requests import first_match
from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

# How a script that is not done is reported.
LATE, WAITING = "More data transfer after finalized", "waiting"


class Walk:
    """One connection inside one slice, from one state or, as a table, from every state."""

    def __init__(self, script: Script, conn, entries):
        self.script, self.conn = script, conn
        # Entries that have come to the same state go on together.
        self.at: dict[int, list[int]] = {e: [e] for e in entries}
        self.hit: dict[int, object] = dict.fromkeys(entries)

    def feed(self, seq, piece: str | None) -> None:
        if not piece:
            return
        moved: dict[int, list[int]] = {}
        for state, entries in self.at.items():
            after, matched = self.script.feed(state, piece)
            if matched:
                self.hit.update(dict.fromkeys(entries, seq))
            moved.setdefault(after, []).extend(entries)
        self.at = moved


def runs_of(chunks: DataFrame, conn: str, seq: str, text: str, script: Script, slices: int | None = None) -> DataFrame:
    """What each slice does to a connection: rows (conn, slice, edge, first, entry, leave, hit).

    The table is cut into slices by a range partitioning on (conn, seq) and read once, in order
    and batch by batch. A connection that begins in a slice has one row, for the start of the
    script; the slice's first one, which may have begun before, has a row for each state it can
    be entered with. ``edge`` marks the first and the last connection of a slice.
    """
    narrow = chunks.select(conn, seq, text)
    count = slices or slice_count(narrow, F.octet_length(text))
    parts = narrow.repartitionByRange(count, conn, seq).sortWithinPartitions(conn, seq)
    schema = T.StructType([
        T.StructField(conn, chunks.schema[conn].dataType), T.StructField(SLICE, T.IntegerType()),
        T.StructField("edge", T.BooleanType()), T.StructField("first", T.BooleanType()),
        T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()),
        T.StructField("hit", chunks.schema[seq].dataType)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        walk, first, number, out = None, True, None, []

        def rows(edge: bool):
            leave = {e: state for state, entries in walk.at.items() for e in entries}
            out.extend((walk.conn, number, edge or first, first, e, leave[e], walk.hit[e]) for e in sorted(leave))

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(3)[0].as_py()
            for name, at, piece in zip(*[c.to_pylist() for c in batch.columns[:3]]):
                if walk is None or walk.conn != name:
                    if walk is not None:
                        rows(False)
                        first = False
                    walk = Walk(script, name, range(script.states) if first and number else (0,))
                walk.feed(at, piece)
            if out:
                yield batch_of()
        if walk is not None:
            rows(True)
            yield batch_of()

    return checkpointed(parts.withColumn(SLICE, F.spark_partition_id()).mapInArrow(run, schema))


def final_states(runs: DataFrame, conn: str) -> DataFrame:
    """Per connection the state it is left in and its last hit: (conn, leave, hit).

    Connections inside one slice are read off. For the others, fewer than there are slices, the
    tables are linked - the state a slice is left in is the one the next is entered with - and
    the links are followed from the first slice.
    """
    inner = runs.where(~F.col("edge")).select(conn, "leave", "hit")
    by_slice = Window.partitionBy(conn).orderBy(SLICE)
    spots = runs.where("edge").select(conn, SLICE).distinct()
    spots = spots.select(conn, SLICE, F.row_number().over(by_slice).alias("nth"), F.lead(SLICE).over(by_slice).alias("next"))
    same = F.col(f"e.{conn}").eqNullSafe(F.col(f"p.{conn}")) & (F.col(f"e.{SLICE}") == F.col(f"p.{SLICE}"))
    edges = runs.where("edge").alias("e").join(spots.alias("p"), same).select("e.*", "nth", "next")

    def node(number: Column, first: Column, state: Column) -> Column:
        return F.shiftleft(number.cast("bigint"), 33) + F.shiftleft(first.cast("bigint"), 32) + state

    edges = checkpointed(edges.withColumns({
        "node": node(F.col(SLICE), F.col("first"), F.col("entry")),
        "to": node(F.col("next"), F.lit(True), F.col("leave"))}))
    begins = edges.where("nth = 1 AND entry = 0").select("node")
    visited = follow(begins, edges.where("next IS NOT NULL").select("node", "to"))
    walked = edges.join(visited, "node", "left_semi").groupBy(conn).agg(
        F.max_by("leave", SLICE).alias("leave"),
        F.max_by("hit", F.when(F.col("hit").isNotNull(), F.col(SLICE))).alias("hit"))
    return inner.unionByName(walked)


def match_script(chunks: DataFrame, conn: str, seq: str, text: str, expected: list[str | re.Pattern],
                 slices: int | None = None) -> DataFrame:
    """Walk each connection through a list of expected texts and patterns.

    Text accumulates until it contains the current text or matches the current pattern, then it
    is cleared and the next one is awaited. Data after the last match is an error. The chunks are
    read once, in order, for any number of steps: an automaton carries over from chunk to chunk,
    and a connection of any length is split into slices that are linked by its states. Empty and
    null texts are no data.
    """
    script = compiled(expected)
    ends = final_states(runs_of(chunks, conn, seq, text, script, slices), conn)
    steps = F.array(*[F.lit(b) for b in script.first[1:]])
    matched = F.size(F.filter(steps, lambda b: b <= F.col("leave")))
    late, done = F.col("leave") == script.late, F.col("leave") >= script.done
    return ends.select(conn, matched.alias("matched"), F.col("hit").alias("done_seq"), (done & ~late).alias("success"),
                       first_match([(late, F.lit(LATE)), (~done, F.lit(WAITING))], F.lit(None).cast("string")).alias("reason"))
