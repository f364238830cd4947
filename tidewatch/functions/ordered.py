"""Ordered folds that split a hot key over many tasks.

A window over one key puts the whole key in one task. Here the rows are cut into
*slices* by a range partitioning on (key, order), so one key may span many slices
and every slice has a bounded size. A fold then runs in three steps:

1. summarise each (slice, key) - small rows, one per slice and key;
2. combine the summaries of a key over its earlier slices;
3. finish each slice with the value carried into it.

At most one key continues from one slice into the next, so the carried rows
number fewer than the slices. That bound is why they may be broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.session import checkpointed, with_tasks

with_tasks(__name__)

SLICE = "_slice"


# A slice holds this many rows at most, give or take the error of the range
# sampling, and small tables are not cut finer than the lower number.
SLICE_ROWS, SMALL_SLICE_ROWS = 2_000_000, 500_000
# Nor does it hold more bytes than this, where the size of a row is given.
SLICE_BYTES = 256 << 20


def slice_count(df: DataFrame, size: Column | None = None) -> int:
    """Slices for a table: as many as its rows and bytes need, else as the session's partitions."""
    rows, held = df.agg(F.count(F.lit(1)), F.sum(F.lit(0) if size is None else size)).first()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // SLICE_ROWS), -(-(held or 0) // SLICE_BYTES), min(partitions, -(-rows // SMALL_SLICE_ROWS)))


def cut(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and record the slice number of each row.

    The result is written once: a recomputed range partitioning may choose other
    bounds, so slice numbers have to be on record before they are used. Without
    ``slices`` the number follows from a count of the rows. Pass only the columns that
    are needed: the finishing step of a chain holds one slice in memory.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(slices or slice_count(df), *by)
    return checkpointed(ranged.withColumn(SLICE, F.spark_partition_id()))


def _carry(cut_df: DataFrame, keys: list[str], carried: DataFrame, columns: list[str]) -> DataFrame:
    """Left-join the carried rows (fewer than the slices) to the rows of their slice."""
    renamed = carried.select(F.col(SLICE).alias("_cs"), *[F.col(k).alias(f"_ck_{k}") for k in keys],
                             *columns)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_ck_{k}")) for k in keys],
                  F.col(SLICE) == F.col("_cs"))
    joined = cut_df.join(F.broadcast(renamed), same, "left")
    return joined.drop("_cs", *[f"_ck_{k}" for k in keys])


def running(cut_df: DataFrame, keys: list[str], order: list[str],
            sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None,
            previous: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """Add running values to a cut table, per key and in order.

    ``sums``: total up to and including the row. ``lasts``: last non-null value up
    to and including the row. ``previous``: array of up to n values of the rows
    just before it, oldest first.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    inputs = {f"_in_{n}": c for n, c in {**sums, **lasts}.items()}
    inputs |= {f"_in_{n}": c for n, (c, _) in previous.items()}
    df = cut_df.withColumns(inputs)
    position = F.struct(*order)

    parts = [F.sum(f"_in_{n}").alias(f"_p_{n}") for n in sums]
    parts += [F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_p_{n}")
              for n in lasts]
    summary = df.groupBy(SLICE, *keys).agg(F.count(F.lit(1)).alias("_rows"), *parts)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{n}": F.sum(f"_p_{n}").over(before) for n in sums}
    carried |= {f"_c_{n}": F.last(f"_p_{n}", ignorenulls=True).over(before) for n in lasts}
    if previous:
        summary = _with_tails(df, summary, keys, order, previous)
        for n, (_, size) in previous.items():
            near = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(-size, -1)
            rows = F.flatten(F.collect_list(f"_p_{n}").over(near))
            first = F.greatest(F.size(rows) - size + 1, F.lit(1))
            carried[f"_c_{n}"] = F.slice(rows, first, F.lit(size))
    later = F.row_number().over(Window.partitionBy(*keys).orderBy(SLICE))
    offsets = (summary.withColumns({**carried, "_nth": later}).where("_nth > 1")
               .select(SLICE, *keys, *carried))
    df = _carry(df, keys, offsets, list(carried))

    here = Window.partitionBy(SLICE, *keys).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.coalesce(F.sum(f"_in_{n}").over(upto), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
           for n in sums}
    out |= {n: F.coalesce(F.last(f"_in_{n}", ignorenulls=True).over(upto), F.col(f"_c_{n}"))
            for n in lasts}
    for n, (_, size) in previous.items():
        local = F.collect_list(f"_in_{n}").over(here.rowsBetween(-size, -1))
        both = F.when(F.col(f"_c_{n}").isNull(), local).otherwise(F.concat(f"_c_{n}", local))
        out[n] = F.slice(both, F.greatest(F.size(both) - size + 1, F.lit(1)), F.lit(size))
    return df.withColumns(out).drop(*inputs, *carried)


def _with_tails(df: DataFrame, summary: DataFrame, keys: list[str], order: list[str],
                previous: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add the last n values of each (slice, key), oldest first."""
    size = max(n for _, n in previous.values())
    backwards = Window.partitionBy(SLICE, *keys).orderBy(*[F.col(c).desc() for c in order])
    ends = df.withColumn("_back", F.row_number().over(backwards)).where(F.col("_back") <= size)
    aggs = [F.transform(F.sort_array(F.collect_list(F.when(F.col("_back") <= n,
                                                           F.struct((-F.col("_back")).alias("b"),
                                                                    F.col(f"_in_{name}").alias("v"))))),
                        lambda s: s["v"]).alias(f"_p_{name}")
            for name, (_, n) in previous.items()]
    tails = ends.groupBy(SLICE, *keys).agg(*aggs)
    pick = [F.col(f"t._p_{n}") for n in previous]
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys],
                  F.col(f"s.{SLICE}") == F.col(f"t.{SLICE}"))
    return summary.alias("s").join(tails.alias("t"), same).select("s.*", *pick)


# --------------------------------------------------------------------------- chains

_FAR = np.iinfo(np.int64).max


def chain(cut_df: DataFrame, keys: list[str], order: list[str], coord: str, width: int,
          payload: list[str] = (), force: str | None = None, opens: str | None = None) -> DataFrame:
    """Mark the anchors of a resetting window and give each row its anchor.

    The first row of a key is an anchor; the next anchor is the first later row
    whose ``coord`` (a whole number that never falls in order) is more than
    ``width`` above the current anchor's, or whose ``force`` flag is set. Rows with
    ``opens`` false are never anchors. Adds ``is_anchor``, ``anchor_before`` (coord of
    the anchor the row found), ``anchor`` (coord of the one it left) and
    ``anchor_<p>`` for each whole-number payload column.

    Where a chain stands after a slice depends on where it stood before it. For a key that
    goes on over several slices, each slice reports *steps*: rows that say which anchor it
    is left with, if the one it is entered with lies below a bound. A step's exit leads to
    the first later step whose bound is more than ``width`` above it; these links are found
    in one ordered pass and followed by doubling. What reaches a slice is one row per key.
    This is exact at any key size, and no group of rows is collected for a key.
    """
    payload = list(payload)
    flags = [c for c in (force, opens) if c]
    narrow = cut_df.select(SLICE, *dict.fromkeys([*keys, *order, coord, *payload, *flags]))
    key_schema = [f for f in cut_df.schema if f.name in keys]
    state = [f"_x{i}" for i in range(1 + len(payload))]
    step_schema = T.StructType([
        T.StructField(SLICE, T.IntegerType()), *key_schema, T.StructField("_node", T.LongType()),
        T.StructField("_hi", T.LongType()), *[T.StructField(x, T.LongType()) for x in state]])
    sort_by = [(c, "ascending") for c in dict.fromkeys([*keys, *order])]

    def arrays(segment: pa.Table):
        c = segment[coord].to_numpy().astype(np.int64)
        links = _links(c, width, _flag(segment, force), _flag(segment, opens))
        values = [c, *[segment[p].to_numpy().astype(np.int64) for p in payload]]
        return c, links, values

    def summarise(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by(sort_by)
        number, found, node = key[0].as_py(), [], 0
        # Only the first and the last key of a slice can go on in another one.
        for segment in _edges(part, keys):
            c, (start, following, first_forced), values = arrays(segment)
            hi, exits, first = _exit_steps(c, width, start, following, first_forced)
            rows = len(hi) + 1
            # The row without a bound tells where a chain stands that begins in this slice.
            exits = np.append(exits, first)
            left = [pa.array(np.append(v, 0)[exits], mask=exits == len(c)) for v in values]
            nodes = number * (1 << 32) + node + np.arange(rows)
            node += rows
            found.append(pa.Table.from_arrays(
                [pa.array(np.full(rows, number), pa.int32()),
                 *[pa.repeat(segment[k][0], rows).cast(step_arrow.field(k).type) for k in keys], pa.array(nodes),
                 pa.array(np.append(hi, 0), mask=np.arange(rows) == rows - 1), *left], schema=step_arrow))
        return pa.concat_tables(found)

    def finish(key: tuple, part: pa.Table, carried: pa.Table) -> pa.Table:
        part = part.sort_by(sort_by)
        entries = {tuple(r[k] for k in keys): [r[x] for x in state] for r in carried.to_pylist()}
        done = []
        for segment in _segments(part, keys):
            c, (start, following, first_forced), values = arrays(segment)
            entry = entries.get(tuple(segment[k][0].as_py() for k in keys))
            at = 0 if entry is None else min(int(np.searchsorted(c, entry[0] + width, "right")), first_forced)
            mark = np.zeros(len(c), dtype=bool)
            at, nxt = int(start[at]), following.tolist()
            while at < len(c):
                mark[at] = True
                at = nxt[at]
            last = np.maximum.accumulate(np.where(mark, np.arange(len(c)), -1))
            segment = segment.append_column("is_anchor", pa.array(mark))
            found = np.append(-1, last[:-1])
            for at, value, name in zip([found, *[last] * len(values)], [c, *values], added_names[1:]):
                start_value = 0 if entry is None else entry[0 if at is found else added_names.index(name) - 2]
                value = np.where(at >= 0, value[np.maximum(at, 0)], start_value)
                missing = (at < 0) if entry is None else None
                segment = segment.append_column(name, pa.array(value, type=pa.int64(), mask=missing))
            done.append(segment)
        return pa.concat_tables(done).select(out_names)

    step_arrow = to_arrow_schema(step_schema)
    entries = _entries(narrow.groupBy(SLICE).applyInArrow(summarise, step_schema), keys, state, width)
    added_names = ["is_anchor", "anchor_before", "anchor", *[f"anchor_{p}" for p in payload]]
    added = [T.StructField(n, T.LongType() if i else T.BooleanType()) for i, n in enumerate(added_names)]
    out_schema = T.StructType([*cut_df.schema, *added])
    out_names = out_schema.names
    return (cut_df.groupBy(SLICE).cogroup(entries.groupBy(SLICE)).applyInArrow(finish, out_schema))


def _entries(steps: DataFrame, keys: list[str], state: list[str], width: int) -> DataFrame:
    """State with which each (slice, key) is entered; slices that begin a chain have none."""
    here = keys or [F.lit(0).alias("_all")]
    spread = steps.groupBy(*keys).agg(F.countDistinct(SLICE).alias("_n")).where("_n > 1").drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], F.lit(True))
    crossing = steps.alias("s").join(spread.alias("k"), same, "left_semi") if keys else steps
    crossing = checkpointed(crossing)
    if crossing.select(SLICE).distinct().count() < 2:
        return crossing.where(F.lit(False)).select(SLICE, *keys, *state)
    slices = crossing.select(*keys, SLICE).distinct()

    # A forced row reacts to every entry, so bounds rise up to it and begin anew behind it.
    far = crossing.groupBy(*keys, SLICE).agg(F.count(F.when(F.col("_hi") == _FAR, 1)).alias("_f"))
    upto = Window.partitionBy(*here).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    far = far.withColumn("_after", F.sum("_f").over(upto)).withColumn("_within", F.col("_after") - F.col("_f"))
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys],
                  F.col(f"s.{SLICE}") == F.col(f"f.{SLICE}"))
    placed = crossing.alias("s").join(far.alias("f"), same).select("s.*", "_after", "_within")
    first = Window.partitionBy(*here).orderBy(SLICE)
    begins = placed.where(F.col("_hi").isNull() & F.col(state[0]).isNotNull()).withColumn(
        "_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    known = placed.where(F.col("_hi").isNotNull())

    # From the highest value down, a row is led to the last step it has passed.
    bounds = known.select(*keys, F.col("_within").alias("_part"), (-F.col("_hi")).alias("_v"), F.lit(1).alias("_kind"), "_node")
    exits = known.unionByName(begins).select(
        *keys, F.col("_after").alias("_part"), (-(F.col(state[0]) + width)).alias("_v"), F.lit(0).alias("_kind"), "_node")
    # Of equal bounds the earliest counts, which is passed last.
    order = ["_v", "_kind", "_turn"]
    both = bounds.union(exits).withColumn("_turn", -F.col("_node"))
    led = running(cut(both, [*keys, "_part"], order), [*keys, "_part"], order,
                  lasts={"_to": F.when(F.col("_kind") == 1, F.col("_node"))})
    links = checkpointed(led.where((F.col("_kind") == 0) & F.col("_to").isNotNull()).select("_node", "_to"))

    visited = checkpointed(begins.select("_node"))
    count = visited.count()
    while True:
        ahead = visited.join(links, "_node").select(F.col("_to").alias("_node"))
        visited = checkpointed(visited.union(ahead).distinct())
        more = visited.count()
        if more == count:
            break
        count = more
        links = checkpointed(links.alias("a").join(links.alias("b"), F.col("a._to") == F.col("b._node"))
                             .select("a._node", "b._to"))
    left = known.unionByName(begins).join(visited, "_node").select(*keys, SLICE, F.struct(*state).alias("_s"))
    marks = slices.withColumn("_s", F.lit(None).cast(left.schema["_s"].dataType)).union(left)
    marks = marks.groupBy(*keys, SLICE).agg(F.first("_s", ignorenulls=True).alias("_s"))
    before = Window.partitionBy(*here).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    entered = marks.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).where(F.col("_s").isNotNull())
    return entered.select(SLICE, *keys, "_s.*")


def _flag(segment: pa.Table, name: str | None) -> np.ndarray | None:
    return None if name is None else np.asarray(segment[name].fill_null(False).to_numpy(), dtype=bool)


def _starts(part: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys of a sorted table."""
    if not keys:
        return np.array([0])
    frame = part.select(keys).to_pandas()
    changed = np.zeros(len(frame), dtype=bool)
    for k in keys:
        column = frame[k]
        changed |= ((column != column.shift()) & ~(column.isna() & column.shift().isna())).to_numpy()
    changed[0] = True
    return np.flatnonzero(changed)


def _segments(part: pa.Table, keys: list[str]):
    """The runs of equal keys of a sorted table."""
    if part.num_rows:
        starts = _starts(part, keys)
        for lo, hi in zip(starts, [*starts[1:], part.num_rows]):
            yield part.slice(int(lo), int(hi - lo))


def _edges(part: pa.Table, keys: list[str]) -> list[pa.Table]:
    """The first and the last run of equal keys."""
    starts = [*_starts(part, keys).tolist(), part.num_rows]
    ends = [(starts[0], starts[1]), (starts[-2], starts[-1])]
    return [part.slice(lo, hi - lo) for lo, hi in dict.fromkeys(ends)]


def _links(c: np.ndarray, width: int, force: np.ndarray | None, opens: np.ndarray | None):
    """(row an opening at i falls on, anchor after i, first forced row); n means none."""
    n = len(c)
    following = np.searchsorted(c, c + width, "right")
    first_forced = n
    if force is not None:
        spots = np.flatnonzero(force)
        first_forced = int(spots[0]) if len(spots) else n
        later = np.append(spots, n)[np.searchsorted(spots, np.arange(n), "right")]
        following = np.minimum(following, later)
    start = np.arange(n + 1)
    if opens is not None:
        spots = np.flatnonzero(opens)
        start = np.append(spots, n)[np.searchsorted(spots, np.arange(n + 1), "left")]
    return start, start[following], first_forced


def _exit_steps(c: np.ndarray, width: int, start: np.ndarray, following: np.ndarray, first_forced: int):
    """Bounds and last anchors of a slice's steps, and the last anchor of a chain begun in it.

    A step holds while ``entry + width`` is below its bound and not below the one before.
    Entries that none of the rows react to have no step."""
    n = len(c)
    last = np.append(np.where(following < n, following, np.arange(n)), n)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    reach = int(np.searchsorted(c, c[0] + width, "right"))
    exits = last[start[np.minimum(np.arange(reach + 1), first_forced)]]
    ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    ends = ends[exits[ends] < n]
    return np.append(c, _FAR)[ends], exits[ends], int(last[start[0]])
