"""Nested JSON to flat rows and back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.functions.text import script_number
from tidewatch.operators.requests import first_match
from tidewatch.session import with_tasks

with_tasks(__name__)

# Nodes are sent on once their paths have this many signs.
SENT_BYTES = 16 << 20
# Whole numbers below this are shown with all their digits.
SMALL = 1 << 53
# JSON texts that count as absent, so that a path below them makes an object.
ABSENT = ['""', "0", "false", "null"]


# ---------------------------------------------------------------------- unfolding

def json_type(value: Column) -> Column:
    """null, array, object, string, boolean or number; missing values have no type."""
    schema = F.schema_of_variant(value)
    return first_match([
        (value.isNull(), F.lit(None).cast("string")), (schema == "VOID", F.lit("null")),
        (F.startswith(schema, F.lit("ARRAY")), F.lit("array")), (F.startswith(schema, F.lit("OBJECT")), F.lit("object")),
        (schema == "STRING", F.lit("string")), (schema == "BOOLEAN", F.lit("boolean"))], F.lit("number"))


def json_nodes(rows: DataFrame, id_col: str, json_col: str, leaves: bool = False) -> DataFrame:
    """Every node below the top of each record: id, dotted path, type and text value.

    The depth of a record is not known and not limited: each is unfolded by itself, in one pass
    over Arrow batches and without a shuffle, and a record too deep for the common parser is read
    by one with a stack of its own. Unreadable records have no nodes. Of a repeated key the last
    one counts. Half of a surrogate pair becomes a question mark. A node without a name under the
    top is the top. With ``leaves``, containers are left out.
    """
    schema = T.StructType([rows.schema[id_col], *[T.StructField(c, T.StringType()) for c in ("path", "type", "value")]])
    arrow = to_arrow_schema(schema)

    def unfold(batches):
        for batch in batches:
            columns = [], [], [], []
            size = 0
            for key, body in zip(*[c.to_pylist() for c in batch.columns]):
                for node in nodes_of(body, leaves):
                    for column, cell in zip(columns, (key, *node)):
                        column.append(cell)
                    size += len(node[0])
                    if size > SENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
                        columns = [], [], [], []
                        size = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.select(id_col, json_col).mapInArrow(unfold, schema)


def _refuse(name: str):
    raise ValueError(name)


def nodes_of(body: str | None, leaves: bool = False):
    """(path, type, text) of each node below the top of a JSON text; none if it can't be read."""
    try:
        return _loaded_nodes(json.loads(body, parse_constant=_refuse), leaves)
    except RecursionError:
        pass
    except (TypeError, ValueError):
        return ()
    try:
        return parse_nodes(body, leaves)
    except ValueError:
        return ()


def _loaded_nodes(top, leaves: bool):
    todo = [("", top)] if isinstance(top, (dict, list)) else []
    while todo:
        path, node = todo.pop()
        for name, child in node.items() if type(node) is dict else enumerate(node):
            if type(name) is str and not name.isascii():
                name = _utf8(name)
            at = f"{path}.{name}" if path else str(name)
            kind = type(child)
            if kind is dict or kind is list:
                todo.append((at, child))
                if at and not leaves:
                    yield at, "object" if kind is dict else "array", None
            elif at:
                if kind is str:
                    yield at, "string", child if child.isascii() else _utf8(child)
                elif kind is int and -SMALL < child < SMALL:
                    yield at, "number", str(child)
                elif child is None:
                    yield at, "null", None
                elif kind is bool:
                    yield at, "boolean", "true" if child else "false"
                else:
                    yield at, "number", script_number(child)


_SPACE, _NUMBER = re.compile(r"[ \t\n\r]*"), re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": ("boolean", "true"), "false": ("boolean", "false"), "null": ("null", None)}


def _utf8(value: str) -> str:
    return value if value.isascii() else value.encode("utf-8", "replace").decode()


def _scalar(body: str, at: int) -> tuple[str, str | None, int]:
    """(type, text, end) of the scalar that begins at a place."""
    if body.startswith('"', at):
        value, end = scanstring(body, at + 1, True)
        return "string", _utf8(value), end
    for word, (kind, shown) in _WORDS.items():
        if body.startswith(word, at):
            return kind, shown, at + len(word)
    number = _NUMBER.match(body, at)
    if not number:
        raise ValueError(at)
    whole = number[2] is None and number[3] is None and len(number[1]) < 300
    return "number", script_number(int(number[1]) if whole else float(number[0])), number.end()


def parse_nodes(body: str, leaves: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(path, type, text) of each node below the top of a JSON text; of a repeated key the last one.

    One pass with a stack of its own: the depth of a text is not limited. With ``leaves``,
    containers are left out, and no path is written for them."""
    space = lambda p: _SPACE.match(body, p).end()
    # Nodes as (level, name, type, text), a node before those below it. Per open container:
    # its closing sign, and the place of each member among the nodes.
    nodes: list[tuple | None] = []
    open_: list[tuple[str, dict[str, int]]] = []
    name, at = "", space(0)
    while True:
        if open_:
            members = open_[-1][1]
            if name in members:
                # What a key held before goes, with all below it.
                start = members[name]
                level = nodes[start][0]
                nodes[start] = None
                for i in range(start + 1, len(nodes)):
                    if nodes[i] is not None and nodes[i][0] <= level:
                        break
                    nodes[i] = None
            members[name] = len(nodes)
        sign = body[at:at + 1]
        if sign in ("{", "["):
            nodes.append((len(open_), name, "object" if sign == "{" else "array", None))
            open_.append(("}" if sign == "{" else "]", {}))
            at = space(at + 1)
            if not body.startswith(open_[-1][0], at):
                name, at = _next_name(body, at, open_[-1], space)
                continue
        else:
            kind, shown, end = _scalar(body, at)
            nodes.append((len(open_), name, kind, shown))
            at = space(end)
        while open_ and body.startswith(open_[-1][0], at):
            open_.pop()
            at = space(at + 1)
        if not open_:
            break
        if not body.startswith(",", at):
            raise ValueError(at)
        name, at = _next_name(body, space(at + 1), open_[-1], space)
    if at < len(body):
        raise ValueError(at)
    return _with_paths(nodes, leaves)


def _with_paths(nodes: list[tuple | None], leaves: bool):
    names: list[str] = []
    for node in nodes:
        if node is None or not node[0]:
            continue
        level, name, kind, shown = node
        del names[level - 1:]
        names.append(name)
        if not leaves or kind not in ("object", "array"):
            # Empty names next to the top add nothing to a path.
            start = next((i for i, n in enumerate(names) if n), level)
            if start < level:
                yield ".".join(names[start:]), kind, shown


def _next_name(body: str, at: int, container: tuple[str, dict[str, int]], space) -> tuple[str, int]:
    """Name of the next member or item of a container and the place of its value."""
    if container[0] == "]":
        return str(len(container[1])), at
    if not body.startswith('"', at):
        raise ValueError(at)
    name, at = scanstring(body, at + 1, True)
    at = space(at)
    if not body.startswith(":", at):
        raise ValueError(at)
    return _utf8(name), space(at + 1)


def json_to_flat(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Scalar leaves as (id, dotted path, value); empty containers and nulls vanish."""
    return json_nodes(rows, id_col, json_col, leaves=True).where("type <> 'null'")


# ------------------------------------------------------------------------ folding

def json_quote(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def flat_to_json(flat: DataFrame, id_col: str) -> DataFrame:
    """Nested JSON text per id from (id, path, value, ord); values are JSON text.

    The later of two equal paths wins, keys stand in the order they first came, and
    a path below a scalar is dropped unless the scalar counts as absent. One
    shuffle brings the rows of a record together; a group is one record. Rows with equal ord
    stand in the order of path and value; rows without a path are left out.
    """
    entries = F.array_sort(F.collect_list(F.struct("ord", "path", "value")))
    entries = F.filter(entries, lambda e: e["path"].isNotNull())
    rows = flat.groupBy(id_col).agg(entries.alias("_e"))
    return rows.select(id_col, _nested(F.col("_e.path"), F.col("_e.value")).alias("json"))


@F.pandas_udf(T.StringType())
def _nested(paths: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([_written(_build(p, v)) for p, v in zip(paths, values)])


def _build(paths, values) -> dict:
    top: dict = {}
    for path, value in zip(paths, values):
        *parents, last = path.split(".")
        spot = top
        for name in parents:
            inner = spot.get(name)
            if not isinstance(inner, dict):
                if inner is not None and inner not in ABSENT:
                    spot = None
                    break
                inner = spot[name] = {}
            spot = inner
        if spot is not None:
            spot[last] = value
    return top


def _written(top) -> str:
    """JSON text of nested objects whose other values are JSON text already."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif not isinstance(node, dict):
            out.append("null" if node is None else str(node))
        else:
            out.append("{")
            members = [x for i, (name, value) in enumerate(node.items())
                       for x in (("," if i else "") + json.dumps(_utf8(name), ensure_ascii=False) + ":", value)]
            todo += ["}", *reversed(members)]
    return "".join(out)
