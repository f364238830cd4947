"""Expectations and differences between datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import number_text, script_number, text
from tidewatch.operators.requests import first_match

# Keys of a nested condition that are not paths.
OPERATORS, CONTEXT, VERBOSE = "__operators__", "__contextName__", "__verbose__"
EQUAL = "equal"
VALUE = "assertionValue"

@dataclass(frozen=True)
class Expectation:
    """One leaf of a condition: column path, operator and expected value."""

    path: tuple[str, ...]
    op: str
    expected: object

    @property
    def name(self) -> str:
        return ".".join(self.path)


def flatten(condition: dict | str | float) -> list[Expectation]:
    """Leaves of a nested condition in key order.

    A branch may name operators for its keys; operators given above apply to the
    branches below them. A list is a branch whose keys are its positions. A bare text or
    number compares the column ``assertionValue``.
    """
    if not isinstance(condition, (dict, list)):
        condition = {VALUE: condition}
    leaves: list[Expectation] = []

    def walk(branch: object, path: tuple[str, ...], operator: object) -> None:
        if isinstance(branch, list):
            branch = {str(i): item for i, item in enumerate(branch)}
        if not isinstance(branch, dict):
            leaves.append(Expectation(path, operator if isinstance(operator, str) else EQUAL, branch))
            return
        inherited = operator or branch.get(OPERATORS) or {}
        inner = {k: v for k, v in branch.items() if k not in (OPERATORS, CONTEXT, VERBOSE)}
        if not inner:
            leaves.append(Expectation(path, "empty", {}))
        for key, value in inner.items():
            walk(value, (*path, key), inherited.get(key) if isinstance(inherited, dict) else None)

    walk(condition, (), None)
    return leaves


def kind_of(value: object) -> str:
    """Type name of an expected value in the reference language."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "object"


def _column(schema: T.StructType, path: tuple[str, ...]) -> tuple[Column, str, T.DataType] | None:
    """Column, type name and type of a path, or None where the schema has no such path.

    Structs and maps are followed by key, lists by position, open JSON by either. What a
    row does not have is null there; a map's or list's missing entry is told from a null
    by :func:`_absent`."""
    column, kind = None, schema
    for at, name in enumerate(path):
        if isinstance(kind, T.StructType) and name in kind.names:
            column = F.col(f"`{name}`") if column is None else column.getField(name)
            kind = kind[name].dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
        elif isinstance(kind, T.ArrayType) and name.isdigit():
            column, kind = F.get(column, F.lit(int(name))), kind.elementType
        elif isinstance(kind, T.VariantType):
            steps = "".join(f"[{n}]" if n.isdigit() else f"['{n}']" for n in path[at:])
            return F.try_variant_get(column, "$" + steps, "variant"), "variant", kind
        else:
            return None
    kinds = {T.StringType: "string", T.BooleanType: "boolean", T.VariantType: "variant"}
    name = "number" if isinstance(kind, T.NumericType) else kinds.get(type(kind), "object")
    return column, name, kind


def _absent(schema: T.StructType, path: tuple[str, ...]) -> Column:
    """True where a list or map on the way has no such entry."""
    for at in range(len(path) - 1, 0, -1):
        inner = _column(schema, path[:at])
        if inner and isinstance(inner[2], T.ArrayType):
            return F.coalesce(F.size(inner[0]) <= int(path[at]), F.lit(True))
        if inner and isinstance(inner[2], T.MapType):
            return ~F.coalesce(F.map_contains_key(inner[0], F.lit(path[at])), F.lit(False))
    return F.lit(False)


def _shown(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return script_number(value) if isinstance(value, (int, float)) else str(value)


def _actual(column: Column, kind: str) -> Column:
    return number_text(column) if kind == "number" else text(column)


def _filled(column: Column, kind: T.DataType) -> Column:
    """True for a list, map or struct that has something in it."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(column) > 0
    # A struct has its fields whatever they hold.
    return column.isNotNull() & F.lit(isinstance(kind, T.StructType) and len(kind) > 0)


def violation(schema: T.StructType, e: Expectation, context: str = " ") -> Column:
    """Reason a row violates an expectation, or null."""
    found = _column(schema, e.path)
    wanted = kind_of(e.expected)
    none = F.lit(None).cast("string")

    def mismatch(actual: str) -> Column:
        return F.lit(f"{context}Expected {wanted} but got {actual} at {e.name}")

    if found is None:
        return mismatch("undefined")
    column, kind, full_type = found
    if kind == "variant":
        return _variant_violation(column, e, context)
    gone = _absent(schema, e.path)
    missing = F.when(gone, mismatch("undefined"))
    if wanted == "object":
        if kind != "object" and e.expected is not None:
            return missing.when(column.isNotNull(), mismatch(kind))
        if e.expected is None:
            shown = F.concat(F.lit(f"{context}Expected null for {e.name} but got "), F.lit("[object]"))
            return missing.when(column.isNotNull(), shown if kind == "object" else mismatch(kind))
        full = F.lit(f"{context}Expected an empty array/object for {e.name} but it was non-empty.")
        return missing.when(_filled(column, full_type), full)
    if kind == "object":
        return missing.otherwise(mismatch("object"))
    # A null is an object in the reference language.
    broken = missing.when(column.isNull(), mismatch("object"))
    if kind != wanted:
        return broken.otherwise(mismatch(kind))
    return broken.otherwise(_compare(column, kind, e, context))


def _compare(column: Column, kind: str, e: Expectation, context: str) -> Column:
    expected, shown = F.lit(e.expected), _shown(e.expected)
    actual = _actual(column, kind)
    say = lambda words: F.concat(F.lit(f"{context}Expected {e.name} {words} but got "), actual)
    if e.op == EQUAL:
        return F.when(column != expected, say(f"to equal {shown}"))
    if e.op == "greater than":
        return F.when(column < expected, say(f"to be greater than {shown}"))
    if e.op == "strictly greater than":
        return F.when(column <= expected, say(f"to be strictly greater than {shown}"))
    if e.op == "same length":
        if kind != "string":
            return F.lit(f"{context}Expected {e.name} to be string  but got {kind}")
        return F.when(F.length(column) != len(shown), F.concat(
            F.lit(f"{context}Expected {e.name} to be have the length {len(shown)} but got "), text(F.length(column))))
    if e.op in ("contain", "notcontain"):
        missing = (column == "") if kind == "string" else ((column == 0) if kind == "number" else ~column)
        holds = F.contains(actual, F.lit(shown))
        word = "not contain" if e.op == "notcontain" else "contain"
        return (F.when(missing, F.lit(f"{context}Expected {e.name} to contain {shown} but the property was missing."))
                .when(holds if e.op == "notcontain" else ~holds, F.lit(f"{context}Expected {e.name} to {word} '{shown}'.")))
    return F.lit(f'{context}Unknown operator "{e.op}"')


def _variant_violation(value: Column, e: Expectation, context: str) -> Column:
    """Expectations on open JSON: type, null, empty, and equality of scalars."""
    wanted, schema = kind_of(e.expected), F.col(f"`_kind of {e.name}`")
    kind = first_match([(value.isNull(), F.lit("undefined")), (schema == "STRING", F.lit("string")),
                        (schema == "BOOLEAN", F.lit("boolean")),
                        ((schema == "VOID") | F.rlike(schema, F.lit("^(ARRAY|OBJECT)<")), F.lit("object"))], F.lit("number"))
    mismatch = F.concat(F.lit(f"{context}Expected {wanted} but got "), kind, F.lit(f" at {e.name}"))
    shown = F.try_variant_get(value, "$", "string")
    if e.expected is None:
        rest = F.when(schema != "VOID", F.concat(F.lit(f"{context}Expected null for {e.name} but got "), shown))
    elif wanted == "object":
        empty = F.to_json(value).isin("[]", "{}")
        rest = F.when(~empty | (schema == "VOID"),
                      F.lit(f"{context}Expected an empty array/object for {e.name} but it was non-empty."))
    elif wanted == "number":
        rest = _compare(F.try_variant_get(value, "$", "double"), "number", e, context)
    elif wanted == "boolean":
        rest = _compare(F.try_variant_get(value, "$", "boolean"), "boolean", e, context)
    else:
        rest = _compare(shown, "string", e, context)
    return F.when(kind != wanted, mismatch).otherwise(rest)


def _judged(rows: DataFrame, condition: dict | str | float) -> tuple[DataFrame, list[Column], list[str]]:
    """Rows with one reason column per expectation, the violation structs, and helper names."""
    context = " "
    if isinstance(condition, dict) and condition.get(CONTEXT):
        context = f"[{condition[CONTEXT]}] "
    expectations = flatten(condition)
    own = set(rows.columns)
    rows = _with_kinds(rows, expectations)
    reasons = [f"_v{i}" for i in range(len(expectations))]
    rows = rows.withColumns({r: violation(rows.schema, e, context) for r, e in zip(reasons, expectations)})
    found = [F.struct(F.lit(i).alias("ord"), F.lit(e.name).alias("path"), F.lit(e.op).alias("op"), F.col(r).alias("reason"))
             for i, (r, e) in enumerate(zip(reasons, expectations))]
    return rows, found, [c for c in rows.columns if c not in own]


def check(rows: DataFrame, condition: dict | str | float) -> DataFrame:
    """Add ``violations`` (all, in key order) and ``first_violation`` to each row.

    All expectations are columns of one pass over the data.
    """
    rows, found, helpers = _judged(rows, condition)
    first = F.coalesce(*[F.when(f["reason"].isNotNull(), f) for f in found])
    every = F.filter(F.array(*found), lambda v: v["reason"].isNotNull())
    return rows.withColumns({"violations": every, "first_violation": first}).drop(*helpers)


def _with_kinds(rows: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """Type texts of the open JSON columns, worked out once per row."""
    found = {e.name: _column(rows.schema, e.path) for e in expectations}
    return rows.withColumns({f"_kind of {n}": F.schema_of_variant(c[0]) for n, c in found.items() if c and c[1] == "variant"})


def violations(rows: DataFrame, condition: dict | str | float, keys: list[str]) -> DataFrame:
    """One row per violated expectation."""
    rows, found, _ = _judged(rows, condition)
    return rows.select(*keys, F.inline(F.array(*found))).where(F.col("reason").isNotNull())


def outcome(rows: DataFrame, condition: dict | str | float, order: list[str]) -> DataFrame:
    """One summarised outcome: the first violation of the first row that has one."""
    checked = check(rows, condition).select(*order, "first_violation")
    broken = F.col("first_violation").isNotNull()
    first = F.min(F.when(broken, F.struct(*order, F.col("first_violation.reason").alias("reason"))))
    return checked.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(broken, 1)).alias("violating"),
                       first.alias("first")).select(
        (F.col("violating") == 0).alias("success"), "rows", "violating", F.col("first.reason").alias("reason"))


# ------------------------------------------------------------------ differences

def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counting copies, with their side.

    Copies count plus one on the left and minus one on the right; one grouping gives both sides."""
    columns = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    rest = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    copies = F.sequence(F.lit(1).cast("bigint"), F.abs("_n"))
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return rest.withColumn("side", side).select(*columns, "side", F.explode(copies).alias("_c")).drop("_c")


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ per column, and rows missing on either side, by key.

    A missing key counts as missing, not as a difference of its columns. Nulls are a key
    like any other. Keys with several rows on a side are not paired; ``repeated keys``
    counts those whose rows are not the same on both sides. One grouping by key sees each
    table once and holds two rows of a key at most.
    """
    columns = [c for c in left.columns if c not in keys]
    packed = F.struct(*columns)
    both = (left.select(*keys, packed.alias("_l"), F.lit(None).cast(left.select(packed.alias("p")).schema["p"].dataType).alias("_r"))
            .union(right.select(*keys, F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_l"), packed.alias("_r"))))
    # A sum of hashes tells whether several rows are the same on both sides.
    weight = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.xxhash64(c).cast("decimal(38,0)")))
    found = both.groupBy(*keys).agg(
        F.count("_l").alias("_nl"), F.count("_r").alias("_nr"), F.first("_l", ignorenulls=True).alias("_l"),
        F.first("_r", ignorenulls=True).alias("_r"), weight("_l").alias("_hl"), weight("_r").alias("_hr"))
    paired = (F.col("_nl") == 1) & (F.col("_nr") == 1)
    several = (F.col("_nl") > 0) & (F.col("_nr") > 0) & ~paired
    unlike = (F.col("_nl") != F.col("_nr")) | ~F.col("_hl").eqNullSafe(F.col("_hr"))
    counts = found.agg(
        F.sum(F.when(F.col("_nr") == 0, F.col("_nl"))).alias("only left"),
        F.sum(F.when(F.col("_nl") == 0, F.col("_nr"))).alias("only right"),
        F.count(F.when(several & unlike, 1)).alias("repeated keys"),
        *[F.count(F.when(paired & ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), 1)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("subject"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("differing")) for c in counts.columns])
    return counts.select(F.inline(rows))
