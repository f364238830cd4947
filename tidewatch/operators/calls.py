"""Call strings, module paths and URLs as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import nth_part, present
from tidewatch.operators.requests import first_equal, first_match, first_pattern, starts_with_any  # noqa: F401
from tidewatch.sources.tables import rule_table

DEFAULT_METHOD = "processQueries"


# ------------------------------------------------------------------------ URLs

# The characters of the parts of a URL.
AUTHORITY = r"[A-Za-z0-9\-.:\x{00BF}-\x{1FFF}\x{2C00}-\x{D7FF}]*"
PATH = r"""[/A-Za-z0-9.`()"'=&#!*;:@+$,\[\]~%_<>^\\{}|\-]*"""
_LEAD = r"(?i)^(?:http:|https:|ftp:)?//"


def uri_parts(uri: Column) -> dict[str, Column]:
    """scheme, authority, path, query, fragment and fullpath of a URL text."""
    u = F.regexp_replace(uri, r"^\s*", "")
    part = lambda pattern, group=1: F.regexp_extract(u, _LEAD + pattern, group)
    absolute = F.rlike(u, F.lit(_LEAD))
    scheme = F.lower(F.regexp_extract(u, r"(?i)^(http|https|ftp)://", 1))
    authority = part(f"({AUTHORITY})")
    bare = F.concat(scheme, F.lit("://"), authority) == u
    path = F.when(absolute, part(f"{AUTHORITY}(/?{PATH})")).otherwise(u)
    full = F.when(absolute, part(f"{AUTHORITY}(/?{PATH}.*)")).otherwise(u)
    rest = F.regexp_replace(part(f"{AUTHORITY}/?{PATH}(.*)"), r"^\?", "")
    late = part(f"{AUTHORITY}/?{PATH}#(.*)")
    fragment = first_match([(rest == "", late), (F.contains(rest, F.lit("#")), F.regexp_extract(rest, "#([^#]*)$", 1))],
                           F.lit(""))
    return {
        "scheme": scheme,
        "authority": authority,
        "path": F.when(bare, "/").otherwise(F.regexp_replace(path, "#.*", "")),
        "query": F.when(bare, "").otherwise(F.regexp_replace(rest, "#.*", "")),
        "fragment": F.when(bare, "").otherwise(fragment),
        "fullpath": F.when(bare, "/").otherwise(full),
    }


# ---------------------------------------------------------------- call strings

def launch_parts(call: Column) -> dict[str, Column]:
    """protocol, service, invoke and reason of ``[http[s]:]//service/invoke``."""
    protocol = first_match([(F.startswith(call, F.lit("//")), F.lit("")),
                            (F.startswith(call, F.lit("http://")), F.lit("http://")),
                            (F.startswith(call, F.lit("https://")), F.lit("https://"))])
    rest = F.substring(call, F.greatest(F.length(protocol), F.lit(2)) + 1, F.length(call))
    slash = F.contains(rest, F.lit("/"))
    reason = first_match([
        (protocol.isNull(), F.lit("must start with [http[s]:]//, e.g. //service/invokeString or ///invokeString")),
        (~slash, F.lit("need / before the invokeString i.e. ///invokeString"))], F.lit(None).cast("string"))
    service = F.when(slash, nth_part(rest, "/", 1))
    return {"protocol": F.when(slash, protocol), "service": service,
            "invoke": F.when(slash, F.substring(rest, F.length(service) + 2, F.length(call))), "reason": reason}


def method_parts(invoke: Column) -> dict[str, Column]:
    """target, method, options text and options map of ``target?method&k=v&...``.

    Text after a second ``?`` is dropped. Options without ``=`` stay in the text
    only, a value ends at a second ``=``, and the last of equal names wins.
    """
    called = F.coalesce(nth_part(invoke, "?", 2), F.lit(""))
    words = F.split(called, "&", -1)
    options = F.slice(words, F.lit(2), F.size(words))
    pairs = F.filter(options, lambda o: F.contains(o, F.lit("=")))
    names = F.array_distinct(F.transform(pairs, lambda o: nth_part(o, "=", 1)))
    latest = F.transform(names, lambda n: F.struct(n, nth_part(
        F.element_at(F.filter(pairs, lambda o: nth_part(o, "=", 1) == n), -1), "=", 2)))
    return {"target": nth_part(invoke, "?", 1), "method": F.get(words, F.lit(0)),
            "options": F.array_join(options, "&"), "option_map": F.map_from_entries(latest)}


def package_parts(target: Column) -> dict[str, Column]:
    """pkg, mod and params of ``pkg:mod:params``; without a colon all is the mod."""
    qualified = F.contains(target, F.lit(":"))
    pkg = F.when(qualified, nth_part(target, ":", 1)).otherwise("")
    mod = F.when(qualified, F.concat(pkg, F.lit("/"), nth_part(target, ":", 2))).otherwise(target)
    return {"pkg": pkg, "mod": mod,
            "params": F.when(qualified, F.substring(target, F.length(mod) + 2, F.length(target))).otherwise("")}


def qualify_modules(paths: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``pkg:rest`` for the column ``path``, by exact key in one map, then in another.

    The maps have the columns ``path`` and ``pkg`` with one row per path. They become one
    map first, so the paths are joined once, and a path most rows share can be split.
    """
    ranked = first.select("path", F.lit(0).alias("_o"), "pkg").union(second.select("path", F.lit(1), "pkg"))
    known = ranked.where("pkg IS NOT NULL").groupBy("path").agg(F.min_by("pkg", "_o").alias("_pkg"))
    joined = paths.join(known, "path", "left")
    pkg = F.col("_pkg")
    path = F.col("path")
    qualified = F.instr(path, F.lit(":")) > 1
    data = F.when(qualified, path).otherwise(
        F.concat(pkg, F.lit(":"), F.substring(path, F.length(pkg) + 2, F.length(path))))
    return joined.withColumns({
        "data": data, "success": data.isNotNull(),
        "reason": F.when(data.isNull(), F.concat(F.lit('[toInvokeString] Cannot determine package name for "'), path,
                                                 F.lit('" automatically.')))}).drop("_pkg")


# ----------------------------------------------------------------------- paths

_BACK = "\\"


def _backslashed(path: Column) -> Column:
    return F.translate(path, "/", _BACK)


def _slashed_if(path: Column, slash_based: Column) -> Column:
    return F.when(slash_based, F.translate(path, _BACK, "/")).otherwise(path)


def canonical_path(path: Column) -> Column:
    """Remove ``segment/../`` pairs in one pass, keeping the slash style."""
    short = F.regexp_replace(_backslashed(path), r"[A-Za-z0-9-]+\\\.\.\\", "")
    return _slashed_if(short, F.contains(path, F.lit("/")))


def resolve_relative(relative: Column, module: Column) -> Column:
    """A path relative to a module; each leading ``../`` goes up one more level."""
    slash_based = F.contains(relative, F.lit("/")) | F.contains(module, F.lit("/"))
    rel, mod = _backslashed(relative), _backslashed(module)
    ups = F.length(F.regexp_extract(rel, r"^((?:\.\.\\)*)", 1))
    depth = (ups / 3).cast("int") + 1
    segments = F.split(mod, r"\\", -1)
    kept = F.size(segments) - depth
    base = F.when(kept < 0, F.repeat(F.lit("..\\"), -kept)).otherwise(
        F.array_join(F.transform(F.slice(segments, F.lit(1), F.greatest(kept, F.lit(0))),
                                 lambda s: F.concat(s, F.lit(_BACK))), ""))
    return _slashed_if(canonical_path(F.concat(base, F.substring(rel, ups + 1, F.length(rel)))), slash_based)


def _without_double_dots(path: Column) -> Column:
    cut = F.regexp_replace(F.concat(path, F.lit(_BACK)), r"[^\\]*\\\.\.\\", "")
    return F.substring(cut, F.lit(1), F.length(cut) - 1)


def with_relative_path(paths: DataFrame, full: str, root: str, name: str = "relative") -> DataFrame:
    """Add the path from a root to a full path (backslash style), null where none exists.

    The nearest ancestor of the root that starts the full path is the base. Each
    intermediate value is a column of its own, so none is evaluated twice.
    """
    plain = lambda p: F.when(F.contains(p, F.lit(":")), F.substring(p, F.lit(3), F.length(p))).otherwise(p)
    rows = paths.withColumns({"_f": plain(F.col(full)), "_r": plain(F.col(root))})
    rows = rows.withColumn("_in", F.startswith("_f", F.col("_r")))
    rows = rows.withColumns({"_f": F.when(F.col("_in"), F.col("_f")).otherwise(_without_double_dots(F.col("_f"))),
                             "_r": F.when(F.col("_in"), F.col("_r")).otherwise(_without_double_dots(F.col("_r")))})
    rows = rows.withColumn("_s", F.split(F.regexp_replace("_r", r"\\$", ""), r"\\", -1))

    def ancestor(up: Column) -> Column:
        joined = F.array_join(F.slice("_s", F.lit(1), F.size("_s") - up), _BACK)
        return F.when(up == 0, F.col("_r")).when((joined == "") & (up < F.size("_s")), _BACK).otherwise(joined)

    steps = F.transform(F.sequence(F.lit(0), F.size("_s")), lambda up: F.struct(up.alias("up"), ancestor(up).alias("base")))
    rows = rows.withColumn("_steps", steps)
    nearest = F.filter("_steps", lambda s: (s["base"] != "") & F.startswith(F.col("_f"), s["base"]))
    rows = rows.withColumn("_at", F.get(nearest, F.lit(0)))
    base = F.col("_at.base")
    skip = F.length(base) + F.when(F.endswith(base, F.lit(_BACK)), 0).otherwise(1)
    rest = F.substring("_f", skip + 1, F.length("_f"))
    found = F.concat(F.repeat(F.lit("\\.."), F.col("_at.up")), F.lit(_BACK), _without_double_dots(rest))
    return (rows.withColumn(name, F.when(F.col(root) == "", F.col(full)).otherwise(found))
            .drop("_f", "_r", "_in", "_s", "_steps", "_at"))


# --------------------------------------------------------------------- dispatch

def dispatch(spark: SparkSession, calls: DataFrame, catalog: list[tuple[str, str, str]]) -> DataFrame:
    """How each call's method resolves: method, action, default, status or missing.

    Reads ``module``, ``method`` and ``not_found_status``. The catalog lists
    (module, method, kind) with kind ``method`` or ``action``.
    """
    table = rule_table(spark, sorted({(m, n, k) for m, n, k in catalog}),
                       "module string, called string, kind string")
    called = F.when(present(F.col("method")), F.col("method")).otherwise(DEFAULT_METHOD)
    rows = calls.withColumn("called", called)
    for kind in ("method", "action"):
        known = table.where(F.col("kind") == kind).select("module", "called", F.lit(True).alias(f"_{kind}"))
        rows = rows.join(known, ["module", "called"], "left")
    resolution = first_match([
        (F.col("_method"), F.lit("method")), (F.col("_action"), F.lit("action")),
        (F.col("called") == DEFAULT_METHOD, F.lit("default")),
        (F.col("not_found_status").isNotNull(), F.concat(F.lit("status "), F.col("not_found_status").cast("string"))),
    ], F.lit("missing"))
    return rows.withColumns({"resolution": resolution, "success": resolution != "missing"}).drop("_method", "_action")
