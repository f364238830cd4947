"""Queries over call strings, paths and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.text import contains_any
from tidewatch.operators import calls as c
from tidewatch.operators.requests import count_by
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import table
from tidewatch.sources.views import monitor_events, requests

_URIS = """CASE page_id % 8 WHEN 0 THEN '  ' || url WHEN 1 THEN upper(url) WHEN 2 THEN regexp_extract(url, '^[a-z]+://[^/]*', 0)
  WHEN 3 THEN substr(url, strpos(url, '/')) WHEN 4 THEN 'local/' || page_id WHEN 5 THEN url || '?q=1#a#b' ELSE url END"""
_URIS_SPARK = _URIS.replace("strpos(url, '/')", "instr(url, '/')")

# The patterns of the check, stated apart from the operator's.
_LEAD = "(?i)^(?:http:|https:|ftp:)?//"
_HOST = r"[A-Za-z0-9\-.:\x{00BF}-\x{1FFF}\x{2C00}-\x{D7FF}]*"

URI_SQL = rf"""u AS (SELECT page_id, regexp_replace({_URIS}, '^\s*', '') AS u FROM pages),
s AS (SELECT page_id, u, lower(regexp_extract(u, '(?i)^(http|https|ftp)://', 1)) AS scheme,
  regexp_matches(u, '{_LEAD}') AS absolute, regexp_extract(u, '{_LEAD}({_HOST})', 1) AS authority FROM u),
p AS (SELECT page_id, u, scheme, authority, absolute,
  substr(regexp_extract(u, '{_LEAD}.*', 0), length(regexp_extract(u, '{_LEAD}{_HOST}', 0)) + 1) AS rest FROM s),
q AS (SELECT *, scheme || '://' || authority = u AS bare, CASE WHEN absolute THEN split_part(rest, '?', 1) ELSE u END AS before,
  CASE WHEN absolute AND strpos(rest, '?') > 0 THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS after FROM p),
uri AS (SELECT page_id, scheme, authority, CASE WHEN bare THEN '/' ELSE split_part(before, '#', 1) END AS path,
  split_part(after, '#', 1) AS query,
  CASE WHEN after = '' AND strpos(before, '#') > 0 THEN regexp_extract(before, '#([^#]*)$', 1)
    WHEN strpos(after, '#') > 0 THEN regexp_extract(after, '#([^#]*)$', 1) ELSE '' END AS fragment,
  CASE WHEN bare THEN '/' WHEN absolute THEN rest ELSE u END AS fullpath FROM q)"""


def uris(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.expr(_URIS_SPARK).alias("uri"))
    return pages.select("page_id", *[p.alias(n) for n, p in c.uri_parts(F.col("uri")).items()])


@query("uri_split", f"WITH {URI_SQL} SELECT * FROM uri")
def uri_split(spark, folder):
    return uris(spark, folder)


@query("uri_volume", f"""
WITH {URI_SQL} SELECT authority, split_part(path, '/', 2) AS segment, count(*) AS n FROM uri GROUP BY ALL""")
def uri_volume(spark, folder):
    rows = uris(spark, folder)
    return count_by(rows.withColumn("segment", F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))),
                    "authority", "segment")


_CALLS = """CASE req_id % 7 WHEN 0 THEN '///' || host || ':top?run&a=1&b=2=3&flag&a=9'
  WHEN 1 THEN 'http://' || host || '/pkg' || req_id % 5 || ':mod/view:extra?load?dropped&x=1'
  WHEN 2 THEN '//inline/app/mod' WHEN 3 THEN '//' || host WHEN 4 THEN 'no prefix'
  WHEN 5 THEN 'https://' || host || '/pkg' || req_id % 5 || ':mod?get&limit=' || req_id ELSE '//svc/?go' END"""


@query("invoke_string_parse", f"""
WITH {v.REQ}, x AS (SELECT req_id, req_id % 7 AS shape, host, 'pkg' || req_id % 5 AS p FROM req)
SELECT req_id, CASE shape WHEN 1 THEN 'http://' WHEN 5 THEN 'https://' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE '' END AS protocol,
  CASE shape WHEN 0 THEN '' WHEN 2 THEN 'inline' WHEN 6 THEN 'svc' WHEN 1 THEN host WHEN 5 THEN host END AS service,
  CASE shape WHEN 0 THEN host || ':top' WHEN 1 THEN p || ':mod/view:extra' WHEN 2 THEN 'app/mod' WHEN 5 THEN p || ':mod'
    WHEN 6 THEN '' END AS target,
  CASE shape WHEN 0 THEN 'run' WHEN 1 THEN 'load' WHEN 2 THEN '' WHEN 5 THEN 'get' WHEN 6 THEN 'go' ELSE '' END AS method,
  CASE shape WHEN 0 THEN 'a=1&b=2=3&flag&a=9' WHEN 5 THEN 'limit=' || req_id ELSE '' END AS options,
  CASE shape WHEN 0 THEN 'a=9;b=2' WHEN 5 THEN 'limit=' || req_id ELSE '' END AS option_map,
  CASE shape WHEN 0 THEN host WHEN 1 THEN p WHEN 5 THEN p ELSE '' END AS pkg,
  CASE shape WHEN 0 THEN host || '/top' WHEN 1 THEN p || '/mod/view' WHEN 2 THEN 'app/mod' WHEN 5 THEN p || '/mod' WHEN 6 THEN '' END AS mod,
  CASE shape WHEN 1 THEN 'extra' ELSE '' END AS params,
  CASE shape WHEN 3 THEN 'need / before the invokeString i.e. ///invokeString'
    WHEN 4 THEN 'must start with [http[s]:]//, e.g. //service/invokeString or ///invokeString' END AS reason FROM x""")
def invoke_string_parse(spark, folder):
    rows = requests(spark, folder).select("req_id", F.expr(_CALLS).alias("call"))
    rows = rows.withColumns(c.launch_parts(F.col("call")))
    rows = rows.withColumns(c.method_parts(F.col("invoke")))
    rows = rows.withColumns(c.package_parts(F.col("target")))
    pairs = F.transform(F.map_entries("option_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("req_id", "protocol", "service", "target", "method", "options",
                       F.array_join(F.array_sort(pairs), ";").alias("option_map"), "pkg", "mod", "params", "reason")


@query("invoke_string_volume", f"""
WITH {v.REQ}, x AS (SELECT req_id % 7 AS shape, host, 'pkg' || req_id % 5 AS p FROM req)
SELECT CASE shape WHEN 0 THEN '' WHEN 2 THEN 'inline' WHEN 6 THEN 'svc' ELSE host END AS service,
  CASE shape WHEN 0 THEN host WHEN 1 THEN p WHEN 5 THEN p ELSE '' END AS pkg,
  CASE shape WHEN 0 THEN 'run' WHEN 1 THEN 'load' WHEN 5 THEN 'get' WHEN 6 THEN 'go' ELSE '' END AS method, count(*) AS n
FROM x WHERE shape NOT IN (3, 4) GROUP BY ALL""")
def invoke_string_volume(spark, folder):
    rows = requests(spark, folder).select(F.expr(_CALLS).alias("call")).withColumns(c.launch_parts(F.col("call")))
    rows = rows.where("reason IS NULL").withColumns(c.method_parts(F.col("invoke")))
    return count_by(rows.withColumns(c.package_parts(F.col("target"))), "service", "pkg", "method")


_MODULE = r"regexp_extract(target, '^/([^?#]*)', 1)"


@query("module_package_lookup", f"""
WITH {v.REQ}, m AS (SELECT req_id, {_MODULE} AS path FROM req),
first AS (SELECT path, min(CASE WHEN req_id % 3 = 0 THEN split_part(path, '/', 1) END) AS pkg FROM m GROUP BY path),
second AS (SELECT path, min(CASE WHEN req_id % 3 = 1 THEN path[1] END) AS pkg FROM m GROUP BY path),
w AS (SELECT req_id, CASE WHEN req_id % 7 = 0 THEN replace(path, '/', ':') ELSE path END AS path FROM m),
j AS (SELECT req_id, w.path, coalesce(first.pkg, second.pkg) AS pkg FROM w LEFT JOIN first USING (path) LEFT JOIN second USING (path)),
d AS (SELECT req_id, path, CASE WHEN strpos(path, ':') > 1 THEN path ELSE pkg || ':' || substr(path, length(pkg) + 2) END AS data FROM j)
SELECT req_id, path, data, data IS NOT NULL AS success, CASE WHEN data IS NULL THEN
  '[toInvokeString] Cannot determine package name for "' || path || '" automatically.' END AS reason FROM d""")
def module_package_lookup(spark, folder):
    modules = requests(spark, folder).select("req_id", F.expr(_MODULE).alias("path"))
    # A path without a package in a map counts as not listed there.
    known = lambda n, pkg: F.min(F.when(F.col("req_id") % 3 == n, pkg)).alias("pkg")
    first = modules.groupBy("path").agg(known(0, F.get(F.split("path", "/"), F.lit(0))))
    second = modules.groupBy("path").agg(known(1, F.substring("path", 1, 1)))
    paths = modules.withColumn("path", F.when(F.col("req_id") % 7 == 0, F.translate("path", "/", ":"))
                               .otherwise(F.col("path")))
    return c.qualify_modules(paths, first, second).select("req_id", "path", "data", "success", "reason")


@query("path_canonical", rf"""
WITH {v.REQ}, b AS (SELECT req_id, split_part(host, '.', 1) AS label, coalesce(nullif(regexp_extract(target, '^/([a-z]+)', 1), ''), 'none') AS lang FROM req),
i AS (SELECT req_id, 'app/' || label || '/../' || lang || '/x/../../top' AS path,
  CASE req_id % 3 WHEN 0 THEN '../' || lang WHEN 1 THEN '../../../../' || lang ELSE lang || '/view' END AS rel,
  'pkg/' || label || '/mod' AS module, '\site\' || lang || '\..\' || label || '\page' AS full,
  CASE req_id % 4 WHEN 0 THEN '\site' WHEN 1 THEN '\site\' || lang || '\deep' WHEN 2 THEN 'c:\site\other\' ELSE 'elsewhere' END AS root FROM b)
SELECT req_id, 'app/' || lang || '/../top' AS canonical,
  CASE req_id % 3 WHEN 0 THEN 'pkg/' || lang WHEN 1 THEN '../../' || lang
    ELSE 'pkg/' || split_part(module, '/', 2) || '/' || lang || '/view' END AS resolved,
  CASE req_id % 4 WHEN 0 THEN '\' || split_part(module, '/', 2) || '\page'
    -- An ancestor is matched as text, so a label that starts with the language is cut.
    WHEN 1 THEN CASE WHEN starts_with(split_part(module, '/', 2), lang) THEN '\..\' || substr(split_part(module, '/', 2) || '\page', length(lang) + 2)
      ELSE '\..\..\' || split_part(module, '/', 2) || '\page' END
    WHEN 2 THEN '\..\' || split_part(module, '/', 2) || '\page' END AS relative
FROM (SELECT i.*, lang FROM i JOIN b USING (req_id))""")
def path_canonical(spark, folder):
    label = F.get(F.split("host", r"\."), F.lit(0))
    found = F.regexp_extract("target", "^/([a-z]+)", 1)
    lang = F.when(found == "", "none").otherwise(found)
    rid = F.col("req_id")
    b = requests(spark, folder).select("req_id", label.alias("label"), lang.alias("lang"))
    cat = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    label, lang = F.col("label"), F.col("lang")
    path = cat("app/", label, "/../", lang, "/x/../../top")
    rel = F.when(rid % 3 == 0, cat("../", lang)).when(rid % 3 == 1, cat("../../../../", lang)).otherwise(cat(lang, "/view"))
    full = cat("\\site\\", lang, "\\..\\", label, "\\page")
    root = (F.when(rid % 4 == 0, "\\site").when(rid % 4 == 1, cat("\\site\\", lang, "\\deep"))
            .when(rid % 4 == 2, "c:\\site\\other\\").otherwise("elsewhere"))
    rows = b.select("req_id", c.canonical_path(path).alias("canonical"),
                    c.resolve_relative(rel, cat("pkg/", label, "/mod")).alias("resolved"),
                    full.alias("full"), root.alias("root"))
    return c.with_relative_path(rows, "full", "root").drop("full", "root")


@query("rule_classify", r"""
WITH r AS (SELECT CASE WHEN regexp_matches(url, 'utm_.*feed') THEN 0 WHEN regexp_matches(url, '/(es|fr)/\d+') THEN 2
    WHEN regexp_matches(url, '#') THEN 3 ELSE -1 END AS pattern,
  CASE WHEN split_part(url, ':', 1) = 'http' THEN 0 WHEN split_part(url, ':', 1) = 'https' THEN 1 ELSE -1 END AS exact,
  contains(url, '.example.com') OR contains(url, '.example.org') AS has_any,
  starts_with(url, 'https://www') OR starts_with(url, 'http://m.') AS starts_any, ends_with(url, '#top') AS ends FROM pages)
SELECT pattern, exact, has_any, pattern >= 0 AS matches_any, starts_any, ends, count(*) AS n FROM r GROUP BY ALL""")
def rule_classify(spark, folder):
    url = F.col("url")
    pattern = c.first_pattern(url, ["utm_.*feed", "", r"/(es|fr)/\d+", "#"])
    rows = table(spark, folder, "pages").select(
        pattern.alias("pattern"), c.first_equal(F.get(F.split(url, ":"), F.lit(0)), ["http", "https"]).alias("exact"),
        contains_any(url, [".example.com", ".example.org"]).alias("has_any"), (pattern >= 0).alias("matches_any"),
        c.starts_with_any(url, ["https://www", "http://m."]).alias("starts_any"),
        F.endswith(url, F.lit("#top")).alias("ends"))
    return count_by(rows, *rows.columns)


CATALOG = [("app/m0", "click", "method"), ("app/m0", "view", "action"), ("app/m1", "click", "action"),
           ("app/m1", "click", "method"), ("app/m2", "processQueries", "method"), ("app/m3", "error", "method")]


@query("method_dispatch_report", f"""
WITH {v.MON}, catalog(module, called, kind) AS (VALUES ('app/m0', 'click', 'method'), ('app/m0', 'view', 'action'),
  ('app/m1', 'click', 'action'), ('app/m1', 'click', 'method'), ('app/m2', 'processQueries', 'method'), ('app/m3', 'error', 'method')),
c AS (SELECT module, CASE WHEN k % 5 = 0 THEN 'processQueries' ELSE method END AS called, k % 4 = 0 AS resolves FROM mon),
r AS (SELECT module, CASE WHEN EXISTS (SELECT 1 FROM catalog x WHERE x.module = c.module AND x.called = c.called AND kind = 'method') THEN 'method'
    WHEN EXISTS (SELECT 1 FROM catalog x WHERE x.module = c.module AND x.called = c.called AND kind = 'action') THEN 'action'
    WHEN called = 'processQueries' THEN 'default' WHEN resolves THEN 'status 404' ELSE 'missing' END AS resolution FROM c)
SELECT module, resolution, resolution <> 'missing' AS success, count(*) AS n FROM r GROUP BY ALL""")
def method_dispatch_report(spark, folder):
    calls = monitor_events(spark, folder).select(
        "module", F.when(F.col("k") % 5 == 0, "").otherwise(F.col("method")).alias("method"),
        F.when(F.col("k") % 4 == 0, 404).alias("not_found_status"))
    return count_by(c.dispatch(spark, calls, CATALOG), "module", "resolution", "success")
