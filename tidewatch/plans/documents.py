"""Queries over records, texts and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import documents as d
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import micros, table
from tidewatch.sources.views import monitor_events

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("json_records_scan", f"""
WITH e AS (SELECT event_id, event_id AS id, props AS body, {_K} AS k, false AS bad FROM events
  UNION ALL SELECT -event_id - 1, event_id, substr(props, 1, length(props) - 1), NULL, true FROM events WHERE event_id % 10 = 3
  UNION ALL SELECT -event_id - 1, NULL, props, {_K}, false FROM events WHERE event_id % 10 = 7)
SELECT event_id, id IS NOT NULL AND NOT bad AS success, k,
  CASE WHEN id IS NULL THEN 'please specify either an object or a string to loadById'
    WHEN bad THEN 'cannot parse ' || body END AS reason FROM e""")
def json_records_scan(spark, folder):
    events, other = table(spark, folder, "events"), -F.col("event_id") - 1
    rows = events.select("event_id", F.col("event_id").alias("id"), F.col("props").alias("body"))
    rows = rows.union(events.where("event_id % 10 = 3").select(
        other, "event_id", F.substring("props", F.lit(1), F.length("props") - 1)))
    rows = rows.union(events.where("event_id % 10 = 7").select(other, F.lit(None).cast("bigint"), "props"))
    return d.json_records(rows, "id", "body").select(
        "event_id", "success", F.try_variant_get("record", "$.k", "int").alias("k"), "reason")


_WIRE = """CASE o_orderkey % 8 WHEN 0 THEN 'FAIL: no ' || o_orderkey WHEN 1 THEN 'SUCCESS: OK' WHEN 2 THEN 'SUCCESS: '
  WHEN 3 THEN 'SUCCESS: plain,' || o_orderstatus WHEN 4 THEN 'HELLO ' || o_orderkey
  ELSE 'SUCCESS: junk__ROW__' || o_orderkey || ',a__COMMA__b__COMMA__c,' || o_orderpriority || '__ROW__' || o_custkey || ',' END"""


@query("wire_rows_decode", f"""
WITH w AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderkey % 8 AS shape, {_WIRE} AS message FROM orders),
c(row_no, cell_no) AS (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1))
SELECT o_orderkey, true AS success, CAST(NULL AS VARCHAR) AS reason, row_no, cell_no,
  CASE WHEN row_no = 0 AND cell_no = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN row_no = 0 AND cell_no = 1 THEN 'a,b,c'
    WHEN row_no = 0 THEN o_orderpriority WHEN cell_no = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS cell
FROM w, c WHERE shape > 4
UNION ALL SELECT o_orderkey, true, NULL, 0, 0, 'plain,' || o_orderstatus FROM w WHERE shape = 3
UNION ALL SELECT o_orderkey, shape IN (1, 2), CASE WHEN shape = 0 THEN 'no ' || o_orderkey
  WHEN shape = 4 THEN 'Unrecognized response from node: ' || message END, NULL, NULL, NULL FROM w WHERE shape IN (0, 1, 2, 4)""")
def wire_rows_decode(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.expr(_WIRE).alias("message"))
    rows = rows.select("o_orderkey", *[c.alias(n) for n, c in d.decode_wire(F.col("message")).items()])
    rows = rows.select("o_orderkey", "success", "reason", F.posexplode_outer("rows").alias("row_no", "cells"))
    return rows.select("o_orderkey", "success", "reason", "row_no", F.posexplode_outer("cells").alias("cell_no", "cell"))


@query("query_batch_encode", """
WITH s AS (SELECT o_orderkey // 20 AS batch, o_orderkey, 'UPDATE é SET status = ''' || o_orderstatus || ''' WHERE id = ' || o_orderkey AS stmt FROM orders)
SELECT batch, count(*) AS statements, 'hex_' || lower(hex(encode(string_agg(stmt, '__QUERY_SEP__' ORDER BY o_orderkey)))) AS request
FROM s GROUP BY batch""")
def query_batch_encode(spark, folder):
    # o_orderkey is unique, so a batch never has more than 20 statements.
    key = F.col("o_orderkey")
    stmt = F.concat(F.lit("UPDATE é SET status = '"), "o_orderstatus", F.lit("' WHERE id = "), key.cast("string"))
    rows = table(spark, folder, "orders").select(F.floor(key / 20).cast("bigint").alias("batch"),
                                                 F.struct(key.alias("at"), stmt.alias("stmt")).alias("s"))
    batch = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["stmt"])
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("statements"), d.encode_batch(batch).alias("request"))


_NESTED = """'{"k": ' || k || ', "user": {"id": ' || user_id || ', "tags": ["t' || k % 3 || '", {"deep": {"er": true}}], "none": {}}, "nil": null'
  || CASE WHEN k % 2 = 0 THEN ', "rate": 1.5' ELSE ', "rate": "high"' END || '}'"""


def _bodies(spark, folder):
    """Every event's own text, under a negative number, and a nested one beside it."""
    nested = monitor_events(spark, folder).select("event_id", F.expr(_NESTED).alias("body"))
    return nested.union(table(spark, folder, "events").select(-F.col("event_id") - 1, "props"))


@query("json_to_flat", f"""
WITH {v.MON}, p(path) AS (VALUES ('k'), ('user.id'), ('user.tags.0'), ('user.tags.1.deep.er'), ('rate'))
SELECT event_id, path, CASE path WHEN 'k' THEN CAST(k AS VARCHAR) WHEN 'user.id' THEN usr WHEN 'user.tags.0' THEN 't' || k % 3
  WHEN 'rate' THEN CASE WHEN k % 2 = 0 THEN '1.5' ELSE 'high' END ELSE 'true' END AS value FROM mon, p
UNION ALL SELECT -event_id - 1, 'k', CAST(k AS VARCHAR) FROM mon""")
def json_to_flat(spark, folder):
    rows = _bodies(spark, folder)
    return d.json_to_flat(rows, "event_id", "body").select("event_id", "path", "value")


@query("json_type_profile", f"""
WITH {v.MON}, p(path, type) AS (VALUES ('k', 'number'), ('user', 'object'), ('user.id', 'number'), ('user.tags', 'array'),
  ('user.tags.0', 'string'), ('user.tags.1', 'object'), ('user.tags.1.deep', 'object'), ('user.tags.1.deep.er', 'boolean'),
  ('user.none', 'object'), ('nil', 'null'), ('rate', 'either')),
n AS (SELECT path, CASE WHEN type <> 'either' THEN type WHEN k % 2 = 0 THEN 'number' ELSE 'string' END AS type FROM mon, p
  UNION ALL SELECT 'k', 'number' FROM mon)
SELECT path, type, count(*) AS n FROM n GROUP BY path, type""")
def json_type_profile(spark, folder):
    rows = _bodies(spark, folder)
    return d.json_nodes(rows, "event_id", "body").groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query("flat_to_json", f"""
WITH {v.MON}
SELECT event_id, '{{"m":' || CASE WHEN k % 2 = 0 THEN '"late \\"' || k || '\\""' ELSE '"early"' END || ',"a":{{"k":' || k || ',"b":{{"deep":' || k
  || '}}}},"z":' || CASE WHEN k % 3 = 0 THEN '"scalar"' ELSE '{{"x":1}}' END || '}}' AS json
FROM mon
UNION ALL SELECT -event_id - 1, '{{"k":' || k || '}}' FROM mon""")
def flat_to_json(spark, folder):
    k = F.col("k")
    rows = monitor_events(spark, folder)
    entry = lambda ord_, path, value: F.struct(F.lit(ord_).alias("ord"), F.lit(path).alias("path"), value.alias("value"))
    late = d.json_quote(F.concat(F.lit('late "'), k.cast("string"), F.lit('"')))
    none = F.lit(None).cast("string")
    entries = F.array(
        entry(1, "m", F.lit('"early"')), entry(2, "a.k", k.cast("string")), entry(3, "a.b.deep", k.cast("string")),
        entry(4, "m", F.when(k % 2 == 0, late)), entry(5, "z.x", F.lit("1")),
        entry(6, "z", F.when(k % 3 == 0, F.lit('"scalar"')).otherwise(none)))
    flat = rows.select("event_id", F.inline(F.filter(entries, lambda e: e["value"].isNotNull())))
    # The flat rows of the events' own texts; numbers are JSON text as they are.
    own = table(spark, folder, "events").select((-F.col("event_id") - 1).alias("event_id"), "props")
    own = d.json_to_flat(own, "event_id", "props")
    value = F.when(F.col("type") == "string", d.json_quote(F.col("value"))).otherwise(F.col("value"))
    return d.flat_to_json(flat.union(own.select("event_id", F.lit(1), "path", value)), "event_id")


_TYPED = """CASE event_id % 4 WHEN 0 THEN 'plain ' || event_type WHEN 1 THEN 'json:[1,2'
  WHEN 2 THEN 'json:true' ELSE 'json:[' || event_id || ',null]' END"""


@query("typed_value_expand", f"""
WITH t AS (SELECT event_id, 'p' || event_id % 4 AS path, event_id % 4 AS shape, {_TYPED} AS value, {_K} AS k FROM events
  UNION ALL SELECT event_id, 'props', 4, 'json:' || props, {_K} FROM events)
SELECT event_id, path, shape <> 1 AS success, CASE shape WHEN 0 THEN 'string' WHEN 2 THEN 'boolean' WHEN 3 THEN 'array' WHEN 4 THEN 'object' END AS type,
  CASE shape WHEN 0 THEN value WHEN 2 THEN 'true' WHEN 3 THEN '[' || event_id || ',null]' WHEN 4 THEN '{{"k":' || k || '}}' END AS expanded,
  CASE WHEN shape = 1 THEN 'cannot parse ' || value END AS reason FROM t""")
def typed_value_expand(spark, folder):
    events = table(spark, folder, "events")
    rows = events.select(
        "event_id", F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("path"), F.expr(_TYPED).alias("value"))
    rows = rows.union(events.select("event_id", F.lit("props"), F.concat(F.lit("json:"), "props")))
    return d.expand_typed(rows, "value").drop("value")


@query("augment_merge", f"""
WITH {v.MON}, base AS (SELECT event_id, 'k' AS path, CAST(k AS VARCHAR) AS value, 'number' AS type FROM mon
  UNION ALL SELECT event_id, 'kind', key, 'string' FROM mon),
more AS (SELECT event_id, 'k' AS path, CASE k % 4 WHEN 0 THEN '0' WHEN 1 THEN CAST(k + 1 AS VARCHAR) WHEN 2 THEN NULL ELSE '7' END AS value, 'number' AS type FROM mon
  UNION ALL SELECT event_id, 'kind', CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'true' ELSE 'other' END, 'string' FROM mon WHERE k % 5 <> 0
  UNION ALL SELECT event_id, 'extra', 'false', CASE WHEN k % 2 = 0 THEN 'string' ELSE 'boolean' END FROM mon),
j AS (SELECT event_id, path, b.value AS b, b.type AS bt, m.value AS m, m.type AS mt, b.path IS NOT NULL AS in_b, m.path IS NOT NULL AS in_m
  FROM base b FULL JOIN more m USING (event_id, path)),
k AS (SELECT *, in_m AND coalesce(m, '') <> '' AND NOT (mt = 'number' AND m = '0') AND NOT (mt = 'boolean' AND m = 'false') AS takes FROM j)
SELECT event_id, path, CASE WHEN in_m THEN m ELSE b END AS overwritten, CASE WHEN in_b AND in_m THEN m WHEN in_b THEN b END AS patched,
  CASE WHEN takes THEN m ELSE b END AS deep, CASE WHEN takes AND mt = 'string' AND m IN ('true', 'false') THEN 'boolean' WHEN takes THEN mt ELSE bt END AS deep_type FROM k""")
def augment_merge(spark, folder):
    rows, k = monitor_events(spark, folder), F.col("k")
    entry = lambda path, value, kind: F.struct(F.lit(path).alias("path"), value.alias("value"), kind.alias("type"))
    number, string = F.lit("number"), F.lit("string")
    # The base are the flat rows of the events' own texts, and one more.
    own = d.json_to_flat(table(spark, folder, "events"), "event_id", "props").select("event_id", "path", "value", "type")
    base = own.union(rows.select("event_id", F.inline(F.array(entry("kind", F.col("key"), string)))))
    more_k = F.when(k % 4 == 0, "0").when(k % 4 == 1, (k + 1).cast("string")).when(k % 4 == 3, "7")
    more_kind = F.when(k % 3 == 0, "").when(k % 3 == 1, "true").otherwise("other")
    extra = entry("extra", F.lit("false"), F.when(k % 2 == 0, "string").otherwise("boolean"))
    more = rows.select("event_id", F.inline(F.when(k % 5 != 0, F.array(
        entry("k", more_k, number), entry("kind", more_kind, string), extra)).otherwise(F.array(entry("k", more_k, number), extra))))
    return d.merge_rows(base, more, ["event_id", "path"])


# The same character class in a form the checking engine reads.
_WS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
_KEEP = r"""a-zA-Z0-9\-@.<>="''_\\&,/""" + _WS[1:-1]
_TEXTS = """'  ' || text || CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) || ' x' ELSE chr(10) END"""


@query("text_hygiene", f"""
WITH t AS (SELECT doc_id, source, {_TEXTS} AS raw FROM documents),
c AS (SELECT doc_id, source, raw, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS trimmed FROM t),
p AS (SELECT *, regexp_replace(trimmed, '[^{_KEEP}]', '', 'g') AS printable FROM c)
SELECT doc_id, source, length(trimmed) AS trimmed_chars, md5(printable) AS printable_md5,
  md5(replace(replace(raw, chr(13), ''), chr(10), '')) AS joined_md5,
  md5(replace(replace(raw, chr(13), '$ '), chr(10), '$ ')) AS spaced_md5,
  md5(replace(replace(raw, chr(13), chr(13) || '|'), chr(10), chr(10) || '|')) AS marked_md5,
  NOT regexp_matches(raw, '[A-Z]') AS no_capitals FROM p""")
def text_hygiene(spark, folder):
    raw = F.col("raw")
    rows = table(spark, folder, "documents").select("doc_id", "source", F.expr(_TEXTS).alias("raw"))
    digest = lambda c: F.md5(F.encode(c, "utf-8"))
    return rows.select(
        "doc_id", "source", F.length(d.trim_white(raw)).alias("trimmed_chars"), digest(d.printable(raw)).alias("printable_md5"),
        digest(d.clean_breaks(raw)).alias("joined_md5"), digest(d.clean_breaks(raw, "$ ")).alias("spaced_md5"),
        digest(d.clean_breaks(raw, "|", keep=True)).alias("marked_md5"), d.no_capitals(raw).alias("no_capitals"))


@query("text_hygiene_report", f"""
WITH t AS (SELECT source, {_TEXTS} AS raw FROM documents),
c AS (SELECT source, raw, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS trimmed FROM t)
SELECT source, count(*) AS texts, CAST(sum(length(raw) - length(trimmed)) AS BIGINT) AS trimmed_chars,
  CAST(sum(length(trimmed) - length(regexp_replace(trimmed, '[^{_KEEP}]', '', 'g'))) AS BIGINT) AS unprintable_chars,
  CAST(sum(length(raw) - length(replace(replace(raw, chr(13), ''), chr(10), ''))) AS BIGINT) AS breaks FROM c GROUP BY source""")
def text_hygiene_report(spark, folder):
    raw = F.col("raw")
    rows = table(spark, folder, "documents").select("source", F.expr(_TEXTS).alias("raw"))
    rows = rows.withColumn("trimmed", d.trim_white(raw))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("raw") - F.length("trimmed")).alias("trimmed_chars"),
        F.sum(F.length("trimmed") - F.length(d.printable(F.col("trimmed")))).alias("unprintable_chars"),
        F.sum(F.length("raw") - F.length(d.clean_breaks(raw))).alias("breaks"))


TOKENS = [("the", "$THE"), ("$T", "(t)"), (" and ", " & "), ("e.", "E_"), ("(t)HE", "[x]\\"), ("[x]", "y")]


# What each token stands for as a pattern; a dot is any character.
_TOKEN_PATTERNS = {"the": "the", "$T": r"\$T", " and ": " and ", "e.": "e.", "(t)HE": r"\(t\)HE", "[x]": r"\[x\]"}


def _token_check():
    steps, source = ["t0 AS (SELECT doc_id, text AS c0 FROM documents)"], "t0"
    for i, (token, by) in enumerate(TOKENS):
        literal = by.replace("\\", "\\\\")
        steps.append(f"t{i + 1} AS (SELECT *, regexp_replace(c{i}, '{_TOKEN_PATTERNS[token]}', '{literal}', 'g') AS c{i + 1} FROM t{i})")
        source = f"t{i + 1}"
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{t}' AS token, count(*) FILTER (c{i} <> c{i + 1}) AS changed, CAST(sum(length(c{i + 1})) AS BIGINT) AS chars FROM {source}"
        for i, (t, _) in enumerate(TOKENS))
    return f"WITH {', '.join(steps)} {rows}"


@query("token_replace", _token_check())
def token_replace(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("text").alias("c0"))
    for i, token in enumerate(TOKENS):
        docs = docs.withColumn(f"c{i + 1}", d.replace_tokens(F.col(f"c{i}"), [token])[-1])
    counts = docs.agg(*[F.count(F.when(F.col(f"c{i}") != F.col(f"c{i + 1}"), 1)).alias(f"n{i}") for i in range(len(TOKENS))],
                      *[F.sum(F.length(f"c{i + 1}")).alias(f"l{i}") for i in range(len(TOKENS))])
    report = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("token"), F.col(f"n{i}").alias("changed"),
                                F.col(f"l{i}").alias("chars")) for i, (t, _) in enumerate(TOKENS)])
    return counts.select(F.inline(report))


def _age_check(seconds):
    # The units are stated here once more, so that the check does not follow the operator's.
    scale, cases = 1, []
    for unit, count in (("sec", 60), ("min", 60), ("hour", 24), ("day", 30), ("month", 12), ("year", 1000)):
        n = f"CAST(floor(abs({seconds}) / {float(scale)} + 0.5) AS BIGINT)"
        cases.append(f"WHEN abs({seconds}) < {scale * count} THEN CASE WHEN {n} < 10 THEN '0' ELSE '' END || {n} || ' {unit}' "
                     f"|| CASE WHEN {n} = 1 THEN ' ' ELSE 's' END || ' ' || CASE WHEN {seconds} < 0 THEN 'from now' ELSE 'ago' END")
        scale *= count
    return f"CASE {' '.join(cases)} ELSE 'N/A' END"


@query("relative_time_bucket", f"""
WITH r AS (SELECT max(epoch_us(ts)) // 1000000 - 3600 AS ref FROM events),
a AS (SELECT ref - epoch_us(ts) // 1000000 AS seconds FROM events, r),
b AS (SELECT {_age_check('seconds')} AS age FROM a)
SELECT age, count(*) AS n FROM b GROUP BY age""")
def relative_time_bucket(spark, folder):
    events = table(spark, folder, "events").select(F.floor(micros(F.col("ts")) / 1_000_000).cast("bigint").alias("at"))
    reference = (events.agg(F.max("at").alias("m")).select(F.col("m") - 3600)).scalar()
    ages = events.select((reference - F.col("at")).alias("seconds"))
    return ages.groupBy(d.age_text(F.col("seconds")).alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("datetime_parse", """
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS shape, o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS moment FROM orders)
SELECT o_orderkey, CASE WHEN shape IN (0, 1, 2) THEN 'sql' WHEN shape IN (3, 4) THEN 'words' ELSE 'N/A' END AS form,
  CASE WHEN shape < 5 THEN CAST(year(moment) AS INTEGER) END AS year, CASE WHEN shape < 5 THEN CAST(month(moment) AS INTEGER) END AS month,
  CASE WHEN shape < 5 THEN CAST(day(moment) AS INTEGER) END AS day, CASE WHEN shape < 5 THEN epoch_ms(moment) END AS epoch_ms,
  CASE WHEN shape < 5 THEN strftime(moment + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS shifted,
  CASE WHEN shape < 5 THEN strftime(moment + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') END AS later FROM o""")
def datetime_parse(spark, folder):
    key = F.col("o_orderkey")
    at = F.timestamp_micros(micros(F.col("o_orderdate")) + (key * 37 % 86400) * 1_000_000)
    shape = key % 6
    written = (F.when(shape < 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
               .when(shape < 5, F.date_format(at, "EEE MMM d HH:mm:ss 'PST' yyyy")).when(key % 4 == 0, "").when(key % 4 == 1, "soon"))
    rows = table(spark, folder, "orders").select("o_orderkey", written.alias("written"))
    rows = rows.withColumns(d.date_parts(F.coalesce("written", F.lit("")))).withColumn("epoch_ms", d.epoch_ms())
    return rows.select("o_orderkey", "form", "year", "month", "day", "epoch_ms",
                       d.date_text(d.shift_zone(F.col("epoch_ms"))).alias("shifted"),
                       d.date_text(F.col("epoch_ms") + 90_000).alias("later"))
