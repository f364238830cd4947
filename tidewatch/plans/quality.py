"""Queries that check data against expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import quality as q
from tidewatch.plans.registry import query
from tidewatch.sources.tables import micros, table


def _reasons(rows, condition):
    return q.violations(rows, condition, []).groupBy("path", "op", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("expect_equal", """
WITH r AS (SELECT 'o_orderstatus' AS path, ' Expected o_orderstatus to equal O but got ' || o_orderstatus AS reason FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT 'o_orderpriority', ' Expected number but got string at o_orderpriority' FROM orders
  UNION ALL SELECT 'bucket', ' Expected bucket to equal 3 but got ' || o_custkey % 5 FROM orders WHERE o_custkey % 5 <> 3
  UNION ALL SELECT 'note', ' Expected string but got object at note' FROM orders WHERE o_custkey % 4 = 0
  UNION ALL SELECT 'gone', ' Expected boolean but got undefined at gone' FROM orders)
SELECT path, 'equal' AS op, reason, count(*) AS n FROM r GROUP BY ALL""")
def expect_equal(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 5).alias("bucket"),
        F.when(F.col("o_custkey") % 4 != 0, "n").alias("note"))
    return _reasons(rows, {"o_orderstatus": "O", "o_orderpriority": 3, "bucket": 3, "note": "n", "gone": True})


@query("expect_contain", """
WITH t AS (SELECT text, lang, n_chars FROM documents UNION ALL SELECT '', lang, 0 FROM documents WHERE doc_id % 9 = 0),
r AS (SELECT 'text' AS path, 'contain' AS op, CASE WHEN text = '' THEN '[words] Expected text to contain the but the property was missing.'
    ELSE '[words] Expected text to contain ''the''.' END AS reason FROM t WHERE NOT contains(text, 'the')
  UNION ALL SELECT 'lang', 'notcontain', '[words] Expected lang to not contain ''e''.' FROM t WHERE contains(lang, 'e')
  UNION ALL SELECT 'n_chars', 'contain', CASE WHEN n_chars = 0 THEN '[words] Expected n_chars to contain 3 but the property was missing.'
    ELSE '[words] Expected n_chars to contain ''3''.' END FROM t WHERE NOT contains(CAST(n_chars AS VARCHAR), '3'))
SELECT *, count(*) AS n FROM r GROUP BY ALL""")
def expect_contain(spark, folder):
    docs = table(spark, folder, "documents")
    none = docs.where("doc_id % 9 = 0").select(F.lit("").alias("text"), "lang", F.lit(0).cast("bigint").alias("n_chars"))
    rows = docs.select("text", "lang", "n_chars").union(none)
    return _reasons(rows, {"__contextName__": "words", "__operators__": {"text": "contain", "lang": "notcontain", "n_chars": "contain"},
                           "text": "the", "lang": "e", "n_chars": 3})


@query("expect_greater", """
WITH r AS (SELECT 'l_quantity' AS path, 'greater than' AS op,
    ' Expected l_quantity to be greater than 25 but got ' || regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS reason FROM lineitem WHERE l_quantity < 25
  UNION ALL SELECT 'l_linenumber', 'strictly greater than', ' Expected l_linenumber to be strictly greater than 2 but got ' || l_linenumber
  FROM lineitem WHERE l_linenumber <= 2)
SELECT *, count(*) AS n FROM r GROUP BY ALL""".replace("\\\\", "\\"))
def expect_greater(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_quantity", "l_linenumber")
    return _reasons(rows, {"__operators__": {"l_quantity": "greater than", "l_linenumber": "strictly greater than"},
                           "l_quantity": 25, "l_linenumber": 2})


@query("expect_same_length", """
WITH c AS (SELECT c_name, c_mktsegment, c_custkey FROM customer UNION ALL SELECT 'C' || c_custkey, c_mktsegment, c_custkey FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT 'c_name' AS path, ' Expected c_name to be have the length 18 but got ' || length(c_name) AS reason FROM c WHERE length(c_name) <> 18
  UNION ALL SELECT 'c_mktsegment', ' Expected c_mktsegment to be have the length 9 but got ' || length(c_mktsegment) FROM c WHERE length(c_mktsegment) <> 9
  UNION ALL SELECT 'c_custkey', ' Expected c_custkey to be string  but got number' FROM c)
SELECT path, 'same length' AS op, reason, count(*) AS n FROM r GROUP BY ALL""")
def expect_same_length(spark, folder):
    rows = table(spark, folder, "customer").select("c_name", "c_mktsegment", "c_custkey")
    short = rows.where("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("C"), F.col("c_custkey").cast("string")))
    rows = rows.union(short)
    names = ("c_name", "c_mktsegment", "c_custkey")
    return _reasons(rows, {"__operators__": dict.fromkeys(names, "same length"),
                           "c_name": "Customer#000000000", "c_mktsegment": "123456789", "c_custkey": 17})


_OPEN = """CASE event_id % 4 WHEN 0 THEN '{"a": "t", "b": null, "c": [], "d": {}}' WHEN 1 THEN '{"a": 1, "b": "x", "c": [1], "d": {"k": 1}}'
  WHEN 2 THEN '{"a": true, "b": 2, "c": {}, "d": "s"}' ELSE '{"a": "t", "b": null, "c": [], "d": [], "extra": 1}' END"""


@query("expect_type_null_empty", """
WITH s AS (SELECT event_id % 4 AS shape FROM events UNION ALL SELECT 4 FROM events),
v(shape, path, op, reason) AS (VALUES
  (1, 'a', 'equal', ' Expected string but got number at a'), (1, 'b', 'equal', ' Expected object but got string at b'),
  (1, 'c', 'empty', ' Expected an empty array/object for c but it was non-empty.'), (1, 'd', 'empty', ' Expected an empty array/object for d but it was non-empty.'),
  (2, 'a', 'equal', ' Expected string but got boolean at a'), (2, 'b', 'equal', ' Expected object but got number at b'),
  (2, 'd', 'empty', ' Expected object but got string at d'),
  (4, 'a', 'equal', ' Expected string but got undefined at a'), (4, 'b', 'equal', ' Expected object but got undefined at b'),
  (4, 'c', 'empty', ' Expected object but got undefined at c'), (4, 'd', 'empty', ' Expected object but got undefined at d'))
SELECT path, op, reason, count(*) AS n FROM s JOIN v USING (shape) GROUP BY ALL
UNION ALL SELECT 'v.k', 'equal', ' Expected v.k to equal 7 but got ' || json_extract_string(props, '$.k'), count(*) FROM events
  WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) <> 7 GROUP BY ALL
UNION ALL SELECT 'list.0', 'equal', ' Expected list.0 to equal 10000000 but got ' || (10000000 + event_id % 3), count(*) FROM events WHERE event_id % 3 > 0 GROUP BY ALL
UNION ALL SELECT 'list.1', 'equal', ' Expected string but got undefined at list.1', count(*) FROM events WHERE event_id % 5 = 0
UNION ALL SELECT 'map.a', 'equal', ' Expected map.a to equal x but got ' || event_type, count(*) FROM events WHERE event_id % 2 = 0 AND event_type <> 'x' GROUP BY ALL
UNION ALL SELECT 'map.a', 'equal', ' Expected string but got undefined at map.a', count(*) FROM events WHERE event_id % 2 = 1
UNION ALL SELECT 'pair', 'empty', ' Expected an empty array/object for pair but it was non-empty.', count(*) FROM events""")
def expect_type_null_empty(spark, folder):
    events = table(spark, folder, "events")
    shapes = events.select(F.try_parse_json(F.expr(_OPEN)).alias("v")).union(events.select(F.try_parse_json("props")))
    rows = shapes.select(*[F.try_variant_get("v", f"$.{p}", "variant").alias(p) for p in "abcd"])
    found = q.violations(rows, {"a": "t", "b": None, "c": {}, "d": {}}, [])
    # Lists by position, maps and structs by key, open JSON in place, a number above 10^7.
    eid = F.col("event_id")
    number = F.concat((eid % 3 + 10_000_000).cast("string"), F.lit(".0"))
    texts = F.array(number, F.lit("n"))
    typed = events.select(
        F.try_parse_json("props").alias("v"),
        F.when(eid % 5 == 0, F.slice(texts, 1, 1)).otherwise(texts).alias("texts"),
        F.when(eid % 2 == 0, F.create_map(F.lit("a"), "event_type")).otherwise(F.create_map(F.lit("b"), "event_type")).alias("map"),
        F.struct("event_id", "event_type").alias("pair"))
    numbers = typed.select(F.transform("texts", lambda t: t.try_cast("double")).alias("list"), "texts", "v", "map", "pair")
    more = q.violations(numbers.select("list"), {"list": [10_000_000.0]}, [])
    words = q.violations(typed.select(F.col("texts").alias("list")), {"list": {"1": "n"}}, [])
    keyed = q.violations(typed, {"v": {"k": 7}, "map": {"a": "x"}, "pair": {}}, [])
    every = found.union(more).union(words).union(keyed)
    return every.groupBy("path", "op", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("expect_suite", """
WITH s AS (SELECT l_quantity, l_returnflag, l_linestatus, o_orderstatus, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN NOT contains(l_returnflag, 'A') THEN 1 WHEN l_linestatus <> 'F' THEN 2
    WHEN contains(o_orderpriority, 'URGENT') THEN 3 ELSE 4 END AS ord, l_quantity, l_returnflag, l_linestatus, o_orderstatus FROM s)
SELECT ord, CASE ord WHEN 0 THEN 'line.quantity' WHEN 1 THEN 'line.flag' WHEN 2 THEN 'line.status' WHEN 3 THEN 'priority' ELSE 'state' END AS path,
  CASE ord WHEN 0 THEN 'greater than' WHEN 1 THEN 'contain' WHEN 2 THEN 'equal' WHEN 3 THEN 'notcontain' ELSE 'like' END AS op,
  CASE ord WHEN 0 THEN '[suite] Expected line.quantity to be greater than 10 but got ' || regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') WHEN 1 THEN '[suite] Expected line.flag to contain ''A''.'
    WHEN 2 THEN '[suite] Expected line.status to equal F but got ' || l_linestatus
    WHEN 3 THEN '[suite] Expected priority to not contain ''URGENT''.' ELSE '[suite] Unknown operator "like"' END AS reason, count(*) AS n
FROM r GROUP BY ALL""")
def expect_suite(spark, folder):
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
                                 F.col("l_linestatus").alias("status")).alias("line"),
                        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"))
    condition = {"__contextName__": "suite", "__operators__": {"priority": "notcontain", "state": "like"},
                 "line": {"__operators__": {"quantity": "greater than", "flag": "contain"}, "quantity": 10, "flag": "A", "status": "F"},
                 "priority": "URGENT", "state": "O"}
    first = q.check(rows, condition).where("first_violation IS NOT NULL").select("first_violation.*")
    return first.groupBy("ord", "path", "op", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("expect_outcome", """
WITH b AS (SELECT o_orderkey, o_totalprice < 1000 AS low, o_orderstatus FROM orders)
SELECT count(*) FILTER (low OR o_orderstatus <> 'O') = 0 AS success, count(*) AS "rows", count(*) FILTER (low OR o_orderstatus <> 'O') AS violating,
  (SELECT '[orders] Expected o_orderstatus to equal O but got ' || o_orderstatus FROM b WHERE low OR o_orderstatus <> 'O' ORDER BY o_orderkey LIMIT 1) AS reason
FROM b""")
def expect_outcome(spark, folder):
    condition = {"__contextName__": "orders", "o_orderstatus": "O", "__operators__": {"o_totalprice": "greater than"}, "o_totalprice": 1000}
    return q.outcome(table(spark, folder, "orders"), condition, ["o_orderkey"])


def _two_sides(spark, folder):
    e = table(spark, folder, "events").select("event_id", micros(F.col("ts")).alias("ts_us"), "event_type", "value", "props")
    eid = F.col("event_id")
    other = e.withColumns({
        "event_type": F.when(eid % 10 == 0, "changed").when(eid % 13 == 0, F.lit(None)).otherwise(F.col("event_type")),
        "value": F.when(eid % 7 == 0, F.col("value") + 1).otherwise(F.col("value")),
        "event_id": F.when(eid % 103 == 0, -eid - 1).otherwise(eid)})
    return e, other


_OTHER = """o AS (SELECT CASE WHEN event_id % 103 = 0 THEN -event_id - 1 ELSE event_id END AS event_id, epoch_us(ts) AS ts_us,
    CASE WHEN event_id % 10 = 0 THEN 'changed' WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value, props FROM events),
e AS (SELECT event_id, epoch_us(ts) AS ts_us, event_type, value, props FROM events)"""


@query("parity_diff", f"""
WITH {_OTHER}, j AS (SELECT e.event_id AS l, o.event_id AS r, e.event_type AS et, o.event_type AS ot, e.value AS ev, o.value AS ov,
    e.ts_us AS es, o.ts_us AS os, e.props AS ep, o.props AS op FROM e FULL JOIN o ON e.event_id = o.event_id)
SELECT subject, differing FROM (
  SELECT 'only left' AS subject, count(*) FILTER (r IS NULL) AS differing FROM j UNION ALL SELECT 'only right', count(*) FILTER (l IS NULL) FROM j
  UNION ALL SELECT 'repeated keys', 0
  UNION ALL SELECT 'ts_us', count(*) FILTER (l = r AND es IS DISTINCT FROM os) FROM j
  UNION ALL SELECT 'event_type', count(*) FILTER (l = r AND et IS DISTINCT FROM ot) FROM j
  UNION ALL SELECT 'value', count(*) FILTER (l = r AND ev IS DISTINCT FROM ov) FROM j
  UNION ALL SELECT 'props', count(*) FILTER (l = r AND ep IS DISTINCT FROM op) FROM j)""")
def parity_diff(spark, folder):
    return q.parity(*_two_sides(spark, folder), ["event_id"])


@query("parity_rows", f"""
WITH {_OTHER}
SELECT *, 'left' AS side FROM (SELECT event_id, event_type, value FROM e EXCEPT ALL SELECT event_id, event_type, value FROM o)
UNION ALL SELECT *, 'right' FROM (SELECT event_id, event_type, value FROM o EXCEPT ALL SELECT event_id, event_type, value FROM e)""")
def parity_rows(spark, folder):
    left, right = (side.select("event_id", "event_type", "value") for side in _two_sides(spark, folder))
    return q.one_sided(left, right)
