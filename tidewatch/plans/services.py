"""Queries over services, settings and key-value state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import services as s
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import rule_table, table
from tidewatch.sources.views import monitor_events

SUBSCRIPTIONS = [("svc_0", "a", True, 1), ("svc_0", "b", False, 2), ("svc_1", "a", True, 3), ("svc_0", "b", True, 4),
                 ("svc_1", "c", True, 5), ("svc_1", "c", False, 6), ("svc_9", "a", True, 7)]
COMPOSE = [("svc_0", "apps/zero"), ("svc_1", "apps/one"), ("svc_2", "apps/two"), ("svc_3", None), ("svc_4", "apps/four")]


@query("subscription_fanout", f"""
WITH {v.MON}, subs(service, module) AS (VALUES ('svc_0', 'a'), ('svc_0', 'b'), ('svc_1', 'a')),
n AS (SELECT event_id, CASE WHEN k % 17 <> 0 THEN service_name END AS service, CASE WHEN k % 13 <> 0 THEN key END AS source FROM mon)
SELECT event_id, service, source, module, CAST(NULL AS VARCHAR) AS reason, true AS success FROM n JOIN subs USING (service) WHERE source IS NOT NULL
UNION ALL SELECT event_id, service, source, NULL,
  CASE WHEN source IS NULL THEN 'please specify source' ELSE 'pass in a serviceName string' END, false
FROM n WHERE source IS NULL OR service IS NULL""")
def subscription_fanout(spark, folder):
    k = F.col("k")
    notes = monitor_events(spark, folder).select(
        "event_id", F.when(k % 17 != 0, F.col("service_name")).alias("service"),
        F.when(k % 13 != 0, F.col("key")).alias("source"))
    subscriptions = rule_table(spark, SUBSCRIPTIONS, "service string, module string, has_callback boolean, ord int")
    return s.fan_out(notes, subscriptions).select("event_id", "service", "source", "module", "reason", "success")


@query("compose_validate", f"""
WITH {v.MON}, compose(service, package) AS (VALUES ('svc_0', 'apps/zero'), ('svc_1', 'apps/one'), ('svc_2', 'apps/two'),
  ('svc_3', NULL), ('svc_4', 'apps/four')),
n AS (SELECT CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '' ELSE service_name END AS service FROM mon),
r AS (SELECT n.service, CASE WHEN coalesce(n.service, '') = '' THEN 'must specify service name in queryObject'
    WHEN c.service IS NULL THEN 'service is not defined in compose. please define: ' || n.service
    WHEN package IS NULL THEN 'please define pkgModuleString for config: ' || n.service END AS reason, package
  FROM n LEFT JOIN compose c ON c.service = n.service)
SELECT service, reason IS NULL AS success, reason, CASE WHEN reason IS NULL THEN '//inline/' || package END AS invoke_string,
  CASE WHEN reason IS NULL THEN '1' END AS user_id, count(*) AS n FROM r GROUP BY ALL""")
def compose_validate(spark, folder):
    k = F.col("k")
    calls = monitor_events(spark, folder).select(
        F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, "").otherwise(F.col("service_name")).alias("service"))
    compose = rule_table(spark, COMPOSE, "service string, package string")
    rows = s.validate_compose(calls, compose, user="1")
    return rows.groupBy("service", "success", "reason", "invoke_string", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("reuse_detect", f"""
WITH {v.MON}, c AS (SELECT CASE WHEN k % 2 = 0 THEN module ELSE module || '/' || service_name END AS module, service_name FROM mon)
SELECT module, count(DISTINCT service_name) AS contexts, 'warning' AS severity FROM c WHERE module <> 'app/m3'
GROUP BY module HAVING count(DISTINCT service_name) > 1""")
def reuse_detect(spark, folder):
    own = F.concat("module", F.lit("/"), "service_name")
    calls = monitor_events(spark, folder).select(
        F.when(F.col("k") % 2 == 0, F.col("module")).otherwise(own).alias("module"), "service_name")
    return s.detect_reuse(calls, "module", "service_name", rule_table(spark, [("app/m3",)], "module string"), "warning")


@query("kv_snapshot", f"""
WITH {v.MON}, log AS (SELECT 'kv' || user_id AS key, CASE key WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'delete' ELSE 'increment' END AS op,
    k AS value, ts_us, event_id FROM mon),
defaults(key, value) AS (VALUES ('kv0', 1), ('kv1', 1), ('kv2', 100), ('connectionId', 1)),
base AS (SELECT key, arg_max(op, (ts_us, event_id)) AS op, arg_max(value, (ts_us, event_id)) AS value,
    max((ts_us, event_id)) AS at FROM log WHERE op <> 'increment' GROUP BY key),
inc AS (SELECT log.key, count(*) AS n FROM log LEFT JOIN base USING (key) WHERE log.op = 'increment'
    AND (base.at IS NULL OR (log.ts_us, log.event_id) > base.at) GROUP BY log.key),
keys AS (SELECT key FROM log UNION SELECT key FROM defaults),
h AS (SELECT keys.key, CASE WHEN base.op IS NULL THEN defaults.value WHEN base.op = 'set' THEN base.value END AS held,
    coalesce(inc.n, 0) AS increments FROM keys LEFT JOIN base USING (key) LEFT JOIN defaults USING (key) LEFT JOIN inc USING (key))
SELECT key, CASE WHEN held IS NOT NULL THEN 'set' WHEN increments > 0 THEN 'nan' ELSE 'absent' END AS state, increments,
  held + increments AS value FROM h""")
def kv_snapshot(spark, folder):
    op = F.when(F.col("key") == "signup", "set").when(F.col("key") == "purchase", "delete").otherwise("increment")
    log = monitor_events(spark, folder).select(
        F.concat(F.lit("kv"), F.col("user_id").cast("string")).alias("key"), op.alias("op"),
        F.col("k").cast("bigint").alias("value"), "ts_us", "event_id")
    defaults = rule_table(spark, [("kv0", 1), ("kv1", 1), ("kv2", 100), ("connectionId", 1)], "key string, value bigint")
    return s.fold_changes(log, defaults)


@query("config_layers", """
WITH l AS (SELECT c_custkey, n_nationkey, r_regionkey, r_name,
    CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'http://' || lower(c_mktsegment) || ':80' || c_custkey % 10 || '/x' END AS user_url,
    CASE WHEN n_nationkey % 2 = 0 THEN 'http://' || lower(n_name) || '/base' END AS domain_url,
    CAST(floor(c_acctbal) AS BIGINT) % 4 AS user_retries, n_nationkey % 3 AS domain_retries,
    c_acctbal > 5000 AS user_verbose, n_nationkey % 5 = 0 AS domain_verbose
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT *, coalesce(nullif(user_url, ''), nullif(domain_url, ''), 'http://localhost:8080') AS target FROM l)
SELECT c_custkey, target, split_part(split_part(target, '/', 3), ':', 1) AS host,
  nullif(split_part(split_part(target, '/', 3), ':', 2), '') AS port,
  CASE WHEN user_retries <> 0 THEN user_retries WHEN domain_retries <> 0 THEN domain_retries ELSE r_regionkey + 1 END AS retries,
  user_verbose OR domain_verbose AS verbose,
  concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'mod' || c_custkey % 7 END,
    CASE WHEN c_custkey % 5 = 0 THEN 'interceptor/' || lower(r_name) || ',interceptor/last' END) AS modules FROM t""")
def config_layers(spark, folder):
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cust, nat = F.col("c_custkey"), F.col("n_nationkey")
    user_url = F.when(cust % 3 == 0, "").when(cust % 3 == 1, F.concat(
        F.lit("http://"), F.lower("c_mktsegment"), F.lit(":80"), (cust % 10).cast("string"), F.lit("/x")))
    domain_url = F.when(nat % 2 == 0, F.concat(F.lit("http://"), F.lower("n_name"), F.lit("/base")))
    target = s.layered(s.truthy_text(user_url), s.truthy_text(domain_url), F.lit("http://localhost:8080"))
    retries = s.layered(s.truthy_number(F.floor("c_acctbal") % 4), s.truthy_number(nat % 3), F.col("r_regionkey") + 1)
    verbose = s.layered(s.truthy_flag(F.col("c_acctbal") > 5000), s.truthy_flag(nat % 5 == 0), F.lit(False))
    modules = s.module_names(
        F.when(cust % 2 == 0, F.array(F.concat(F.lit("mod"), (cust % 7).cast("string")))),
        F.when(cust % 5 == 0, F.array(F.lower("r_name"), F.lit("last"))), "interceptor")
    rows = rows.select("c_custkey", target.alias("target"), retries.alias("retries"), verbose.alias("verbose"),
                       F.array_join(modules, ",").alias("modules"))
    return rows.withColumns(s.target_parts(F.col("target")))


ROUTE_COLUMNS = {
    "handler_mod": "backaddress", "domain": "address", "servicetype": "servicetype", "status": "status", "utcdt": "utcdt",
    "port": "port", "username": "username", "password": "password", "security": "security", "mfa": "mfa",
    "backpassword": "backpassword", "backusername": "backusername", "backport": "backport", "linkeduserid": "linkeduserid"}

_SERVICE_TABLE = [
    "s_suppkey", "'pkg:' || s_name AS backaddress", "lower(substr(s_name, 10)) || '.example.net' AS address",
    "CASE WHEN s_suppkey % 4 = 0 THEN 'SMTP' ELSE 'HTTP' END AS servicetype",
    "CASE WHEN s_acctbal > 1000 THEN 'Enabled' ELSE 'Disabled' END AS status", "'2024-01-01 00:00:00' AS utcdt",
    "s_nationkey + 8000 AS port", "'u' || s_suppkey AS username", "'' AS password", "'none' AS security",
    "s_suppkey % 2 = 0 AS mfa", "'' AS backpassword", "'b' || s_suppkey AS backusername",
    "s_nationkey + 9000 AS backport", "s_nationkey AS linkeduserid"]


@query("route_table_scan", f"""
WITH services AS (SELECT {', '.join(_SERVICE_TABLE)} FROM supplier)
SELECT {', '.join(f'{old} AS {new}' for new, old in ROUTE_COLUMNS.items())}
FROM services WHERE servicetype = 'HTTP' AND status = 'Enabled'""")
def route_table_scan(spark, folder):
    services = table(spark, folder, "supplier").selectExpr(*_SERVICE_TABLE)
    return s.route_rows(services, ROUTE_COLUMNS)


@query("route_union", """
SELECT 0 AS source_rank, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN '*.' ELSE '' END || s_nationkey || '.example.net' AS domain,
  s_name AS handler FROM supplier
UNION ALL SELECT 1, c_custkey, c_nationkey || '.example.net', c_name FROM customer""")
def route_union(spark, folder):
    net = F.lit(".example.net")
    local = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.concat(F.when(F.col("s_suppkey") % 3 == 0, "*.").otherwise(""), F.col("s_nationkey").cast("string"), net).alias("domain"),
        F.col("s_name").alias("handler"))
    remote = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.col("c_nationkey").cast("string"), net).alias("domain"),
        F.col("c_name").alias("handler"))
    return s.route_union(local, remote)
