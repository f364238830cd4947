"""Queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import requests as r
from tidewatch.plans import view_sql as v
from tidewatch.plans.registry import query
from tidewatch.sources.tables import rule_table, table
from tidewatch.sources.views import requests

DENIED = ["badbot"]
BYPASS = ["blog.", "www."]
ROUTES = [(1, "*.ththth.example.net", "h1"), (2, "therin.example.net", "h2"),
          (3, "*.example.com", "h3"), (4, "*.example.org", "h4")]
EPOCH_US = 1_704_067_200_000_000


@query("access_log_append", rf"""
WITH {v.REQ}, a AS (
  SELECT *, CASE WHEN req_id % 2 = 0 THEN ip END AS forwarded, '192.168.1.' || (req_id % 200) AS peer FROM req),
b AS (SELECT *, string_split(coalesce(forwarded, peer), '.') AS q FROM a)
SELECT strftime(make_timestamp({EPOCH_US} + req_id * 61500000), '%Y-%m-%d %H:%M:%S') AS recordtm,
  base64(encode(host)) AS host, 'GET' AS method, target AS path,
  CASE WHEN req_id % 6 = 0 OR scheme = 'https' THEN 'https' ELSE 'http' END AS scheme,
  CAST(q[1] AS BIGINT) * 16777216 + CAST(q[2] AS BIGINT) * 65536 + CAST(q[3] AS BIGINT) * 256 + CAST(q[4] AS BIGINT) AS ipv4,
  base64(encode(CASE WHEN req_id % 3 = 0 THEN 'text/html' ELSE '' END)) AS accept, '' AS cookie,
  base64(encode('http://' || host || '/from?u=' || host)) AS referer,
  base64(encode(coalesce(agent, ''))) AS useragent, md5(coalesce(agent, 'undefined')) AS useragentmd5
FROM b""")
def access_log_append(spark, folder):
    req = requests(spark, folder)
    rid = F.col("req_id")
    extra = F.map_filter(F.create_map(
        F.lit("user-agent"), F.col("agent"),
        F.lit("x-forwarded-for"), F.when(rid % 2 == 0, F.col("ip")),
        F.lit("x-original-request-is-ssl"), F.when(rid % 6 == 0, F.lit("yes")),
        F.lit("accept"), F.when(rid % 3 == 0, F.lit("text/html"))), lambda _, value: value.isNotNull())
    return r.access_rows(req.select("target", "scheme", F.map_concat("headers", extra).alias("headers"),
                                    (F.lit(EPOCH_US) + rid * 61_500_000).alias("recorded_us"),
                                    F.concat(F.lit("192.168.1."), (rid % 200).cast("string")).alias("peer")))


@query("agent_denylist", f"""
WITH {v.REQ}
SELECT req_id, agent, CASE WHEN contains(coalesce(agent, ''), 'badbot') THEN 404 ELSE 200 END AS status FROM req""")
def agent_denylist(spark, folder):
    denied = r.agent_denied(F.col("agent"), DENIED)
    return requests(spark, folder).select("req_id", "agent", F.when(denied, 404).otherwise(200).alias("status"))


_TARGETS = """CASE req_id % 11 WHEN 0 THEN '/ROBOTS.txt' WHEN 1 THEN '/status' WHEN 2 THEN '/apigateway/key/cli?run'
  WHEN 3 THEN '/apigateway/key%2Fcli' WHEN 4 THEN '/apigateway/other:x' ELSE '/apigateway/key/pkg' || target END"""
_RESOURCES = """CASE req_id % 3 WHEN 0 THEN '/api?beacon.gif' WHEN 1 THEN '/api?other' ELSE '/api' END"""


@query("gateway_status", f"""
WITH {v.REQ}, t AS (SELECT req_id, agent, method, {_TARGETS} AS target, {_RESOURCES} AS resource FROM req),
s AS (SELECT CASE WHEN contains(coalesce(agent, ''), 'badbot') THEN 404 WHEN lower(target) = '/robots.txt' THEN 200
    WHEN target = '/status' THEN 200 WHEN method = 'OPTIONS' THEN 200
    WHEN NOT starts_with(target, '/apigateway/key/') AND target <> '/apigateway/key%2Fcli' THEN 404
    WHEN target IN ('/apigateway/key/cli?run', '/apigateway/key%2Fcli') THEN 400
    WHEN method <> 'POST' THEN 401 ELSE 200 END AS status,
  CASE WHEN method IN ('OPTIONS', 'POST') THEN 200 WHEN method <> 'GET' THEN 401
    WHEN resource = '/api?beacon.gif' THEN 200 ELSE 404 END AS resource_status FROM t)
SELECT status, resource_status, count(*) AS n FROM s GROUP BY ALL""")
def gateway_status(spark, folder):
    req = requests(spark, folder).select("req_id", "agent", "method", F.expr(_TARGETS).alias("target"),
                                         F.expr(_RESOURCES).alias("resource"))
    config = r.Gateway(tuple(DENIED), invoke_prefix="key/")
    rows = req.withColumn("status", r.gateway_status(config))
    rows = rows.withColumn("target", F.col("resource")).withColumn("resource_status", r.resource_status(["beacon.gif"]))
    return r.count_by(rows, "status", "resource_status")


@query("proxy_bypass", f"""
WITH {v.REQ}
SELECT CASE WHEN contains(url, 'blog.') OR contains(url, 'www.') THEN 'direct' ELSE 'proxy' END AS via, scheme,
  count(*) AS n FROM req GROUP BY ALL""")
def proxy_bypass(spark, folder):
    return r.count_by(requests(spark, folder).withColumn("via", r.proxy_choice(F.col("url"), BYPASS)), "via", "scheme")


@query("conditional_rewrite", f"""
WITH {v.REQ}, x AS (SELECT *, CASE WHEN contains(url, '/es/') THEN 'balance' WHEN contains(url, '/fr/') THEN 'moved'
  WHEN regexp_matches(url, 'utm_source') THEN 'tagged' END AS module FROM req)
SELECT req_id, module, CASE WHEN module = 'balance' THEN 'box-1:80' ELSE host END AS proxy_target,
  CASE module WHEN 'moved' THEN 302 WHEN 'tagged' THEN 204 ELSE 200 END AS status,
  CASE WHEN module = 'balance' THEN '80' END AS forwarded_port,
  CASE WHEN module = 'moved' THEN 'moved to ' || host ELSE target END AS body FROM x""")
def conditional_rewrite(spark, folder):
    url = F.col("url")
    req = requests(spark, folder).withColumns({
        "proxy_target": F.col("host"), "status": F.lit(200), "forwarded_port": F.lit(None).cast("string"),
        "body": F.col("target")})
    modules = [
        ("balance", F.contains(url, F.lit("/es/")), {"proxy_target": F.lit("box-1:80"), "forwarded_port": F.lit("80")}),
        ("moved", F.contains(url, F.lit("/fr/")),
         {"status": F.lit(302), "body": F.concat(F.lit("moved to "), "host")}),
        ("tagged", F.rlike(url, F.lit("utm_source")), {"status": F.lit(204), "body": F.lit(None).cast("string")}),
    ]
    rows = r.conditional_rewrite(req, modules)
    return rows.select("req_id", "module", "proxy_target", "status", "forwarded_port", "body")


@query("domain_route", f"""
WITH {v.REQ}, routes(ord, route, handler) AS (VALUES (1, '*.ththth.example.net', 'h1'),
  (2, 'therin.example.net', 'h2'), (3, '*.example.com', 'h3'), (4, '*.example.org', 'h4')),
d AS (SELECT req_id, split_part(host, ':', 1) AS domain FROM req),
m AS (SELECT req_id, min(ord) AS ord FROM d JOIN routes ON domain = route
    OR (starts_with(route, '*.') AND (ends_with(domain, substr(route, 2)) OR domain = substr(route, 3))) GROUP BY req_id)
SELECT d.req_id, domain, m.ord, handler FROM d LEFT JOIN m USING (req_id) LEFT JOIN routes ON routes.ord = m.ord""")
def domain_route(spark, folder):
    routes = rule_table(spark, ROUTES, "ord int, route string, handler string")
    return r.domain_routes(requests(spark, folder), routes).select("req_id", "domain", "ord", "handler")


# Routes are loaded anew every minute of a request log with one request in seven seconds.
RELOAD_SECONDS = 60
LOCAL_ROUTES = [(1, "*.ththth.example.net", "h1"), (2, "therin.example.net", "h2")]


@query("refreshing_dimension", f"""
WITH {v.REQ}, d AS (SELECT req_id, req_id * 7 // {RELOAD_SECONDS} AS load, split_part(host, ':', 1) AS domain FROM req),
loads AS (SELECT DISTINCT load FROM d),
local(ord, route, handler) AS (VALUES (1, '*.ththth.example.net', 'h1'), (2, 'therin.example.net', 'h2')),
remote(ord, route, handler) AS (VALUES (1, '*.example.com', 'h3'), (2, '*.example.net', 'h4')),
routes AS (SELECT load, 0 AS source_rank, ord, route, handler FROM loads, local
  UNION ALL SELECT load, 1, ord, route, handler || '.' || load FROM loads, remote WHERE load % 3 <> 1),
m AS (SELECT req_id, min((source_rank, ord)) AS best FROM d JOIN routes ON d.load = routes.load AND (domain = route
    OR (starts_with(route, '*.') AND (ends_with(domain, substr(route, 2)) OR domain = substr(route, 3)))) GROUP BY req_id)
SELECT d.req_id, d.load, domain, source_rank, ord, handler FROM d LEFT JOIN m USING (req_id)
LEFT JOIN routes ON (routes.source_rank, routes.ord) = m.best AND routes.load = d.load""")
def refreshing_dimension(spark, folder):
    load = F.floor(F.col("req_id") * 7 / RELOAD_SECONDS).cast("bigint")
    log = requests(spark, folder).select("req_id", load.alias("load"), "host")
    shape = "ord int, route string, handler string"
    # Every third load failed; a good one brings two routes named after it.
    loads = log.select("load").distinct()
    named = lambda h: F.concat(F.lit(f"{h}."), F.col("load").cast("string"))
    remote = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(route).alias("route"), named(h).alias("handler"))
                       for i, route, h in [(1, "*.example.com", "h3"), (2, "*.example.net", "h4")]])
    loaded = loads.select("load", F.inline(F.when(F.col("load") % 3 != 1, remote)))
    rows = r.routes_by_load(log, rule_table(spark, LOCAL_ROUTES, shape), loaded, "load")
    return rows.select("req_id", "load", "domain", "source_rank", "ord", "handler")


@query("alias_rewrite", rf"""
WITH {v.REQ}, n AS (
  SELECT req_id, split_part(host, ':', 1) AS domain,
    CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS path
  FROM (SELECT *, regexp_extract(target, '^([^?#]*)', 1) AS p FROM req))
SELECT req_id, domain, path, regexp_replace(regexp_replace('http://' || domain || path, '\.example\.net', '.main.test'),
  'e', '.main.test') AS url FROM n""")
def alias_rewrite(spark, folder):
    url = r.alias_rewrite(F.col("host"), F.col("target"), [".example.net", "e"], ".main.test")
    return requests(spark, folder).select("req_id", r.domain_of(F.col("host")).alias("domain"),
                                          r.path_of(F.col("target")).alias("path"), url.alias("url"))


@query("intercept_override", f"""
WITH {v.REQ}, c AS (SELECT req_id, CASE WHEN req_id % 9 = 0 THEN '//service/' || host || '?x/es/'
    WHEN req_id % 7 = 0 THEN 'plain/es/' ELSE url END AS call, req_id % 3 <> 0 AS own FROM req),
m AS (SELECT *, CASE WHEN NOT (starts_with(call, '//') OR starts_with(call, 'http://') OR starts_with(call, 'https://'))
    OR starts_with(call, '//service/') THEN NULL WHEN regexp_matches(call, '/es/[0-9]') THEN 'spanish'
    WHEN regexp_matches(call, 'utm_source') THEN 'tagged' END AS rule FROM c)
SELECT req_id, rule, CASE rule WHEN 'spanish' THEN false WHEN 'tagged' THEN true ELSE own END AS success,
  CASE WHEN rule = 'spanish' THEN 'intercepted' END AS reason FROM m""")
def intercept_override(spark, folder):
    rules = [r.Intercept("spanish", "/old/", True), r.Intercept("tagged", "utm_source", True),
             r.Intercept("spanish", "/es/[0-9]")]
    rid = F.col("req_id")
    call = (F.when(rid % 9 == 0, F.concat(F.lit("//service/"), "host", F.lit("?x/es/")))
            .when(rid % 7 == 0, "plain/es/").otherwise(F.col("url")))
    calls = requests(spark, folder).select("req_id", call.alias("call"), (rid % 3 != 0).alias("own"))
    calls = r.intercept(calls, "call", rules)
    return calls.select("req_id", "rule", F.coalesce("forced_success", "own").alias("success"),
                        F.col("forced_reason").alias("reason"))


@query("handler_first_match", f"""
WITH {v.REQ}
SELECT CASE WHEN contains(target, '/de/') THEN 'german' WHEN scheme = 'http' THEN 'plain' ELSE 'default' END AS handler,
  CASE WHEN contains(target, '/de/') AND req_id % 4 = 0 THEN 500 ELSE 200 END AS status, count(*) AS n
FROM req GROUP BY ALL""")
def handler_first_match(spark, folder):
    target = F.col("target")
    german = F.contains(target, F.lit("/de/"))
    handlers = [r.Handler("socket", F.lit(True), custom=True), r.Handler("broken", F.lit(True), loaded=False),
                r.Handler("german", german, throws=german & (F.col("req_id") % 4 == 0)),
                r.Handler("plain", F.col("scheme") == "http")]
    return r.count_by(requests(spark, folder).withColumns(r.handler_choice(handlers)), "handler", "status")


@query("token_owner_join", f"""
WITH {v.REQ}, t AS (SELECT req_id, CASE WHEN req_id % 5 = 0 THEN 'undefined' WHEN req_id % 5 = 1 THEN 'unknown'
    ELSE 'tok' || (req_id * 7) END AS token FROM req)
SELECT req_id, token, c_custkey AS owner_id, 1 AS owner_type FROM t LEFT JOIN customer ON token = 'tok' || c_custkey""")
def token_owner_join(spark, folder):
    rid = F.col("req_id")
    bearer = (F.when(rid % 10 == 0, F.lit(None)).when(rid % 5 == 0, "Bearer").when(rid % 5 == 1, "Bearer unknown")
              .otherwise(F.concat(F.lit("Bearer tok"), (rid * 7).cast("string"))))
    tokens = table(spark, folder, "customer").select(
        F.concat(F.lit("tok"), F.col("c_custkey").cast("string")).alias("token"), F.col("c_custkey").alias("owner_id"))
    calls = requests(spark, folder).select("req_id", bearer.alias("authorization"))
    return r.token_owners(calls, tokens).select("req_id", "token", "owner_id", "owner_type")


_SERVICE = """CASE req_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'inline' WHEN 2 THEN 'localhost' ELSE host END"""


@query("gateway_resolve", f"""
WITH {v.REQ}, s AS (SELECT req_id, {_SERVICE} AS service, CASE WHEN req_id % 6 = 3 THEN scheme || '://' END AS prefix FROM req)
SELECT req_id, service, CASE WHEN service = 'inline' THEN 'inline'
    WHEN service = 'localhost' THEN 'http://localhost/apigateway/:' WHEN service = '' THEN NULL
    WHEN prefix IS NOT NULL THEN prefix || service || '/' ELSE 'https://' || service || '/apigateway/:' END AS url,
  CASE WHEN service IN ('inline', 'localhost') OR prefix IS NOT NULL THEN NULL
    WHEN service = '' THEN '/// launch string is ambigous, did you mean //inline/?'
    ELSE 'Cannot find the proper gateway for:' || service END AS strict_reason FROM s""")
def gateway_resolve(spark, folder):
    fixed = {"inline": "inline", "localhost": "http://localhost/apigateway/:"}
    calls = requests(spark, folder).select(
        "req_id", F.expr(_SERVICE).alias("service"),
        F.when(F.col("req_id") % 6 == 3, F.concat("scheme", F.lit("://"))).alias("prefix"))
    open_, strict = (r.gateway_url(F.col("service"), F.col("prefix"), fixed, s) for s in (False, True))
    return calls.select("req_id", "service", open_["url"].alias("url"), strict["reason"].alias("strict_reason"))


@query("ip_allowlist", f"""
WITH {v.REQ} SELECT req_id, ip, ip IN ('10.0.1.1', '10.0.2.10', '10.0.5.37', '10.0.0.200') AS allowed FROM req""")
def ip_allowlist(spark, folder):
    allowed = rule_table(spark, [("10.0.1.1",), ("10.0.2.10",), ("10.0.5.37",), ("10.0.0.200",)], "ip string")
    kept, rejected = r.split_allowed(requests(spark, folder).select("req_id", "ip"), allowed)
    return kept.withColumn("allowed", F.lit(True)).unionByName(rejected.withColumn("allowed", F.lit(False)))


@query("round_robin_assign", f"""
WITH {v.REQ}, n AS (SELECT req_id, row_number() OVER (ORDER BY req_id) AS nth FROM req WHERE contains(url, '/e'))
SELECT req_id, CASE nth % 3 WHEN 1 THEN 'box-1:80' WHEN 2 THEN 'box-2:80' ELSE 'box-3:80' END AS target_box FROM n""")
def round_robin_assign(spark, folder):
    matching = requests(spark, folder).where(F.contains("url", F.lit("/e"))).select("req_id")
    return r.round_robin(matching, ["req_id"], ["box-1:80", "box-2:80", "box-3:80"])


@query("header_rewrite", f"""
WITH {v.REQ}, rules(name) AS (VALUES ('host'), ('origin'), ('referer'), ('connection'), ('accept-encoding')),
b AS (SELECT req_id, name, CASE name WHEN 'host' THEN host WHEN 'origin' THEN scheme || '://' || host
    WHEN 'referer' THEN 'http://' || host || '/from?u=' || host WHEN 'connection' THEN 'keep-alive' ELSE 'gzip' END AS before
  FROM req, rules)
SELECT req_id, 'request.headers.' || name AS name, before,
  CASE name WHEN 'connection' THEN 'close' WHEN 'accept-encoding' THEN NULL
    ELSE regexp_replace(before, 'example', 'inner') END AS after, 4 AS headers_left FROM b
UNION ALL SELECT req_id, 'response.headers.set-cookie', 'id=' || req_id || '; domain=inner.' || host || chr(10) || 'plain=1; inner=inner',
  'id=' || req_id || '; domain=example.' || host || chr(10) || 'plain=1; example=inner', 3 FROM req
UNION ALL SELECT req_id, 'response.headers.location', CASE WHEN req_id % 3 = 0 THEN NULL ELSE scheme || '://inner.' || host || target END,
  CASE WHEN req_id % 3 = 0 THEN '' ELSE scheme || '://example.' || host || target END, 3 FROM req WHERE req_id % 3 <> 0
UNION ALL SELECT req_id, 'response.headers.location', NULL, '', 2 FROM req WHERE req_id % 3 = 0""".replace(
    "|| 'plain=1; example=inner', 3 FROM", "|| 'plain=1; example=inner', CASE WHEN req_id % 3 = 0 THEN 2 ELSE 3 END FROM"))
def header_rewrite(spark, folder):
    new, audit = r.header_rewrite(F.col("headers"), r.REQUEST_RULES, "example", "inner", "request")
    rows = requests(spark, folder).select("req_id", F.size(new).alias("headers_left"), F.explode(audit).alias("a"))
    sent = rows.select("req_id", "a.name", "a.before", "a.after", "headers_left")

    # The answers: two cookies, a length, and a location for two in three.
    req = requests(spark, folder)
    cookies = F.array(F.concat(F.lit("id="), F.col("req_id").cast("string"), F.lit("; domain=inner."), "host"), F.lit("plain=1; inner=inner"))
    answer = F.create_map(F.lit("set-cookie"), cookies, F.lit("content-length"), F.array(F.lit("7")))
    moved = F.create_map(F.lit("location"), F.array(F.concat("scheme", F.lit("://inner."), "host", "target")))
    answers = req.select("req_id", F.when(F.col("req_id") % 3 == 0, answer).otherwise(F.map_concat(answer, moved)).alias("h"))
    new, audit = r.response_rewrite(F.col("h"), r.RESPONSE_RULES, "example", "inner")
    back = answers.select("req_id", F.size(new).alias("headers_left"), F.explode(audit).alias("a"))
    return sent.union(back.select("req_id", "a.name", F.array_join("a.before", "\n"), F.array_join("a.after", "\n"), "headers_left"))


@query("charset_detect", """
WITH p AS (SELECT regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages
  UNION ALL SELECT NULL FROM pages WHERE page_id % 5 = 0)
SELECT charset, count(*) AS n FROM p GROUP BY charset""")
def charset_detect(spark, folder):
    declared = F.regexp_extract("html", '<meta charset="([^"]*)"', 1)
    pages = table(spark, folder, "pages")
    types = pages.select(F.concat(F.lit("text/html; charset="), declared).alias("type")).union(
        pages.where("page_id % 5 = 0").select(F.lit("text/html")))
    return r.count_by(types.select(r.charset(F.col("type")).alias("charset")), "charset")


_RESPONSE = """CASE req_id % 7 WHEN 0 THEN '{"success": true}' WHEN 1 THEN '{"success": false, "reason": "no"}'
  WHEN 2 THEN '{bad' WHEN 3 THEN '[]' WHEN 4 THEN '{"reason": "missing"}' WHEN 5 THEN '' ELSE 'oops' END"""
_STATUS = "CASE WHEN req_id % 13 = 0 THEN NULL WHEN req_id % 7 = 5 THEN 0 WHEN req_id % 7 = 6 THEN 502 ELSE 200 END"


@query("http_outcome", f"""
WITH {v.REQ}, c AS (SELECT req_id, host, CASE WHEN req_id % 3 = 0 THEN NULL ELSE method END AS m,
    CASE WHEN req_id % 4 <> 0 THEN 'body' END AS body, CASE WHEN req_id % 13 = 0 THEN 'reset' END AS error,
    CASE WHEN req_id % 26 = 0 THEN 601 END AS error_status, {_STATUS} AS status, {_RESPONSE} AS response FROM req),
d AS (SELECT *, coalesce(m, CASE WHEN body IS NULL THEN 'GET' ELSE 'POST' END) AS sent_method FROM c),
e AS (SELECT *, sent_method IN ('POST', 'PUT') AND body IS NULL AS nobody FROM d)
SELECT req_id, sent_method, NOT nobody AND (error IS NULL OR error_status IS NOT NULL) AS network_ok,
  CASE WHEN nobody THEN NULL WHEN error IS NULL THEN status ELSE error_status END AS final_status,
  NOT nobody AND error IS NULL AND status = 200 AND req_id % 7 = 0 AS success,
  CASE WHEN nobody THEN 'please specify a body string for request method: ' || sent_method
    WHEN error IS NOT NULL THEN 'http request error: reset'
    WHEN status = 0 THEN 'Can not establish a network connection to ' || host
    WHEN status = 502 THEN 'oops' WHEN req_id % 7 = 2 THEN 'cannot parse response from gateway ' || host
    WHEN req_id % 7 = 3 THEN 'non outcome object returned from gateway ' || host
    WHEN req_id % 7 = 1 THEN 'no' WHEN req_id % 7 = 4 THEN 'missing' END AS reason FROM e""")
def http_outcome(spark, folder):
    rid = F.col("req_id")
    calls = requests(spark, folder).select(
        "req_id", "host", F.when(rid % 3 != 0, F.col("method")).alias("method"),
        F.when(rid % 4 != 0, "body").alias("body"), F.when(rid % 13 == 0, "reset").alias("error"),
        F.when(rid % 26 == 0, 601).alias("error_status"), F.expr(_STATUS).alias("status"),
        F.expr(_RESPONSE).alias("response"))
    return r.http_outcome(calls, "host").select("req_id", "sent_method", "network_ok", "final_status", "success", "reason")


@query("http_outcome_rate", f"""
WITH {v.REQ}, c AS (SELECT host, req_id, {_STATUS} AS status FROM req)
SELECT host, count(*) AS calls, CAST(sum(CASE WHEN coalesce(status, 0) = 200 AND req_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded
FROM c GROUP BY host""")
def http_outcome_rate(spark, folder):
    rid = F.col("req_id")
    calls = requests(spark, folder).select(
        "host", F.lit("POST").alias("method"), F.lit("body").alias("body"), F.when(rid % 13 == 0, "reset").alias("error"),
        F.lit(None).cast("int").alias("error_status"), F.expr(_STATUS).alias("status"), F.expr(_RESPONSE).alias("response"))
    calls = r.http_outcome(calls, "host")
    return calls.groupBy("host").agg(F.count(F.lit(1)).alias("calls"),
                                     F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("succeeded"))
