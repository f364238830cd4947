"""Request logs: routing, classifying, rewriting, outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import cut, running
from tidewatch.functions.patterns import with_first_pattern
from tidewatch.functions.text import SPELLED_OUT, blank, contains_any, nth_part, present, replace_first

# Answers every gateway gives by itself.
ROBOTS_PATH = "/robots.txt"
NOT_FOUND, BAD_REQUEST, REFUSED, OK, BROKEN = 404, 400, 401, 200, 500


def domain_of(host: Column) -> Column:
    return nth_part(host, ":", 1)


def path_of(url: Column) -> Column:
    """The path without query and fragment, with a leading slash."""
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def first_match(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first rule whose test holds."""
    chosen = F
    for test, value in rules:
        chosen = chosen.when(test, value)
    return default if chosen is F else (chosen.otherwise(default) if default is not None else chosen)


# ----------------------------------------------------------------------- rules

def first_pattern(value: Column, patterns: list[str]) -> Column:
    """Index of the first pattern found in the text, -1 if none. Empty patterns are
    skipped unless the text is empty."""
    if len(patterns) > SPELLED_OUT:
        found = F.transform(F.lit(list(patterns)), lambda p: F.when(p == "", value == "").otherwise(F.rlike(value, p)))
        return (F.array_position(found, True) - 1).cast("int")
    rules = [(F.rlike(value, F.lit(p)) if p else value == "", F.lit(i)) for i, p in enumerate(patterns)]
    return first_match(rules, F.lit(-1))


def first_equal(value: Column, texts: list[str]) -> Column:
    if len(texts) > SPELLED_OUT:
        return F.coalesce(F.array_position(F.lit(list(texts)), value) - 1, F.lit(-1)).cast("int")
    return first_match([(value == t, F.lit(i)) for i, t in enumerate(texts)], F.lit(-1))


def starts_with_any(value: Column, texts: list[str]) -> Column:
    if len(texts) > SPELLED_OUT:
        return F.exists(F.lit(list(texts)), lambda t: F.startswith(value, t))
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.startswith(value, F.lit(t))
    return hit


# ----------------------------------------------------------------- access log

def ipv4_number(address: Column) -> Column:
    part = lambda n: nth_part(address, ".", n).try_cast("bigint")
    return part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)


def access_rows(requests: DataFrame) -> DataFrame:
    """The 11 columns of one access-log row.

    Reads ``recorded_us``, ``target``, ``scheme``, ``peer`` and the map ``headers``.
    """
    header = lambda name: F.try_element_at(F.col("headers"), F.lit(name))
    # base64 breaks its text into lines; a column holds it in one piece.
    packed = lambda name: F.translate(F.base64(F.encode(blank(header(name)), "utf-8")), "\r\n", "")
    secure = (header("x-original-request-is-ssl") == "yes") | (F.col("scheme") == "https")
    return requests.select(
        F.date_format(F.timestamp_micros("recorded_us"), "yyyy-MM-dd HH:mm:ss").alias("recordtm"),
        packed("host").alias("host"),
        F.lit("GET").alias("method"),
        F.col("target").alias("path"),
        F.when(secure, "https").otherwise("http").alias("scheme"),
        ipv4_number(F.when(present(header("x-forwarded-for")), header("x-forwarded-for"))
                    .otherwise(F.col("peer"))).alias("ipv4"),
        packed("accept").alias("accept"),
        packed("cookie").alias("cookie"),
        packed("referer").alias("referer"),
        packed("user-agent").alias("useragent"),
        # A missing agent is hashed under the name the reference language prints for it.
        F.md5(F.coalesce(header("user-agent"), F.lit("undefined"))).alias("useragentmd5"),
    )


# ------------------------------------------------------------ gates and status

def agent_denied(agent: Column, denied: list[str]) -> Column:
    """No agent header passes."""
    return present(agent) & contains_any(blank(agent), denied)


@dataclass
class Gateway:
    denied_agents: tuple[str, ...] = ()
    status_path: str = "/status"
    base_path: str = "/apigateway/"
    invoke_prefix: str = ""
    cli_open: bool = False


def gateway_status(config: Gateway) -> Column:
    """Status of a request (columns ``agent``, ``target``, ``method``) in the order of its tests."""
    target = F.col("target")
    path = F.substring(path_of(target), F.lit(len(config.base_path) + 1), F.length(target) + 1)
    # A plus sign is a plain character in a path.
    name = nth_part(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "?", 1)
    method = F.upper("method")
    rules = [(agent_denied(F.col("agent"), list(config.denied_agents)), F.lit(NOT_FOUND)),
             (F.lower(target) == ROBOTS_PATH, F.lit(OK)),
             (target == config.status_path, F.lit(OK)),
             (method == "OPTIONS", F.lit(OK))]
    if config.invoke_prefix:
        rules.append((~F.startswith(name, F.lit(config.invoke_prefix)), F.lit(NOT_FOUND)))
        name = F.substring(name, F.lit(len(config.invoke_prefix) + 1), F.length(name))
    if not config.cli_open:
        rules.append((name == "cli", F.lit(BAD_REQUEST)))
    rules.append((method != "POST", F.lit(REFUSED)))
    return first_match(rules, F.lit(OK))


def resource_status(resources: list[str]) -> Column:
    """Status of a raw handler: OPTIONS and POST answer, GET needs a known resource."""
    resource = F.coalesce(nth_part(F.col("target"), "?", 2), F.lit(""))
    known = F.lit(False)
    for name in resources:
        known = known | F.startswith(resource, F.lit(name))
    return first_match([(F.upper("method") == "OPTIONS", F.lit(OK)),
                        (~F.col("method").isin("POST", "GET"), F.lit(REFUSED)),
                        (F.col("method") == "POST", F.lit(OK)), (known, F.lit(OK))], F.lit(NOT_FOUND))


def proxy_choice(url: Column, bypass: list[str] | None, proxy: str = "proxy") -> Column:
    """Direct where no proxy is set (bypass None) or the URL contains a bypass text."""
    if bypass is None:
        return F.lit("direct")
    return F.when(contains_any(url, bypass), "direct").otherwise(proxy)


def conditional_rewrite(rows: DataFrame, modules: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """Apply the first module whose *should* test holds.

    A module is (name, should, perform); perform maps columns to their new value.
    A column a module does not set, or sets to null, keeps its original.
    """
    names = first_match([(should, F.lit(name)) for name, should, _ in modules], F.lit(None).cast("string"))
    rows = rows.withColumn("module", names)
    columns = dict.fromkeys(c for _, _, perform in modules for c in perform)
    rewritten = {}
    for column in columns:
        own = F.col(column)
        rules = [(F.col("module") == name, F.coalesce(perform[column], own))
                 for name, _, perform in modules if column in perform]
        rewritten[column] = first_match(rules, own)
    return rows.withColumns(rewritten)


# --------------------------------------------------------------------- routing

def domain_routes(requests: DataFrame, routes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Add ``domain`` and the ``ord`` and ``handler`` of the first route that matches it.

    Routes have ``ord``, ``route`` and ``handler``. A route is an exact domain, or ``*.``
    and a suffix, which also matches the bare suffix itself. ``by`` names columns
    both sides share, such as a snapshot number. Each distinct domain is expanded
    into the few route names it could match, so this is an equality join on distinct
    domains: a domain that holds most of the requests costs no more than any other.
    """
    by = list(by)
    requests = requests.withColumn("domain", domain_of(F.col("host")))
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    distinct = requests.select(*by, "domain").distinct()
    names = distinct.select(*by, "domain", F.explode(F.array_append(suffixes, F.col("domain"))).alias("route"))
    matched = names.join(routes, [*by, "route"]).groupBy(*by, "domain").agg(F.min(F.struct("ord", "handler")).alias("m"))
    found = matched.select(*by, "domain", "m.ord", "m.handler")
    return requests.join(found, [*by, "domain"], "left")


def routes_by_load(requests: DataFrame, local: DataFrame, loaded: DataFrame, load: str) -> DataFrame:
    """Route each request by the routes of the load in force when it came.

    ``loaded`` holds the remote routes of every load that went well. Each load starts
    from the local routes, so one that failed leaves only those. Local routes are
    tried first. Adds ``source_rank`` (0 local, 1 remote), ``ord`` and ``handler``.
    """
    names = ["ord", "handler"]
    near = domain_routes(requests, local).withColumnsRenamed({n: f"_{n}" for n in names})
    both = domain_routes(near, loaded, by=[load])
    is_local = F.col("_ord").isNotNull()
    rank = F.when(is_local, 0).when(F.col("ord").isNotNull(), 1)
    return both.withColumns({"source_rank": rank, **{n: F.when(is_local, F.col(f"_{n}")).otherwise(F.col(n)) for n in names}}
                            ).drop("_ord", "_handler")


def alias_rewrite(host: Column, url: Column, aliases: list[str], canonical: str) -> Column:
    """Normal form of a request URL with domain aliases replaced once each, in order."""
    result = F.concat(F.lit("http://"), domain_of(host), path_of(url))
    # Each replacement names the text before it several times, so few are nested.
    if len(aliases) > 2:
        return F.aggregate(F.lit(list(aliases)), result, lambda r, a: replace_first(r, a, canonical))
    for alias in aliases:
        result = replace_first(result, alias, canonical)
    return result


@dataclass
class Intercept:
    id: str
    pattern: str
    success: bool = False
    reason: str = "intercepted"


def _intercepts(call: Column, rules: list[Intercept]) -> tuple[Column, list[Intercept]]:
    """Which calls are tested, and the rules in force.

    A rule with the id of an earlier one takes its place. Rules apply to call
    strings that name a module, service rules excepted.
    """
    latest: dict[str, Intercept] = {}
    for rule in rules:
        latest[rule.id] = rule
    rules = list(latest.values())
    tested = (F.startswith(call, F.lit("//")) | F.startswith(call, F.lit("http://"))
              | F.startswith(call, F.lit("https://"))) & ~F.startswith(call, F.lit("//service/"))
    return tested, rules


def intercept(calls: DataFrame, call: str, rules: list[Intercept]) -> DataFrame:
    """Add ``rule``, ``forced_success`` and ``forced_reason``: what the first matching rule
    forces on a call. Each pattern is tried once per row, and of a long list only those whose
    texts the call holds; the number of the rule is a column of its own, from which the others
    are looked up."""
    tested, rules = _intercepts(F.col(call), rules)
    patterns = [r.pattern for r in rules]
    if len(rules) > SPELLED_OUT:
        calls = with_first_pattern(calls, call, patterns, "_first", first_pattern)
        number = F.when(tested, F.col("_first") + 1)
    else:
        number = F.when(tested, first_pattern(F.col(call), patterns) + 1)
    rows = calls.withColumn("_rule", F.when(number > 0, number))
    table = F.lit([r.id for r in rules]), F.lit([r.success for r in rules]), F.array(
        *[F.lit(None if r.success else r.reason).cast("string") for r in rules])
    looked = [F.get(t, F.col("_rule") - 1) if rules else F.lit(None) for t in table]
    return rows.withColumns(dict(zip(("rule", "forced_success", "forced_reason"), looked))).drop("_rule", "_first")


@dataclass
class Handler:
    name: str
    accepts: Column | None = None
    custom: bool = False
    loaded: bool = True
    throws: Column | None = None


def handler_choice(handlers: list[Handler]) -> dict[str, Column]:
    """First handler that accepts a request; the default comes last and takes the rest.

    Custom-request handlers are skipped and handlers that failed to load never
    enter. A handler that throws on a request answers it with 500.
    """
    active = [h for h in handlers if h.loaded and not h.custom]
    throws = [F.lit(False) if h.throws is None else F.coalesce(h.throws, F.lit(False)) for h in active]
    accepts = [F.lit(True) if h.accepts is None else h.accepts for h in active]
    name = first_match([(a | t, F.lit(h.name)) for h, a, t in zip(active, accepts, throws)], F.lit("default"))
    status = first_match([(a | t, F.when(t, BROKEN).otherwise(OK)) for a, t in zip(accepts, throws)], F.lit(OK))
    return {"handler": name, "status": status}


# --------------------------------------------------------------------- lookups

def token_owners(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Owner of the bearer token of the column ``authorization``; null if unknown."""
    token = F.coalesce(nth_part(F.coalesce("authorization", F.lit("undefined")), " ", 2), F.lit("undefined"))
    joined = requests.withColumn("token", token).join(tokens, "token", "left")
    return joined.withColumn("owner_type", F.lit(1))


def gateway_url(service: Column, prefix: Column, fixed: dict[str, str], strict: bool = False) -> dict[str, Column]:
    """URL of a service name, or the reason there is none."""
    known = first_match([(service == n, F.lit(u)) for n, u in fixed.items()], F.lit(None).cast("string"))
    guess = F.lit(None).cast("string") if strict else F.concat(F.lit("https://"), service, F.lit("/apigateway/:"))
    url = F.when(service != "", F.coalesce(known, F.concat(prefix, service, F.lit("/")), guess))
    reason = (F.when(service == "", "/// launch string is ambigous, did you mean //inline/?")
              .when(url.isNull(), F.concat(F.lit("Cannot find the proper gateway for:"), service)))
    return {"url": url, "reason": reason}


def split_allowed(requests: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests from listed addresses (column ``ip``), and the others."""
    return requests.join(allowed, "ip", "left_semi"), requests.join(allowed, "ip", "left_anti")


def round_robin(requests: DataFrame, order: list[str], targets: list[str], slices: int | None = None) -> DataFrame:
    """Targets in rotation over one global order, numbered slice by slice."""
    rows = running(cut(requests, [], order, slices), [], order, sums={"_n": F.lit(1)})
    target = F.element_at(F.array(*map(F.lit, targets)), ((F.col("_n") - 1) % len(targets) + 1).cast("int"))
    return rows.withColumn("target_box", target).drop("_n", "_slice")


# --------------------------------------------------------------------- headers

@dataclass
class HeaderRule:
    """action is F2B, B2F, delete or overwrite (which needs a value)."""

    header: str
    action: str
    value: str | None = None


# What a bridge does to headers unless configured otherwise.
REQUEST_RULES = [HeaderRule("host", "F2B"), HeaderRule("origin", "F2B"), HeaderRule("referer", "F2B"),
                 HeaderRule("connection", "overwrite", "close"), HeaderRule("accept-encoding", "delete")]
RESPONSE_RULES = [HeaderRule("set-cookie", "B2F"), HeaderRule("location", "B2F")]


def _rewritten(rule: HeaderRule, before: Column, front: str, back: str) -> Column:
    if rule.action == "F2B":
        return replace_first(before, front, back)
    if rule.action == "B2F":
        return replace_first(before, back, front)
    if rule.action == "delete":
        return F.lit(None).cast("string")
    return F.lit(rule.value)


def header_rewrite(headers: Column, rules: list[HeaderRule], front: str, back: str,
                   prefix: str) -> tuple[Column, Column]:
    """(headers after the rules, audit array of name, before, after).

    A header without a rule is kept; an emptied header is removed.
    """
    audit = F.array(*[F.struct(F.lit(f"{prefix}.headers.{r.header}").alias("name"),
                               F.try_element_at(headers, F.lit(r.header)).alias("before"),
                               _rewritten(r, F.try_element_at(headers, F.lit(r.header)), front, back)
                               .alias("after")) for r in rules])
    kept = F.map_filter(headers, lambda k, _: ~k.isin(*[r.header for r in rules]))
    cut_name = len(f"{prefix}.headers.") + 1
    new = F.map_from_entries(F.transform(F.filter(audit, lambda a: present(a["after"])),
                                         lambda a: F.struct(F.substring(a["name"], F.lit(cut_name), F.length(a["name"])), a["after"])))
    return F.map_concat(kept, new), audit


def rewrite_values(values: Column, rule: HeaderRule, front: str, back: str) -> Column:
    """A header with several values: the rule applies to each."""
    return F.transform(values, lambda v: _rewritten(rule, v, front, back))


def response_rewrite(headers: Column, rules: list[HeaderRule], front: str, back: str,
                     prefix: str = "response") -> tuple[Column, Column]:
    """:func:`header_rewrite` for headers that map a name to a list of values.

    A deleted header has no values left and is removed; an overwritten one has one value."""
    none = F.array().cast("array<string>")

    def after(rule: HeaderRule, before: Column) -> Column:
        if rule.action == "delete":
            return none
        return F.array(F.lit(rule.value)) if rule.action == "overwrite" else rewrite_values(F.coalesce(before, none), rule, front, back)

    audit = F.array(*[F.struct(
        F.lit(f"{prefix}.headers.{r.header}").alias("name"), F.try_element_at(headers, F.lit(r.header)).alias("before"),
        after(r, F.try_element_at(headers, F.lit(r.header))).alias("after")) for r in rules])
    kept = F.map_filter(headers, lambda k, _: ~k.isin(*[r.header for r in rules]))
    new = F.map_from_entries(F.transform(F.filter(audit, lambda a: F.size(a["after"]) > 0), lambda a: F.struct(
        F.substring(a["name"], F.lit(len(f"{prefix}.headers.") + 1), F.length(a["name"])), a["after"])))
    return F.map_concat(kept, new), audit


def charset(content_type: Column, default: str | None = None) -> Column:
    """Text after ``charset=``; null (or the given default) where there is none."""
    found = nth_part(blank(content_type), "charset=", 2)
    return found if default is None else F.coalesce(found, F.lit(default))


# -------------------------------------------------------------------- outcomes

def sent_method(method: Column, body: Column) -> Column:
    return F.when(present(method), method).otherwise(F.when(present(body), "POST").otherwise("GET"))


def http_outcome(calls: DataFrame, endpoint: str) -> DataFrame:
    """Add ``sent_method``, ``network_ok``, ``final_status``, ``success`` and ``reason`` of JSON calls.

    Reads ``method``, ``body``, ``error`` (network error or null), ``error_status``
    (status to answer a network error with, or null), ``status`` and ``response``.
    """
    calls = calls.withColumns({"sent_method": sent_method(F.col("method"), F.col("body")),
                               "_reply": F.try_parse_json("response")})
    calls = calls.withColumns({
        "_kind": F.schema_of_variant("_reply"),
        "_said_ok": F.coalesce(F.try_variant_get("_reply", "$.success", "boolean"), F.lit(False))})
    error, status, sent = F.col("error"), F.col("status"), F.col("sent_method")
    resolved = error.isNotNull() & F.col("error_status").isNotNull()
    needs_body = sent.isin("POST", "PUT") & F.col("body").isNull()
    final = F.when(error.isNotNull(), F.col("error_status")).otherwise(status)
    is_object = F.startswith("_kind", F.lit("OBJECT"))
    network_error = F.concat(F.lit("http request error: "), error)
    reason = first_match([
        (needs_body, F.concat(F.lit("please specify a body string for request method: "), sent)),
        (error.isNotNull() & ~resolved, network_error), (resolved & (final != 200), network_error),
        ((status != 200) & ((status == 0) | ~present(blank(F.col("response")))),
         F.concat(F.lit("Can not establish a network connection to "), endpoint)),
        (status != 200, F.col("response")),
        (F.col("_reply").isNull(), F.concat(F.lit("cannot parse response from gateway "), endpoint)),
        (~is_object, F.concat(F.lit("non outcome object returned from gateway "), endpoint)),
        (~F.col("_said_ok"), F.try_variant_get("_reply", "$.reason", "string")),
    ], F.lit(None).cast("string"))
    good = ~needs_body & error.isNull() & (status == 200) & F.coalesce(is_object & F.col("_said_ok"), F.lit(False))
    calls = calls.withColumns({"network_ok": ~needs_body & (error.isNull() | resolved),
                               "final_status": F.when(~needs_body, final), "success": F.coalesce(good, F.lit(False)),
                               "reason": reason})
    return calls.withColumn("reason", F.when(~F.col("success"), F.col("reason"))).drop("_reply", "_kind", "_said_ok")


def count_by(rows: DataFrame, *names: str) -> DataFrame:
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
