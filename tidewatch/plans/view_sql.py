"""The telemetry views as SQL text, used by the check statements."""

from __future__ import annotations

MON = """mon AS (
  SELECT event_id, user_id, epoch_us(ts) AS ts_us, value, k,
    CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 5 WHEN 'click' THEN 6 END AS level,
    event_type AS key, event_type AS method, event_type AS action,
    'svc_' || (user_id % 7) AS service_name, '//inline/pkg' || (user_id % 3) AS service_invoke,
    'app/m' || (user_id % 5) AS module,
    CASE WHEN k % 3 = 0 THEN 'k' || k END AS callee,
    CASE WHEN k % 6 = 0 THEN 'sub' END AS sub_method,
    CASE WHEN k % 2 = 0 THEN 'tick' END AS event,
    CAST(user_id AS VARCHAR) AS usr, 'c' || (event_id % 50) AS network, 'dev' || (user_id % 3) AS src,
    CASE WHEN k % 5 = 0 THEN 'out' || (k % 4) END AS dest,
    event_type <> 'error' AS success, 'k=' || k AS data, 'err ' || k AS reason
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

REQ = r"""req AS (
  SELECT page_id AS req_id, url,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
    regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS target,
    CASE page_id % 4 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'curl/8' WHEN 2 THEN 'badbot/1.0' END AS agent,
    CASE page_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'OPTIONS' ELSE 'POST' END AS method,
    '10.0.' || (page_id % 8) || '.' || (page_id % 250) AS ip
  FROM pages
)"""

TASK = """task AS (
  SELECT o_orderkey AS id, o_custkey AS task_id, 'rt' || (o_custkey % 16) AS runtime,
    o_orderstatus = 'O' AS outstanding, epoch_us(o_orderdate) AS queued_us,
    o_orderpriority <> '1-URGENT' AS ok, o_orderpriority AS priority, o_custkey % 3 = 0 AS rerun
  FROM orders
)"""

TRACE = """trace AS (
  SELECT l_orderkey AS trace, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS step,
    l_linenumber, epoch_us(l_shipdate) AS ship_us,
    l_returnflag <> 'R' AS ok, l_returnflag = 'A' AS restart, l_linestatus AS line_status
  FROM lineitem
)"""

CHUNK = """chunk AS (
  SELECT conv_id AS conn, turn AS seq, role, text AS payload FROM conversations
)"""


def friendly(number: str, name: str, thousand: int) -> str:
    """SQL for the human-unit text of a number expression."""
    n = f"CAST({number} AS DOUBLE)"
    square = float(thousand * thousand)
    units = (f"(CASE WHEN {n} / {square} > 1 THEN {n} / {square} "
             f"WHEN {n} / {float(thousand)} > 1 THEN {n} / {float(thousand)} ELSE {n} END)")
    h = f"CAST(floor(abs({units}) * 100 + 0.5) AS BIGINT)"
    return (f"CASE WHEN {n} IS NULL OR {n} = 0 THEN 'n/a' ELSE "
            f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END) || CAST({h} // 100 AS VARCHAR) || "
            f"(CASE WHEN {h} % 100 = 0 THEN '' WHEN {h} % 10 = 0 THEN '.' || ({h} % 100) // 10 "
            f"ELSE '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') END) || "
            f"(CASE WHEN {n} / {square} > 1 THEN 'M' WHEN {n} / {float(thousand)} > 1 THEN 'K' ELSE '' END) "
            f"|| '{name}' END")


def fixed_length(text: str, length: int) -> str:
    """SQL for a text cut or padded to a fixed width (negative keeps the end)."""
    body = f"coalesce({text}, '')"
    if length < 0:
        body, length = f"right({body}, {-length})", -length
    return f"rpad(left({body}, {length}), {length}, ' ')"
