"""Registry, result shaping and the SQL form of the test adapters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basics import round_n
from ..sources.adapters import AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TENANT = "ten_1"
DAY = 86400
# Longer than any span is old, so that trace queries read the whole table.
ALL_TIME = 40 * 366 * DAY


def shaped(df: DataFrame) -> DataFrame:
    """Comparable output: timestamps as epoch microseconds, doubles to six places, lists as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_n(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def register(name: str, oracle: str | None = None, keep_raw: bool = False):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df if keep_raw else shaped(df)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_adapters(oracle)
        return fn

    return wrap


def r6(expression: str, digits: int = 6) -> str:
    """The SQL twin of the double rounding in :func:`shaped`."""
    scale = 10**digits
    return f"(round(({expression}) * {scale}.0::DOUBLE) / {scale}.0::DOUBLE)"


def rn(expression: str, digits: int) -> str:
    return r6(expression, digits)


ADAPTERS = {
    "logs": """SELECT cast(event_id AS string) AS id, ts AS "timestamp",
        concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, concat('svc_', cast(user_id % 7 AS string)) AS service,
        CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE '' END AS environment,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info'
             WHEN 'click' THEN 'debug' ELSE 'trace' END AS level,
        concat(event_type, ' request took ', cast(cast(floor(value) AS bigint) AS string), 'ms') AS message, props AS body,
        concat('t', cast(event_id % 500 AS string)) AS trace_id,
        concat(cast(event_id % 500 AS string), '-', cast(event_id % 7 + 1 AS string)) AS span_id,
        cast(user_id AS string) AS user_linkage_key, cast(7 + user_id % 3 AS int) AS _retention_days FROM events""",
    "metrics": """SELECT cast(event_id AS string) AS id, ts AS "timestamp",
        concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, concat('svc_', cast(user_id % 7 AS string)) AS service,
        CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE '' END AS environment, concat('app.', event_type) AS metric_name,
        'gauge' AS metric_type, value,
        cast(cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 5 AS string) AS label_k FROM events""",
    "traces": """SELECT concat('ten_', cast(l_orderkey % 3 AS string)) AS tenant_id, concat('t', cast(l_orderkey AS string)) AS trace_id,
        concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS span_id,
        CASE WHEN l_linenumber = 1 THEN '' ELSE concat(cast(l_orderkey AS string), '-', cast(l_linenumber - 1 AS string)) END AS parent_span_id,
        concat('svc_', cast(min(l_suppkey) % 7 AS string)) AS service, min(l_shipdate) AS "timestamp",
        cast(floor(min(l_extendedprice) * 1000) AS bigint) * 1000 AS duration_ns,
        CASE min(l_returnflag) WHEN 'R' THEN 'error' WHEN 'A' THEN 'ok' ELSE 'unset' END AS status_code
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "changes": """SELECT cast(event_id AS string) AS id, ts AS "timestamp",
        concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, concat('svc_', cast(user_id % 7 AS string)) AS service,
        CASE event_id % 4 WHEN 0 THEN 'deploy' WHEN 1 THEN 'flag' WHEN 2 THEN 'config' ELSE 'rollback' END AS kind,
        concat('change ', cast(event_id AS string)) AS title, concat('sha', cast(event_id AS string)) AS git_sha,
        concat('d', cast(event_id AS string)) AS deploy_id FROM events WHERE event_type = 'signup'""",
    "business": """SELECT concat('ten_', cast(c_custkey % 3 AS string)) AS tenant_id, concat('svc_', cast(c_nationkey % 7 AS string)) AS service,
        c_name AS customer, c_mktsegment AS plan_tier, c_acctbal AS monthly_revenue,
        CASE c_custkey % 4 WHEN 0 THEN 99.9::DOUBLE WHEN 1 THEN 99.99::DOUBLE WHEN 2 THEN 99.5::DOUBLE ELSE 0.0::DOUBLE END AS sla_target FROM customer""",
    "api_keys": """SELECT cast(user_id AS string) AS tenant_id, ts AS created_at FROM events WHERE event_type = 'signup'""",
    "audit_log": """SELECT cast(user_id AS string) AS tenant_id, ts AS created_at, 'query' AS action FROM events WHERE event_type = 'purchase'""",
    "docs": """SELECT cast(doc_id AS string) AS id, to_timestamp(epoch(TIMESTAMP '2024-01-31') - doc_id)::TIMESTAMP AS "timestamp",
        source AS tenant_id, lang AS service, text AS message FROM documents""",
    "signals": """SELECT concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, concat('svc_', cast(user_id % 7 AS string)) AS service,
        ts AS "timestamp", concat('r', cast(event_id % 4 AS string)) AS rule_id, (event_id % 100) / 100.0::DOUBLE AS confidence,
        CASE WHEN event_id % 3 = 0 THEN concat('d', cast(event_id AS string)) ELSE '' END AS deploy_id,
        cast(300 * (1 + event_id % 3) AS int) AS window_seconds, cast(event_id AS string) AS id
        FROM events WHERE event_type IN ('error', 'purchase')""",
    "resolves": """SELECT concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, concat('svc_', cast(user_id % 7 AS string)) AS service,
        ts AS "timestamp" FROM events WHERE event_type = 'signup' AND event_id % 5 = 0""",
    "audit_trail": """SELECT concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, ts AS created_at,
        concat('User_', cast(user_id % 50 AS string)) AS actor, concat('Logs.', event_type) AS action, cast(event_id AS string) AS id FROM events""",
    # child spans with their caller; every later trace query starts here
    "calls": """SELECT c.tenant_id, p.service AS caller, c.service AS callee, c.status_code, c.duration_ns
        FROM {traces} c JOIN {traces} p ON c.tenant_id = p.tenant_id AND c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
        WHERE p.service <> c.service""",
    "edges": """SELECT tenant_id, caller, callee, count(*) AS calls, count(*) FILTER (status_code = 'error') AS errors,
        quantile_cont(duration_ns, 0.95) / 1e6::DOUBLE AS p95_ms FROM {calls} GROUP BY ALL""",
}
_NEEDS = {"edges": ["calls"], "calls": ["traces"]}
NOW = f"TIMESTAMP '{AS_OF}'"


def with_adapters(sql: str) -> str:
    """Prefix the adapters a query names in braces, e.g. ``FROM {logs}``."""
    used: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in used:
            used.append(name)

    for name in re.findall(r"\{(\w+)\}", sql):
        if name in ADAPTERS:
            need(name)
    for name in used:
        sql = sql.replace("{" + name + "}", f"a_{name}")
    ctes = []
    for name in used:
        body = ADAPTERS[name]
        for other in _NEEDS.get(name, []):
            body = body.replace("{" + other + "}", f"a_{other}")
        ctes.append(f"a_{name} AS ({body})")
    sql = sql.strip()
    if not ctes:
        return sql
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else ""
    rest = re.sub(r"^WITH( RECURSIVE)?\s", "", sql, flags=re.I)
    joined = ", ".join(ctes)
    return f"WITH {recursive}{joined}, {rest}" if rest != sql else f"WITH {joined} {sql}"
