"""Log search, selectors, label browsing, streams, timelines and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, epoch_seconds, limited, text_or_empty
from ..functions.fields import canonical_labels, json_field, json_has
from ..functions.levels import ORDERINGS, tail_level_rank, LEVELS
from ..functions.masking import has_all_tokens
from ..functions.times import trailing
from ..plans.ranking import keep_last_n
from ..plans.sweep import paged
from .scope import select_fields, tenant_scope

# Browsable log labels and the labels of a stream.
LOG_LABELS = ["service", "level", "environment", "trace_id", "span_id", "ingested_by"]
STREAM_LABELS = ["service", "level", "environment", "trace_id", "span_id"]
NS = 10**9
# Lines of one page of a stream.
PAGE = 5000


def search_logs(df: DataFrame, tenant: str, phrase: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Full-text search over ``message``, newest first; the newest ``limit`` if given."""
    hits = tenant_scope(df, tenant)
    if where is not None:
        hits = hits.filter(where)
    hits = hits.filter(has_all_tokens("message", phrase))
    return select_fields(limited(hits.orderBy(F.col("timestamp").desc(), F.col("id").desc()), limit), "logs")


def _ns(df: DataFrame) -> Column:
    return F.col("ts_ns") if "ts_ns" in df.columns else F.unix_micros("timestamp") * 1000


def ns_window(start_ns: int, end_ns: int, now_ns: int) -> tuple[int, int]:
    """An absolute nanosecond window as whole seconds before now: the older edge widens, the newer truncates."""
    if start_ns > end_ns:
        raise ValueError("start must not be after end")

    def offset(at_ns: int, widen: bool) -> int:
        past = max(now_ns - at_ns, 0)
        return -(-past // NS) if widen else past // NS

    return offset(start_ns, True), offset(end_ns, False)


def label_predicate(matchers) -> Column:
    """AND of ``(label, op, value)`` matchers over the browsable labels; only ``=`` and ``!=`` exist."""
    out = F.lit(True)
    for name, op, value in matchers:
        column = name.lower()
        if column not in LOG_LABELS:
            raise ValueError(f"unknown label {name!r}; browsable labels are {', '.join(LOG_LABELS)}")
        if op not in ("=", "!="):
            raise ValueError(f"matcher {op!r} is not supported; use = or !=")
        out = out & ORDERINGS[op](F.col(column), F.lit(value))
    return out


def _window_seconds(as_of, start_ns, end_ns) -> tuple[int, int]:
    """Bounds of a selector window in epoch seconds; the default is the last hour."""
    now = epoch_seconds(as_of)
    end_ns = end_ns or now * NS
    start_ns = start_ns or end_ns - 3600 * NS
    before_start, before_end = ns_window(start_ns, end_ns, now * NS)
    return now - before_start, now - before_end


def stream_selector(
    df: DataFrame, tenant: str, matchers, as_of, start_ns: int | None = None, end_ns: int | None = None,
    forward: bool = False, limit: int | None = None,
) -> DataFrame:
    """Log lines under label matchers in a nanosecond window, newest first unless ``forward``."""
    start, end = _window_seconds(as_of, start_ns, end_ns)
    rows = tenant_scope(df, tenant).filter(label_predicate(matchers))
    rows = rows.filter(
        (F.col("timestamp") >= F.timestamp_seconds(F.lit(start))) & (F.col("timestamp") <= F.timestamp_seconds(F.lit(end)))
    ).withColumn("ts_ns", _ns(df))
    order = [F.col("ts_ns").asc(), F.col("id").asc()] if forward else [F.col("ts_ns").desc(), F.col("id").desc()]
    shown = ["id", "timestamp", "ts_ns", *[c for c in STREAM_LABELS if c in df.columns], "message"]
    return limited(rows.orderBy(*order), limit).select(*shown)


def to_streams(df: DataFrame, page_size: int = PAGE) -> DataFrame:
    """Selected lines grouped by their non-empty labels into pages of ordered ``[ns, line]`` pairs.

    A stream is as many rows as it has pages: the lists of ``page`` 0, 1, ... follow each other, all but the last
    hold ``page_size`` pairs, and no task holds more of a stream than an hour's rows or a page.
    """
    pairs = [x for c in STREAM_LABELS if c in df.columns for x in (F.lit(c), text_or_empty(c))]
    labelled = df.select(canonical_labels(F.create_map(*pairs)).alias("labels"), F.col("ts_ns").alias("ns"), F.col("message").alias("line"))
    pages = paged(labelled.withColumn("_us", F.expr("ns div 1000")), ["labels"], "_us", ["ns", "line"], page_size)
    return pages.groupBy("labels", "page").agg(F.array_sort(F.collect_list(F.struct("ns", "line"))).alias("values"))


def _ns_bounds(df: DataFrame, start_ns, end_ns) -> DataFrame:
    at = _ns(df)
    if start_ns:
        df = df.filter((at >= start_ns) & (F.col("timestamp") >= F.timestamp_seconds(F.lit(start_ns // NS))))
    if end_ns:
        df = df.filter((at <= end_ns) & (F.col("timestamp") < F.timestamp_seconds(F.lit(end_ns // NS + 1))))
    return df


def label_values(df: DataFrame, tenant: str, label: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Sorted distinct non-empty values of one label."""
    label_predicate([(label, "=", "")])
    column = label.lower()
    rows = _ns_bounds(tenant_scope(df, tenant), start_ns, end_ns).filter(F.col(column) != "")
    return rows.select(F.col(column).alias("value")).distinct().orderBy("value")


def label_sets(df: DataFrame, tenant: str, matchers=(), start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Sorted distinct (service, level, environment) under matchers."""
    rows = _ns_bounds(tenant_scope(df, tenant), start_ns, end_ns).filter(label_predicate(matchers))
    keys = ["service", "level", "environment"]
    return rows.select(*keys).distinct().orderBy(*keys)


def tail_predicate(field: str, op: str, value, as_of=None) -> Column:
    """One comparison the way a live tail reads a record.

    Tenant comparisons hold, absent fields do not match, levels compare by severity without regard to
    case, numbers are parsed out of text, and a ``timedelta`` value means a bound relative to ``as_of``.
    """
    import datetime as dt

    head, _, path = field.partition(".")
    head = head.lower()
    if not path and head in ("tenant", "tenant_id"):
        return F.lit(True)
    if path and head in ("body", "resource"):
        present, left = json_has(head, path), json_field(head, path, stringify=True)
    else:
        name = path.lower() if head == "auth" else {"time": "timestamp"}.get(head, head)
        present, left = F.col(name).isNotNull(), F.col(name)
    compare = ORDERINGS[op]
    if head == "level" and isinstance(value, str) and op not in ("=", "!="):
        rank = LEVELS.index(value.lower()) if value.lower() in LEVELS else -1
        return F.coalesce(present & compare(tail_level_rank(left), F.lit(rank)), F.lit(False))
    if isinstance(value, dt.timedelta):
        bound = as_of_col(as_of) + F.make_dt_interval(secs=F.lit(value.total_seconds()))
        return F.coalesce(compare(left.try_cast("timestamp"), bound), F.lit(False))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(compare(left.try_cast("double"), F.lit(float(value))), F.lit(False))
    return F.coalesce(present & compare(left.cast("string"), F.lit(str(value))), F.lit(False))


def timeline(
    logs: DataFrame, traces: DataFrame, changes: DataFrame, tenant: str, as_of, trace_id: str | None = None,
    service: str | None = None, since: int = 3600, limit: int | None = None, include_info: bool = False,
) -> DataFrame:
    """One feed of log lines, spans and changes, oldest first, or its newest ``limit`` events.

    The scope is one trace, or a trailing window with an optional service. With a limit each signal is
    trimmed to its newest rows before the feeds are merged. Logs below ``warn`` show only in a trace or
    on request; changes are left out of a trace.
    """
    since = since if since > 0 else 3600
    end = as_of_col(as_of)

    def scoped(df: DataFrame) -> DataFrame:
        df = tenant_scope(df, tenant)
        if trace_id:
            return df.filter(F.col("trace_id") == trace_id)
        start = end - F.make_dt_interval(secs=F.lit(since))
        df = df.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= end))
        return df.filter(F.col("service") == service) if service else df

    def feed(df, order, kind, severity, title, key, fields):
        def col(name):
            return text_or_empty(name) if name in df.columns else F.lit("")

        entries = [x for f in fields for x in (F.lit(f), col(f).cast("string"))]
        shaped = df.select(
            F.lit(kind).alias("type"), F.col("timestamp"), F.col("service"), col(severity).alias("severity"),
            col(title).alias("title"), col("trace_id").alias("trace_id"), col("span_id").alias("span_id"),
            (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("fields"),
            F.lit(order).alias("_order"), col(key).alias("_key"),
        )
        return shaped if limit is None else limited(shaped.orderBy(F.col("timestamp").desc(), F.col("_key").desc()), limit)

    log_rows = scoped(logs)
    if not (include_info or trace_id):
        log_rows = log_rows.filter(F.col("level").isin("warn", "error", "fatal"))
    merged = feed(log_rows, 0, "log", "level", "message", "id", []).unionByName(
        feed(scoped(traces), 1, "span", "status_code", "name", "span_id", ["kind", "duration_ns"])
    )
    if not trace_id:
        fields = ["git_sha", "deploy_id", "pr_number", "author"]
        merged = merged.unionByName(feed(scoped(changes), 2, "deploy", "kind", "title", "id", fields))
    keys = ["timestamp", "_order", "_key"]
    kept = keep_last_n(merged, [F.col(k).desc() for k in keys], [F.col(k).asc() for k in keys], limit)
    return kept.drop("_order", "_key")


def overlays(
    changes: DataFrame, incidents: DataFrame, tenant: str, as_of, window: int = 3600, service: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Chart markers: the changes and the incidents seen in the window, or the newest ``limit`` of each."""

    def recent(df: DataFrame, column: str) -> DataFrame:
        df = tenant_scope(df, tenant).filter(trailing(column, as_of, window))
        df = df.filter(F.col("service") == service) if service else df
        return df if limit is None else limited(df.orderBy(F.col(column).desc(), F.col("title").desc()), limit)

    deploys = recent(changes, "timestamp").select(
        F.lit("deploy").alias("marker_type"), "service", "title", F.col("kind"), F.lit("").alias("severity"),
        F.lit("").alias("status"), F.col("timestamp").alias("start"), F.col("timestamp").alias("end"),
        "git_sha", "deploy_id",
    )
    seen = recent(incidents, "last_seen").select(
        F.lit("incident").alias("marker_type"), "service", "title", F.lit("").alias("kind"), "severity", "status",
        F.col("first_seen").alias("start"), F.col("last_seen").alias("end"),
        F.lit("").alias("git_sha"), F.lit("").alias("deploy_id"),
    )
    return deploys.unionByName(seen)


def list_changes(df: DataFrame, tenant: str, service: str | None = None, limit: int | None = None) -> DataFrame:
    """Changes of a tenant, newest first."""
    rows = tenant_scope(df, tenant)
    rows = rows.filter(F.col("service") == service) if service else rows
    return select_fields(limited(rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()), limit), "change_events")


def list_auth_events(df: DataFrame, tenant: str, limit: int | None = None) -> DataFrame:
    """Identity events of a tenant, newest first."""
    newest = tenant_scope(df, tenant).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return select_fields(limited(newest, limit), "auth_events")


def list_incidents(df: DataFrame, tenant: str, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Incidents of a tenant, latest activity first."""
    rows = tenant_scope(df, tenant)
    rows = rows.filter(F.col("status") == status) if status in ("open", "resolved") else rows
    return limited(rows.orderBy(F.col("last_seen").desc(), F.col("fingerprint").desc()), limit)


def audit_search(df: DataFrame, tenant: str, actor: str = "", action: str = "", limit: int | None = None) -> DataFrame:
    """Audit rows whose actor and action contain the given texts, newest first, with the total.

    The total is a scalar subquery, so a limited listing stays a top-n instead of one global window.
    """

    def contains(column: str, text: str) -> Column:
        return F.contains(F.lower(F.col(column)), F.lit(text.lower())) if text else F.lit(True)

    hits = tenant_scope(df, tenant).filter(contains("actor", actor) & contains("action", action))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    newest = limited(hits.orderBy(F.col("created_at").desc(), *[F.col(c) for c in df.columns if c != "created_at"]), limit)
    return newest.withColumn("total", total.scalar())
