"""Alert and routing rules as tables.

Rules are rows, not plan: their clauses are arrays of structs, grouped per tenant and service, joined to log rows or
events by equality and tested there with higher-order functions. The plan is the same for ten rules and for a million,
and a rule table may be larger than the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.basics import let, text_or_empty
from ..functions.levels import LEVELS, ORDERINGS, routing_rank
from ..schemas import signal_schema
from .scope import resolve_field

ANY_SERVICE = "*"
# Rules tested in one go; a tenant and service with more of them is tested in several.
GROUP_RULES = 256
_CLAUSE = "struct<field:string,op:string,text:string,number:double>"
RULES_SCHEMA = (
    "rule_id string, tenant_id string, rule_name string, kind string, service string, threshold double, window_seconds int, "
    f"enabled boolean, condition array<{_CLAUSE}>"
)
ROUTES_SCHEMA = (
    "position bigint, rule_id string, tenant_id string, service string, condition string, enabled boolean, channels array<struct<type:string,target:string>>"
)
# Sides of its value on which a comparison holds.
_SIDES = {"=": [0], "!=": [-1, 1], "<": [-1], "<=": [-1, 0], ">": [1], ">=": [0, 1]}
# How clauses are written, and the names by which an event's labels go.
CLAUSE_PATTERN = r"^([\w.]+)\s*(>=|<=|!=|=~|==|=|>|<)\s*(.+)$"
LABEL_PREFIXES = ("labels.", "label.")
_ALIASES = {"time": "timestamp", "tenant": "tenant_id"}


def _clause(field: str, op: str, value) -> tuple:
    text = isinstance(value, str)
    return field, op, str(value), None if text else float(value)


def rule_table(spark: SparkSession, rules: Iterable) -> DataFrame:
    """A rule table from a list of rules; refuses clauses that no log row could answer."""
    rules = list(rules)
    for field, op in {(field, op) for r in rules for field, op, _ in r.condition}:
        if ("=" if op == "==" else op) not in ORDERINGS:
            raise ValueError(f"unknown comparison {op!r}")
        if field.lower() not in ("tenant", "tenant_id"):
            resolve_field("logs", field)
    rows = []
    for r in rules:
        clauses = [_clause(*c) for c in r.condition]
        rows.append((r.id, r.tenant_id, r.name, r.kind, r.service or ANY_SERVICE, None if r.threshold is None else float(r.threshold), r.window_seconds, r.enabled, clauses))
    return spark.createDataFrame(rows, RULES_SCHEMA)


def as_rule_table(spark: SparkSession, rules) -> DataFrame:
    """Enabled rules, from a list or from a table with the columns of ``RULES_SCHEMA``. A blank service means any."""
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    service = F.coalesce(F.nullif(F.col("service"), F.lit("")), F.lit(ANY_SERVICE))
    return table.filter("enabled").withColumn("service", service)


def longest_window(rules: DataFrame) -> int:
    """Seconds that the widest rule looks back; one small aggregate over the rules."""
    return rules.agg(F.max("window_seconds")).first()[0] or 0


def compiled(rules: DataFrame) -> DataFrame:
    """(tenant_id, service, probes): what the rules of a tenant and service ask, for :func:`matching`.

    Rules that ask the same are one probe. A clause becomes the column or JSON path it reads, and numbers to compare with:
    severities for the order of levels, microseconds for times. A clause on the tenant is always true.
    """
    head = F.lower(F.substring_index("c.field", ".", 1))
    path = F.substring(F.col("c.field"), F.length(head) + 2, 1 << 20)
    plain = ~F.contains(F.col("c.field"), F.lit("."))
    named = F.create_map(*[F.lit(x) for pair in _ALIASES.items() for x in pair])
    column = F.coalesce(F.try_element_at(named, head), head)
    read = F.when(plain, column).when(head == "body", F.lit("body")).when(head == "resource", F.lit("resource"))
    steps = F.transform(F.split(path, r"\."), lambda p: F.concat(F.lit("['"), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']")))
    op = F.when(F.col("c.op") == "==", "=").otherwise(F.col("c.op"))
    sides = F.create_map(*[x for name, some in _SIDES.items() for x in (F.lit(name), F.array(*map(F.lit, some)))])
    ranked = plain & (column == "level") & F.col("c.number").isNull() & ~op.isin("=", "!=")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("c.text")), F.lit(0)).cast("double")
    time = F.unix_micros(F.try_to_timestamp("c.text")).cast("double")
    number = F.when(ranked, rank).when(plain & (column == "timestamp") & F.col("c.number").isNull(), time).otherwise(F.col("c.number"))
    clause = F.struct(
        F.when(ranked, "rank").otherwise(read).alias("read"), F.when(~plain, F.concat(F.lit("$"), F.array_join(steps, ""))).alias("path"), F.try_element_at(sides, op).alias("sides"),
        F.col("c.text").alias("text"), number.alias("number"),
    )
    keys = ["tenant_id", "rule_id", "service", "window_seconds"]
    told = rules.select(*keys, F.explode_outer("condition").alias("c")).select(*keys, F.when(F.col("c").isNotNull() & ~(plain & (column == "tenant_id")), clause).alias("clause"))
    whole = told.groupBy(*keys).agg(F.array_sort(F.collect_set("clause")).alias("clauses"))
    probes = whole.groupBy("tenant_id", "service", "window_seconds", "clauses").agg(F.array_sort(F.collect_list("rule_id")).alias("rules"))
    group = F.pmod(F.xxhash64("window_seconds", F.to_json("clauses")), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("tenant_id", "service")) / GROUP_RULES))
    return probes.withColumn("_group", group).groupBy("tenant_id", "service", "_group").agg(F.collect_list(F.struct("window_seconds", "clauses", "rules")).alias("probes")).drop("_group")


def _side(left: Column, right: Column) -> Column:
    """On which side of ``right`` the left value lies: -1, 0 or 1; null where there is none."""
    return F.when(left == right, 0).when(left < right, -1).when(left > right, 1)


def _holds(columns: list[str]) -> Callable[[Column], Column]:
    """Whether a log row answers to a clause."""
    kinds = {f.name: f.dataType.typeName() for f in signal_schema("logs").fields}
    texts = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]) if columns else F.create_map().cast("map<string,string>")
    numeric = [c for c in columns if kinds.get(c) in ("timestamp", "integer", "short", "long", "double", "float", "byte")]
    values = {c: (F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c)).cast("double") for c in numeric}
    if "level" in columns:
        values["rank"] = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(0)).cast("double")
    numbers = F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]) if values else F.create_map().cast("map<string,double>")

    def text_of(c: Column) -> Column:
        text = F.try_element_at(texts, c["read"])
        sources = [s for s in ("body", "resource") if s in columns]
        if not sources:
            return text
        source = F.when(c["read"] == sources[0], F.col(sources[0]))
        for s in sources[1:]:
            source = source.when(c["read"] == s, F.col(s))
        string = F.try_variant_get(F.try_parse_json(source), c["path"], "variant")
        found = F.when(F.schema_of_variant(string) == "STRING", F.try_variant_get(string, "$", "string"))
        return F.when(c["path"].isNotNull(), F.coalesce(found, F.lit(""))).otherwise(text)

    def holds(c: Column) -> Column:
        def side(text: Column) -> Column:
            number = F.coalesce(F.try_element_at(numbers, c["read"]), text.try_cast("double"))
            return F.when(c["number"].isNull(), _side(text, c["text"])).otherwise(_side(number, c["number"]))

        return F.coalesce(F.array_contains(c["sides"], let(text_of(c), side)), F.lit(False))

    return holds


def matching(logs: DataFrame, rules: DataFrame, recent: Callable[[Column], Column], more: tuple[str, ...] = ()) -> DataFrame:
    """(tenant_id, rule_id, window_seconds, ``more``) for every rule a log row answers to.

    A row meets the rules of its tenant for its own service and those for any. ``recent`` tells from a probe's window
    whether the row lies in it. Whether the rules are broadcast is left to Spark, which knows their size.
    """
    wanted = sorted(set(more) | _read_columns(rules) | {"tenant_id", "service"})
    tested = [c for c in wanted if c in logs.columns]
    rows = logs.select(*tested, F.explode(F.array_distinct(F.array(F.col("service"), F.lit(ANY_SERVICE)))).alias("_of"))
    asked = compiled(rules).withColumnRenamed("service", "_of")
    holds = _holds([c for c in tested if c not in more or c in _read_columns(rules)])
    hits = F.filter("probes", lambda p: recent(p["window_seconds"]) & F.forall(p["clauses"], holds))
    found = rows.join(asked, ["tenant_id", "_of"]).select("tenant_id", *more, F.explode(hits).alias("_hit"))
    return found.select("tenant_id", *more, F.explode("_hit.rules").alias("rule_id"), F.col("_hit.window_seconds").alias("window_seconds"))


def _read_columns(rules: DataFrame) -> set[str]:
    """Columns that clauses read: at most those of the log schema."""
    known = set(signal_schema("logs").names)
    head = F.lower(F.substring_index("c.field", ".", 1)).alias("head")
    found = rules.select(F.explode("condition").alias("c")).select(head, F.contains("c.field", F.lit(".")).alias("inner"), F.col("c.op").alias("op")).distinct()
    out = set()
    for r in found.collect():  # a few per column, or an error
        name = _ALIASES.get(r.head, r.head) if not r.inner else r.head
        if ("=" if r.op == "==" else r.op) not in ORDERINGS:
            raise ValueError(f"unknown comparison {r.op!r}")
        if name not in (known if not r.inner else {"body", "resource"}):
            raise ValueError(f"unknown field {r.head!r} on logs")
        out.add(name)
    return out - {"tenant_id"}


# ---- routing -------------------------------------------------------------------------------


def route_table(spark: SparkSession, rules: Iterable) -> DataFrame:
    """A routing table from a list of rules, in its order."""
    rows = [(i, r.id, r.tenant_id, r.service, r.condition, r.enabled, [tuple(c) for c in r.channels]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, ROUTES_SCHEMA)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^\s+|\s+$", "")


def compiled_routes(routes: DataFrame) -> DataFrame:
    """Enabled routing rules with their conditions, AND-separated texts, taken apart into ``clauses``."""
    parts = F.transform(F.split(_trimmed(text_or_empty("condition")), r"(?i)\s+and\s+"), lambda p: _trimmed(F.regexp_replace(_trimmed(p), r"^[()]+|[()]+$", "")))
    pattern = "(?s)" + CLAUSE_PATTERN

    def clause(p: Column) -> Column:
        name, op, raw = (F.regexp_extract(p, pattern, k) for k in (1, 2, 3))
        lowered = F.lower(name)
        label = F.coalesce(*[F.when(F.startswith(lowered, F.lit(x)), F.substring(name, len(x) + 1, 1 << 20)) for x in LABEL_PREFIXES], name)
        text = _trimmed(raw)
        inner = F.regexp_extract(text, r"(?s)^(['\"])(.*)\1$", 2)
        value = F.when(F.rlike(text, F.lit(r"(?s)^(['\"]).*\1$")) & (F.length(text) >= 2), inner).otherwise(text)
        severity = lowered.isin("level", "severity")
        return F.struct(
            (lowered == "service").alias("service"), severity.alias("severity"), label.alias("label"),
            F.when(F.rlike(p, F.lit(pattern)), F.when(op == "==", "=").otherwise(op)).alias("op"), F.lower(value).alias("text"), routing_rank(value).alias("rank"),
        )

    clauses = F.transform(F.filter(parts, lambda p: p != ""), clause)
    channels = F.coalesce("channels", F.array().cast("array<struct<type:string,target:string>>"))
    return routes.filter("enabled").select(
        "tenant_id", F.struct("position", "rule_id", F.lower(_trimmed(text_or_empty("service"))).alias("service"), clauses.alias("clauses"), channels.alias("channels")).alias("rule")
    )


def _route_holds(c: Column) -> Column:
    """Whether an event answers to a clause; a field it does not have answers to none."""
    value = F.when(c["service"], F.nullif(F.col("service"), F.lit(""))).when(c["severity"], F.nullif(F.col("severity"), F.lit(""))).otherwise(F.try_element_at("labels", c["label"]))
    folded = F.lower(value)
    test = F.when(c["op"] == "=", folded == c["text"]).when(c["op"] == "!=", folded != c["text"]).when(c["op"] == "=~", F.contains(folded, c["text"]))
    for name in ("<", "<=", ">", ">="):
        test = test.when(c["op"] == name, c["severity"] & ORDERINGS[name](routing_rank(value), c["rank"]))
    return F.coalesce(test, F.lit(False))


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with ``matched_rules`` in the order of ``position`` and the distinct ``channels`` of those rules.

    The rules of a tenant, together with those of no tenant, meet its events as one array, so that an event stays one row
    and is never regrouped.
    """
    rules = compiled_routes(routes)
    everyone = rules.filter("tenant_id is null").agg(F.collect_list("rule").alias("_all"))  # one row
    own = rules.filter("tenant_id is not null").groupBy("tenant_id").agg(F.collect_list("rule").alias("_own"))
    joined = events.withColumn("_one", F.lit(1)).join(F.broadcast(everyone.withColumn("_one", F.lit(1))), "_one").join(own, "tenant_id", "left")
    none = F.array().cast(T.ArrayType(rules.schema["rule"].dataType))
    service = F.lower(_trimmed(F.col("service")))
    hits = F.filter(
        F.array_sort(F.concat("_all", F.coalesce("_own", none))),
        lambda r: ((r["service"] == "") | F.coalesce(service == r["service"], F.lit(False))) & F.forall(r["clauses"], _route_holds),
    )
    found = joined.withColumn("_hits", hits)
    return found.withColumn("matched_rules", F.transform("_hits", lambda r: r["rule_id"])).withColumn(
        "channels", F.array_distinct(F.flatten(F.transform("_hits", lambda r: r["channels"])))
    ).select(*events.columns, "matched_rules", "channels")
