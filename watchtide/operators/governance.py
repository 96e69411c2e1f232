"""Retention, erasure, storage tiers and ingest quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.basics import as_of_col, blank_to_null
from ..functions.fields import json_field, label, linkage_key
from ..functions.times import bucket_seconds
from ..plans.lookups import attach
from ..plans.sweep import running_totals

# Tier defaults, minute quota.
HOT_DAYS, COLD_DAYS = 3, 30
REQUESTS_PER_MINUTE = 1000
WINDOW_SECONDS = 60

REQUEST = ["request_id", "tenant_id", "user_id", "from_ts", "to_ts"]
# Microseconds before and after all timestamps.
_ENDLESS = 1 << 61


def expire_rows(df: DataFrame, as_of, days: int | None = None) -> DataFrame:
    """Rows still inside their retention; ``days`` replaces the per-row column for rollups."""
    kept_for = F.lit(days) if days is not None else F.col("_retention_days")
    stamp = "bucket" if "timestamp" not in df.columns else "timestamp"
    return df.filter(F.col(stamp) + F.make_dt_interval(days=kept_for.cast("int")) > as_of_col(as_of))


def subject_key(table: str) -> Column:
    """Where a table keeps the data subject: a pseudonym on logs, a user id elsewhere."""
    if table == "metrics":
        return label("user_id")
    if table == "traces":
        return json_field("attributes", "user_id")
    return F.col("user_linkage_key")


def _has_user() -> Column:
    return F.coalesce(F.col("user_id"), F.lit("")) != ""


def _disjoint(spans: DataFrame, by: list[str]) -> DataFrame:
    """Closed spans (from_ts, to_ts) of each key as the fewest spans that cover the same instants."""
    ordered = Window.partitionBy(*by).orderBy("from_ts", "to_ts")
    reach = F.max("to_ts").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("_opens", (reach.isNull() | (F.col("from_ts") > reach)).cast("int"))
    numbered = apart.withColumn("_nth", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "_nth").agg(F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts")).drop("_nth")


def _tag(rows: DataFrame, asked: DataFrame, by: list[str], flag: str, spread_by: str | None = None) -> DataFrame:
    """``rows`` with ``flag``: whether a request of the same key covers the row's instant.

    Requests open on a side come down to two instants per key. Those with both bounds are merged to disjoint
    spans, listed per key and day, so that a row looks only at spans of its own day, however many there are.
    """
    begin, end = F.col("from_ts"), F.col("to_ts")
    rays = asked.groupBy(*by).agg(
        F.max(F.when(begin.isNull() & end.isNotNull(), end)).alias("_until"),
        F.min(F.when(begin.isNotNull() & end.isNull(), begin)).alias("_since"),
        F.max(begin.isNull() & end.isNull()).alias("_always"),
    )
    closed = _disjoint(asked.filter(begin <= end).select(*by, begin, end), by)
    days = closed.withColumn("_day", F.explode(F.sequence(F.to_date(begin), F.to_date(end))))
    listed = days.groupBy(*by, "_day").agg(F.collect_list(F.struct("from_ts", "to_ts")).alias("_spans"))
    tagged = attach(rows, rays, by, ["_until", "_since", "_always"], spread_by)
    tagged = attach(tagged.withColumn("_day", F.to_date("timestamp")), listed, [*by, "_day"], ["_spans"], spread_by)
    ts = F.col("timestamp")
    hits = (ts <= F.col("_until"), ts >= F.col("_since"), F.col("_always"), F.exists("_spans", lambda r: ts.between(r["from_ts"], r["to_ts"])))
    covered = F.lit(False)
    for hit in hits:
        covered = covered | F.coalesce(hit, F.lit(False))
    return tagged.withColumn(flag, covered).drop("_until", "_since", "_always", "_day", "_spans")


def _receipts(erased: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows that each request covers, as the difference of two running totals of its scope."""
    probes = F.array(
        F.struct(F.lit("start").alias("_probe"), F.coalesce(F.unix_micros("from_ts"), F.lit(-_ENDLESS)).alias("_us"), F.lit(0).alias("_order")),
        F.struct(F.lit("end").alias("_probe"), F.coalesce(F.unix_micros("to_ts"), F.lit(_ENDLESS)).alias("_us"), F.lit(2).alias("_order")),
    )
    request = F.struct(*REQUEST).alias("_request")
    questions = asked.select("tenant_id", "_scope", request, F.explode(probes).alias("_p")).select("*", "_p.*").drop("_p")
    events = erased.withColumn("_order", F.lit(1)).unionByName(questions.withColumn("_rows", F.lit(0).cast("bigint")), allowMissingColumns=True)
    totals = running_totals(events, ["tenant_id", "_scope"], "_us", ["_order"], ["_rows"]).filter(F.col("_probe").isNotNull())

    def total(probe: str) -> Column:
        return F.max(F.when(F.col("_probe") == probe, F.col("run__rows")))

    counted = totals.groupBy("_request").agg(F.greatest(total("end") - total("start"), F.lit(0)).cast("bigint").alias("erased"))
    return counted.select("_request.*", "erased")


def erase_subject(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the requested rows, and a receipt per request and table.

    ``requests``: request_id, tenant_id, user_id (may be blank), from_ts, to_ts (may be NULL); both bounds are
    inclusive. A request needs a user or a time bound; others erase nothing and have no receipt, and one that ends
    before it starts erases nothing. A receipt counts every row its request covers, also those that others cover;
    equal requests share one receipt, and ids may repeat between tenants. Rows are tagged, never multiplied, so
    neither the number of requests nor their overlaps change what a row costs.
    """
    usable = requests.select(*REQUEST).filter(_has_user() | F.col("from_ts").isNotNull() | F.col("to_ts").isNotNull())
    timed = usable.filter(~_has_user()).withColumn("_scope", F.lit(""))
    kept, receipts = {}, []
    for table, df in tables.items():
        key = linkage_key("tenant_id", "user_id") if table == "logs" else F.col("user_id")
        named = usable.filter(_has_user()).withColumn("_scope", key)
        rows = df.withColumn("_scope", blank_to_null(subject_key(table)))
        tagged = _tag(rows, named, ["tenant_id", "_scope"], "_by_subject")
        tagged = _tag(tagged, timed, ["tenant_id"], "_by_tenant", spread_by="timestamp")
        kept[table] = tagged.filter(~F.col("_by_subject") & ~F.col("_by_tenant")).select(*df.columns)
        scopes = F.array_compact(F.array(F.when(F.col("_by_subject"), F.col("_scope")), F.when(F.col("_by_tenant"), F.lit(""))))
        erased = tagged.select("tenant_id", F.explode(scopes).alias("_scope"), F.unix_micros("timestamp").alias("_us"))
        erased = erased.groupBy("tenant_id", "_scope", "_us").agg(F.count(F.lit(1)).alias("_rows"))
        receipts.append(
            _receipts(erased, named.unionByName(timed)).select(
                "request_id", "tenant_id", F.lit(table).alias("table"),
                F.concat_ws(
                    " and ",
                    F.when(_has_user(), "subject"),
                    F.when(F.col("from_ts").isNotNull(), "from"),
                    F.when(F.col("to_ts").isNotNull(), "to"),
                ).alias("filters"),
                "erased",
            )
        )
    return kept, reduce(DataFrame.unionByName, receipts)


def partition_ages(tables: dict[str, DataFrame], as_of) -> DataFrame:
    """Days since the newest row of every (table, tenant, month) partition."""
    out = None
    for table, df in tables.items():
        month = F.date_format("timestamp", "yyyyMM").alias("partition")
        ages = df.groupBy("tenant_id", month).agg(F.max("timestamp").alias("_newest")).select(
            F.lit(table).alias("table"), "tenant_id", "partition",
            F.datediff(as_of_col(as_of), F.col("_newest")).alias("age_days"),
        )
        out = ages if out is None else out.unionByName(ages)
    return out


def classify_tiers(partitions: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier of each partition by its age and the tenant's settings; zero cold days never expire."""
    settings = tiers.select("tenant_id", "hot_days", "cold_days")
    joined = partitions.join(settings, "tenant_id", "left").withColumns({
        "hot_days": F.coalesce("hot_days", F.lit(HOT_DAYS)), "cold_days": F.coalesce("cold_days", F.lit(COLD_DAYS)),
    })
    age = F.col("age_days")
    tier = (
        F.when((F.col("cold_days") > 0) & (age >= F.col("cold_days")), "expired")
        .when(age >= F.col("hot_days"), "cold")
        .otherwise("hot")
    )
    return joined.withColumn("tier", tier)


def move_plan(classified: DataFrame) -> DataFrame:
    """Partitions on the hot volume that belong on the cold one, in a fixed order.

    ``volume`` tells where a partition is now; without the column all are hot.
    """
    hot = F.col("volume") != "cold" if "volume" in classified.columns else F.lit(True)
    reason = F.concat(F.lit("age "), "age_days", F.lit("d ≥ hot window "), "hot_days", F.lit("d"))
    return (
        classified.filter(hot & (F.col("tier") == "cold"))
        .select("table", "partition", "tenant_id", F.lit("cold").alias("to_volume"), reason.alias("reason"))
        .orderBy("table", "partition", "tenant_id")
    )


def ingest_rate_windows(requests: DataFrame, limit: int = REQUESTS_PER_MINUTE, ts: str = "timestamp") -> DataFrame:
    """Requests per tenant and minute against the quota."""
    counted = requests.groupBy("tenant_id", bucket_seconds(ts, WINDOW_SECONDS).alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return rate_windows(counted, limit)


def rate_windows(counted: DataFrame, limit: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """Counts per tenant and window against the quota."""
    return counted.select(
        "tenant_id", "window_start", "requests", (F.col("requests") > limit).alias("exceeded"),
        F.greatest(F.lit(limit) - F.col("requests"), F.lit(0)).cast("bigint").alias("remaining"),
        (F.col("window_start") + WINDOW_SECONDS).alias("reset_at"),
    )
