"""The shared test tables read as signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

AS_OF = "2024-01-31 00:00:00"
# Tasks per core that rows are dealt to, so that no core waits long for the last ones.
WAVES = 4


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores: worth its shuffle ahead of costly work per row.

    A split without the middle of a row group gives no rows, so a file of few row groups keeps few cores busy however
    many splits it has. Only a table of many times more splits than cores stays as it is.
    """
    slots = WAVES * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _tag(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _events(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))


def _owner() -> list[Column]:
    return [_tag("ten_", F.col("user_id") % 3).alias("tenant_id"), _tag("svc_", F.col("user_id") % 7).alias("service")]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "signup", "info")
        .when(kind == "click", "debug").otherwise("trace")
    )
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"),
        "timestamp",
        *_owner(),
        F.when(F.col("user_id") % 2 == 0, "prod").otherwise("").alias("environment"),
        level.alias("level"),
        F.concat(kind, F.lit(" request took "), F.floor("value").cast("bigint").cast("string"), F.lit("ms")).alias("message"),
        F.col("props").alias("body"),
        _tag("t", F.col("event_id") % 500).alias("trace_id"),
        F.concat_ws("-", (F.col("event_id") % 500).cast("string"), (F.col("event_id") % 7 + 1).cast("string")).alias("span_id"),
        F.col("user_id").cast("string").alias("user_linkage_key"),
        (7 + F.col("user_id") % 3).cast("int").alias("_retention_days"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 5).cast("string")
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"),
        "timestamp",
        *_owner(),
        F.when(F.col("user_id") % 2 == 0, "prod").otherwise("").alias("environment"),
        F.concat(F.lit("app."), "event_type").alias("metric_name"),
        F.lit("gauge").alias("metric_type"),
        "value",
        F.create_map(F.lit("k"), label).alias("attributes"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.min("l_returnflag")
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    spans = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        _tag("svc_", F.min("l_suppkey") % 7).alias("service"),
        F.min("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.floor(F.min("l_extendedprice") * 1000).cast("bigint") * 1000).alias("duration_ns"),
        F.when(flag == "R", "error").when(flag == "A", "ok").otherwise("unset").alias("status_code"),
    )
    parent = F.when(line == 1, "").otherwise(F.concat_ws("-", order, (line - 1).cast("string")))
    return spans.select(
        _tag("ten_", F.col("l_orderkey") % 3).alias("tenant_id"),
        _tag("t", F.col("l_orderkey")).alias("trace_id"),
        F.concat_ws("-", order, line.cast("string")).alias("span_id"),
        parent.alias("parent_span_id"),
        "service", "timestamp", "duration_ns", "status_code",
    )


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    kind = F.when(key % 4 == 0, "deploy").when(key % 4 == 1, "flag").when(key % 4 == 2, "config").otherwise("rollback")
    return _events(spark, sf_dir).filter(F.col("event_type") == "signup").select(
        key.cast("string").alias("id"), "timestamp", *_owner(), kind.alias("kind"),
        _tag("change ", key).alias("title"), _tag("sha", key).alias("git_sha"), _tag("d", key).alias("deploy_id"),
    )


def business_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("c_custkey") % 4 == 0, 99.9).when(F.col("c_custkey") % 4 == 1, 99.99).when(F.col("c_custkey") % 4 == 2, 99.5)
    return load(spark, sf_dir, "customer").select(
        _tag("ten_", F.col("c_custkey") % 3).alias("tenant_id"),
        _tag("svc_", F.col("c_nationkey") % 7).alias("service"),
        F.col("c_name").alias("customer"),
        F.col("c_mktsegment").alias("plan_tier"),
        F.col("c_acctbal").alias("monthly_revenue"),
        target.otherwise(0.0).alias("sla_target"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("timestamp").alias("created_at")
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter(F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string").alias("tenant_id"), F.col("timestamp").alias("created_at"), F.lit("query").alias("action")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log messages, one per second up to the reference time."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.col("doc_id")).alias("timestamp"),
        F.col("source").alias("tenant_id"),
        F.col("lang").alias("service"),
        F.col("text").alias("message"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert signals out of error and purchase events."""
    events = _events(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase"))
    return events.select(
        *_owner(), "timestamp",
        _tag("r", F.col("event_id") % 4).alias("rule_id"), _tag("rule ", F.col("event_id") % 4).alias("rule_name"),
        (F.col("event_id") % 100 / F.lit(100.0)).alias("confidence"),
        F.when(F.col("event_id") % 3 == 0, _tag("d", F.col("event_id"))).otherwise("").alias("deploy_id"),
        (300 * (1 + F.col("event_id") % 3)).cast("int").alias("window_seconds"),
        F.col("event_id").cast("string").alias("id"),
    )


def resolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolves of alert signals out of every fifth signup."""
    events = _events(spark, sf_dir).filter((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0))
    return events.select(*_owner(), "timestamp")


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with an actor, inside the three tenants."""
    events = _events(spark, sf_dir)
    return events.select(
        _owner()[0], F.col("timestamp").alias("created_at"), _tag("User_", F.col("user_id") % 50).alias("actor"),
        F.concat(F.lit("Logs."), "event_type").alias("action"), F.col("event_id").cast("string").alias("id"),
    )
