"""Line formats: NDJSON, GELF and RFC 5424 syslog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import json_entries, quote_json
from ..functions.levels import syslog_level
from .records import json_text_or_null, payload_fields

# GELF fields with a meaning of their own, and the syslog line layout.
GELF_FIELDS = ["host", "short_message", "full_message", "timestamp", "level"]
GELF_RESERVED = "id"
SYSLOG = r"^<([0-9]{1,5})>([^ ]*)(?: ([^ ]*))?(?: ([^ ]*))?(?: ([^ ]*))?(?: ([^ ]*))?(?: ([^ ]*))?(?: (.*))?$"
# "-" or one or more bracket groups, each possibly holding nested brackets one level deep
STRUCTURED_DATA = r"^(?:-\s*|(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\] *)+)"
ABSENT = "-"


def read_lines(spark, path: str) -> DataFrame:
    """Text files as one ``value`` row per line."""
    return spark.read.text(path)


def _nonblank(lines: DataFrame, column: str) -> DataFrame:
    trimmed = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return lines.withColumn(column, trimmed).filter(F.col(column) != "")


def read_ndjson_logs(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: payload fields of every JSON object line, and the lines that are not one.

    Blank lines vanish; other columns of ``lines`` stay.
    """
    marked = _nonblank(lines, column).withColumn("_good", json_entries(column).isNotNull())
    good = payload_fields(marked.filter("_good").drop("_good"), column)
    return good, marked.filter(~F.col("_good")).drop("_good")


def read_gelf(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: payload fields of every GELF line, and the lines that are no JSON object. Blank lines vanish."""
    bad = _nonblank(lines, column).filter(json_entries(column).isNull())
    return parse_gelf(lines, column), bad


def parse_gelf(lines: DataFrame, column: str = "value") -> DataFrame:
    """GELF lines as payload fields; :func:`read_gelf` also gives the lines that are no JSON object."""
    entries = _nonblank(lines, column).withColumn("_e", json_entries(column)).filter(F.col("_e").isNotNull())
    field = lambda name: json_text_or_null(F.col("_e")[name])
    bare = lambda key: F.when(key.startswith("_"), F.substring(key, 2, 2**30)).otherwise(key)

    def beaten(key: Column) -> Column:
        """Whether "x" stands beside this "_x", or the reverse, and comes later in key order."""
        other = F.when(key.startswith("__"), F.lit(None)).when(key.startswith("_"), bare(key)).otherwise(F.concat(F.lit("_"), key))
        return F.coalesce((other > key) & ~other.isin(GELF_FIELDS) & F.map_contains_key("_e", other), F.lit(False))

    extra = F.map_filter("_e", lambda k, _: ~k.isin(GELF_FIELDS) & (bare(k) != GELF_RESERVED) & ~beaten(k))
    renamed = F.transform_keys(extra, lambda k, _: bare(k))
    level = field("level").try_cast("int")
    return entries.select(
        *[c for c in lines.columns if c != column],
        field("timestamp").alias("timestamp"),
        field("host").alias("service"),
        F.when(level.isNotNull(), syslog_level(level)).alias("level"),
        F.coalesce(field("short_message"), field("full_message")).alias("message"),
        renamed.alias("extra"),
    )


def parse_syslog(lines: DataFrame, column: str = "value") -> DataFrame:
    """RFC 5424 lines as payload fields; a line of another shape is kept whole as an ``info`` message."""
    rows = _nonblank(lines, column)
    line = F.col(column)
    part = lambda i: F.regexp_extract(line, SYSLOG, i)
    priority = part(1).try_cast("int")
    known = line.rlike(SYSLOG) & priority.isNotNull() & (priority <= 65535)
    present = lambda c: F.when((c != "") & (c != ABSENT), c)
    stamp, host, app, tail = part(3), part(4), part(5), part(8)
    message = F.regexp_replace(F.ltrim(tail), STRUCTURED_DATA, "")
    extra = F.when(
        known & present(host).isNotNull(), F.create_map(F.lit("host"), quote_json(host))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        *[c for c in lines.columns if c != column],
        F.when(known, present(stamp)).alias("timestamp"),
        F.when(known, F.coalesce(present(app), present(host))).alias("service"),
        F.when(known, syslog_level(priority % 8)).otherwise("info").alias("level"),
        F.when(known, message).otherwise(line).alias("message"),
        extra.alias("extra"),
    )
