"""Retention, erasure, tier, quota and masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as FL
from ..functions import masking as MK
from ..functions.levels import normalize_level
from ..functions.times import normalize_timestamp
from ..operators import governance as G
from ..sources import adapters as A
from .base import NOW, r6, register

AS_OF = A.AS_OF


@register(
    "expire_rows",
    f"""SELECT tenant_id, service, count(*) AS n FROM {{logs}} WHERE "timestamp" + to_days(_retention_days) > {NOW} GROUP BY ALL""",
)
def unexpired(spark, sf):
    return G.expire_rows(A.logs(spark, sf), AS_OF).groupBy("tenant_id", "service").agg(F.count("*").alias("n"))


REQUESTS = [
    ("q1", "ten_1", "4", None, None), ("q2", "ten_1", "7", "2024-01-05 00:00:00", "2024-01-20 00:00:00"),
    ("q3", "ten_2", "", "2024-01-10 00:00:00", "2024-01-11 00:00:00"), ("q4", "ten_0", "", None, None), ("q5", "ten_1", "4", "2024-01-20 00:00:00", None),
]
_REQ = "req(request_id, tenant_id, uid, a, b) AS (VALUES " + ", ".join(
    f"('{i}', '{t}', '{u}', {'NULL' if a is None else repr(a)}::TIMESTAMP, {'NULL' if b is None else repr(b)}::TIMESTAMP)" for i, t, u, a, b in REQUESTS
) + ")"
_ERASES = """l.tenant_id = req.tenant_id AND (req.uid <> '' OR a IS NOT NULL OR b IS NOT NULL) AND (req.uid = '' OR l.uid = req.uid)
    AND (a IS NULL OR l."timestamp" >= a) AND (b IS NULL OR l."timestamp" <= b)"""
_OWNED = """l AS (SELECT concat('ten_', cast(user_id % 3 AS string)) AS tenant_id, ts AS "timestamp", cast(user_id AS string) AS uid, event_id FROM events)"""


def requests_of(spark):
    rows = spark.createDataFrame(REQUESTS, "request_id string, tenant_id string, user_id string, from_ts string, to_ts string")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("from_ts", "to_ts")})


def _owned_tables(spark, sf):
    logs = A.logs(spark, sf).withColumn("user_linkage_key", FL.linkage_key("tenant_id", "user_linkage_key"))
    users = A.load(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"))
    metrics = A.metrics(spark, sf).join(users, "id").withColumn("attributes", F.create_map(F.lit("user_id"), F.col("user_id"))).drop("user_id")
    return {"logs": logs, "metrics": metrics}


@register(
    "erase_subject",
    f"""WITH {_REQ}, {_OWNED}, t AS (SELECT unnest(['logs', 'metrics']) AS "table")
        SELECT request_id, req.tenant_id, "table", CASE WHEN uid <> '' THEN 'subject' ELSE '' END || CASE WHEN uid <> '' AND a IS NOT NULL THEN ' and ' ELSE '' END
          || CASE WHEN a IS NOT NULL THEN 'from' ELSE '' END || CASE WHEN b IS NOT NULL THEN ' and to' ELSE '' END AS filters,
          (SELECT count(*) FROM l WHERE {_ERASES}) AS erased FROM req, t WHERE uid <> '' OR a IS NOT NULL OR b IS NOT NULL""",
)
def receipts(spark, sf):
    return G.erase_subject(_owned_tables(spark, sf), requests_of(spark))[1]


@register(
    "erase_subject_kept",
    f"""WITH {_REQ}, {_OWNED} SELECT tenant_id, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM req WHERE {_ERASES}) GROUP BY tenant_id""",
)
def kept(spark, sf):
    tables, _ = G.erase_subject(_owned_tables(spark, sf), requests_of(spark))
    return tables["logs"].groupBy("tenant_id").agg(F.count("*").alias("n"))


_TIERS = "tiers(tenant_id, hot, cold) AS (VALUES ('ten_0', 1, 0), ('ten_1', 40, 60))"


@register(
    "classify_tiers",
    f"""WITH {_TIERS}, p AS (SELECT 'logs' AS "table", tenant_id, strftime("timestamp", '%Y%m') AS partition, datediff('day', max("timestamp"), {NOW}) AS age_days FROM {{logs}} GROUP BY ALL
          UNION ALL SELECT 'traces', tenant_id, strftime("timestamp", '%Y%m'), datediff('day', max("timestamp"), {NOW}) FROM {{traces}} GROUP BY ALL),
        c AS (SELECT p.*, coalesce(hot, 3) AS h, coalesce(cold, 30) AS c FROM p LEFT JOIN tiers USING (tenant_id))
        SELECT "table", tenant_id, partition, age_days, CASE WHEN c > 0 AND age_days >= c THEN 'expired' WHEN age_days >= h THEN 'cold' ELSE 'hot' END AS tier FROM c""",
)
def tiers(spark, sf):
    settings = spark.createDataFrame([("ten_0", 1, 0), ("ten_1", 40, 60)], "tenant_id string, hot_days int, cold_days int")
    ages = G.partition_ages({"logs": A.logs(spark, sf), "traces": A.traces(spark, sf)}, AS_OF)
    return G.classify_tiers(ages, settings).drop("hot_days", "cold_days")


@register(
    "move_plan",
    f"""WITH {_TIERS}, p AS (SELECT 'traces' AS "table", tenant_id, strftime("timestamp", '%Y%m') AS partition, datediff('day', max("timestamp"), {NOW}) AS age FROM {{traces}} GROUP BY ALL),
        c AS (SELECT p.*, coalesce(hot, 3) AS h, coalesce(cold, 30) AS c FROM p LEFT JOIN tiers USING (tenant_id))
        SELECT "table", partition, tenant_id, 'cold' AS to_volume, concat('age ', age, 'd ≥ hot window ', h, 'd') AS reason FROM c WHERE NOT (c > 0 AND age >= c) AND age >= h""",
)
def moves(spark, sf):
    settings = spark.createDataFrame([("ten_0", 1, 0), ("ten_1", 40, 60)], "tenant_id string, hot_days int, cold_days int")
    return G.move_plan(G.classify_tiers(G.partition_ages({"traces": A.traces(spark, sf)}, AS_OF), settings))


@register(
    "ingest_rate_windows",
    """SELECT tenant_id, w AS window_start, n AS requests, n > 2 AS exceeded, greatest(2 - n, 0) AS remaining, w + 60 AS reset_at FROM
       (SELECT tenant_id, epoch_us("timestamp") // 60000000 * 60 AS w, count(*) AS n FROM {logs} GROUP BY ALL)""",
)
def rates(spark, sf):
    return G.ingest_rate_windows(A.logs(spark, sf), 2)


def _sql_mask(column: str, replacement: str) -> str:
    out = column
    for kind in ("email", "jwt", "ipv4", "ipv6"):
        out = f"regexp_replace({out}, '{MK.DETECTORS[kind]}', '{replacement % kind if '%s' in replacement else replacement}', 'g')"
    return out


# Cards need a digit sum per match, so the oracle looks at every candidate of the text and swaps the valid ones.
_LUHN = """(length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN
    (CASE WHEN cast(d[length(d) - i + 1] AS int) > 4 THEN cast(d[length(d) - i + 1] AS int) * 2 - 9 ELSE cast(d[length(d) - i + 1] AS int) * 2 END)
    ELSE cast(d[length(d) - i + 1] AS int) END)) % 10 = 0)"""


def _card_steps(source: str, replacement: str) -> str:
    """CTEs that mask valid cards of ``source`` (columns id, t0) by splitting around candidates."""
    card = MK.DETECTORS["card"]
    return f"""m AS (SELECT id, t0, regexp_extract_all(t0, '{card}') AS ms, string_split(regexp_replace(t0, '{card}', chr(1), 'g'), chr(1)) AS ps FROM {source}),
        x AS (SELECT id, t0, ms, ps, unnest(range(0, len(ps))) AS i FROM m),
        y AS (SELECT id, t0, i, ps[i + 1] AS piece, CASE WHEN i = 0 THEN '' ELSE ms[i] END AS hit, CASE WHEN i = 0 THEN '' ELSE regexp_replace(ms[i], '[^0-9]', '', 'g') END AS d FROM x),
        z AS (SELECT id, t0, string_agg(concat(CASE WHEN {_LUHN} THEN {replacement} ELSE hit END, piece), '' ORDER BY i) AS t1 FROM y GROUP BY id, t0)"""


# Word boundaries in DuckDB are ASCII only. Marking every run of other letters with an underscore on
# both sides makes them count as word characters; the marks are taken out again at the end.
_MARK = """regexp_replace(text, '([^\\x00-\\x7F]+)', '_' || chr(2) || '\\1' || chr(2) || '_', 'g')"""
_UNMARK = """'_?' || chr(2) || '_?'"""


def _mask_sql(mask: bool) -> str:
    first = _sql_mask("text", "[redacted:%s]" if mask else "")
    card = "'[redacted:card]'" if mask else "''"
    phone = "[redacted:phone]" if mask else ""
    kinds = ", ".join(f"CASE WHEN regexp_matches({_sql_before(kind, mask)}, '{MK.DETECTORS[kind]}') THEN '{kind}' END" for kind in ("email", "jwt", "ipv4", "ipv6"))
    return f"""WITH marked AS (SELECT doc_id, {_MARK} AS text FROM documents), s AS (SELECT doc_id AS id, {first} AS t0 FROM marked), {_card_steps("s", card)},
        k AS (SELECT doc_id AS id, [{kinds}] AS ks FROM marked)
        SELECT z.id AS doc_id, regexp_replace(regexp_replace(t1, '{MK.DETECTORS["phone"]}', '{phone}', 'g'), {_UNMARK}, '', 'g') AS text,
          array_to_string(list_sort(list_filter(list_concat(ks, [CASE WHEN t0 <> t1 THEN 'card' END, CASE WHEN regexp_matches(t1, '{MK.DETECTORS["phone"]}') THEN 'phone' END]), lambda v: v IS NOT NULL)), ',') AS types
        FROM z JOIN k USING (id)"""


def _sql_before(kind: str, mask: bool) -> str:
    out = "text"
    for earlier in ("email", "jwt", "ipv4", "ipv6"):
        if earlier == kind:
            return out
        out = f"regexp_replace({out}, '{MK.DETECTORS[earlier]}', '{f'[redacted:{earlier}]' if mask else ''}', 'g')"
    return out


@register("mask_pii", _mask_sql(True))
def masked(spark, sf):
    """Every detector over whole documents, masked."""
    docs = A.load(spark, sf, "documents").select("doc_id", MK.mask_pii("text").alias("m"))
    return docs.select("doc_id", "m.text", "m.types")


@register("mask_pii_drop", _mask_sql(False))
def dropped(spark, sf):
    actions = dict.fromkeys(MK.DETECTORS, "drop_field")
    docs = A.load(spark, sf, "documents").select("doc_id", MK.mask_pii("text", actions).alias("m"))
    return docs.select("doc_id", "m.text", "m.types")


def _hash_sql() -> str:
    """All detectors in their order: each splits the text around its matches and puts hashes in their place."""
    steps, source = [], f"(SELECT doc_id AS id, coalesce(text, '') AS t, [] AS ks FROM documents)"
    for kind, pattern in MK.DETECTORS.items():
        if kind == "ipv4":  # the first one with word boundaries
            source = f"(SELECT id, {_MARK.replace('(text', '(t')} AS t, ks FROM {source})"
        hit = _LUHN if kind == "card" else "true"
        steps.append(f"""{kind}_cut AS (SELECT id, ks, regexp_extract_all(t, '{pattern}') AS ms, string_split(regexp_replace(t, '{pattern}', chr(1), 'g'), chr(1)) AS ps FROM {source}),
            {kind}_part AS (SELECT id, ks, i, ps[i + 1] AS piece, CASE WHEN i > 0 THEN ms[i] END AS hit, CASE WHEN i > 0 THEN regexp_replace(ms[i], '[^0-9]', '', 'g') ELSE '' END AS d
              FROM (SELECT *, unnest(range(0, len(ps))) AS i FROM {kind}_cut)),
            {kind}_done AS (SELECT id, list_concat(ks, CASE WHEN bool_or(hit IS NOT NULL AND {hit}) THEN ['{kind}'] ELSE [] END) AS ks,
              string_agg(concat(CASE WHEN hit IS NULL THEN '' WHEN {hit} THEN concat('{kind}:', substr(sha256(hit), 1, 12)) ELSE hit END, piece), '' ORDER BY i) AS t
              FROM {kind}_part GROUP BY id, ks)""")
        source = f"{kind}_done"
    return f"""WITH {", ".join(steps)} SELECT id AS doc_id, regexp_replace(t, {_UNMARK}, '', 'g') AS text, array_to_string(list_sort(ks), ',') AS types FROM {source}"""


@register("mask_pii_hash", _hash_sql())
def hashed(spark, sf):
    """Whatever a detector finds is replaced by a hash of itself."""
    docs = A.load(spark, sf, "documents").select("doc_id", MK.mask_pii("text", dict.fromkeys(MK.DETECTORS, "hash")).alias("m"))
    return docs.select("doc_id", "m.text", F.array_join("m.types", ",").alias("types"))


@register(
    "mask_pii_json",
    f"""SELECT doc_id, types, json_object('keep@key.io', doc_id, 'nested', json_array(text))::VARCHAR AS text FROM ({_mask_sql(True)})""",
)
def masked_json(spark, sf):
    """Whole documents as string values of a JSON text: the values are masked, its keys stay."""
    docs = A.load(spark, sf, "documents")
    text = F.concat(F.lit('{"keep@key.io":'), F.col("doc_id").cast("string"), F.lit(',"nested":'), F.to_json(F.array("text")), F.lit("}"))
    return docs.select("doc_id", MK.mask_pii_json(text).alias("m")).select("doc_id", "m.text", "m.types")


@register(
    "luhn_ok",
    f"SELECT l_orderkey, l_linenumber, l_partkey, d, {_LUHN} AS ok FROM (SELECT *, cast(4000000000000000 + l_orderkey * 1000 + l_partkey AS string) AS d FROM lineitem)",
)
def cards(spark, sf):
    number = (F.lit(4_000_000_000_000_000) + F.col("l_orderkey") * 1000 + F.col("l_partkey")).cast("string")
    items = A.load(spark, sf, "lineitem").withColumn("d", number)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "d", MK.luhn_ok(F.col("d")).alias("ok"))


def _basic_sql() -> str:
    out = "text"
    for pattern, placeholder in MK.BASIC_MASKS:
        out = f"regexp_replace({out}, '{pattern}', '{placeholder}', 'g')"
    return out


@register("mask_text_basic", f"SELECT doc_id, {_basic_sql()} AS text FROM documents")
def basic(spark, sf):
    return A.load(spark, sf, "documents").select("doc_id", MK.mask_text_basic("text").alias("text"))


@register(
    "normalize_level",
    """SELECT raw, CASE WHEN lower(trim(raw)) IN ('trace') THEN 'trace' WHEN lower(trim(raw)) IN ('debug', 'dbg') THEN 'debug' WHEN lower(trim(raw)) IN ('warn', 'warning') THEN 'warn'
       WHEN lower(trim(raw)) IN ('err', 'error') THEN 'error' WHEN lower(trim(raw)) IN ('fatal', 'critical', 'crit', 'panic', 'emergency') THEN 'fatal' ELSE 'info' END AS level, count(*) AS n
       FROM (SELECT [' ERR', 'Warning', 'dbg', 'panic ', 'notice', 'Trace', event_type][cast(event_id % 7 AS int) + 1] AS raw FROM events) GROUP BY ALL""",
)
def levels(spark, sf):
    names = F.array(*map(F.lit, [" ERR", "Warning", "dbg", "panic ", "notice", "Trace"]), F.col("event_type"))
    raw = F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))
    out = A.load(spark, sf, "events").select(raw.alias("raw"), normalize_level(raw).alias("level"))
    return out.groupBy("raw", "level").agg(F.count("*").alias("n"))


@register(
    "normalize_timestamp",
    f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN us // 1000000 * 1000000 WHEN 1 THEN us // 1000 * 1000 WHEN 6 THEN epoch_us({NOW}) ELSE us END AS at
        FROM (SELECT event_id, epoch_us(ts) AS us FROM events)""",
)
def stamps(spark, sf):
    """Seconds, millis, micros, nanos, RFC 3339 with offset, plain text and rubbish."""
    at = F.col("ts").cast("timestamp")
    us = F.unix_micros(at)
    text = F.element_at(
        F.array(
            F.floor(us / 1_000_000).cast("bigint").cast("string"), F.floor(us / 1000).cast("bigint").cast("string"), us.cast("string"), (us * 1000 + 7).cast("string"),
            F.concat(F.date_format(at + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30")),
            F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yesterday"),
        ),
        (F.col("event_id") % 7 + 1).cast("int"),
    )
    return A.load(spark, sf, "events").select("event_id", normalize_timestamp(text, AS_OF).alias("at"))


@register("fingerprint", "SELECT id, sha1(concat(tenant_id, '|', service)) AS fingerprint FROM {logs}")
def fingerprints(spark, sf):
    return A.logs(spark, sf).select("id", FL.fingerprint("tenant_id", "service").alias("fingerprint"))


@register("linkage_key", "SELECT id, sha256(concat(tenant_id, ':', user_linkage_key)) AS linkage_key FROM {logs}")
def linkage(spark, sf):
    return A.logs(spark, sf).select("id", FL.linkage_key("tenant_id", "user_linkage_key").alias("linkage_key"))


@register(
    "round_n",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6('l_extendedprice * (1 - l_discount)', 2)} AS net FROM lineitem",
)
def rounded(spark, sf):
    from ..functions.basics import round_n

    net = round_n(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    return A.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net.alias("net"))


@register(
    "ref_name",
    """SELECT ref, CASE WHEN event_id % 4 = 3 THEN '(unknown)' ELSE event_type END AS name, count(*) AS n FROM
       (SELECT *, CASE event_id % 4 WHEN 0 THEN concat('refs/heads/', event_type) WHEN 1 THEN concat('refs/tags/', event_type) WHEN 2 THEN event_type ELSE '' END AS ref FROM events) GROUP BY ALL""",
)
def refs(spark, sf):
    kind, pick = F.col("event_type"), F.col("event_id") % 4
    ref = F.when(pick == 0, F.concat(F.lit("refs/heads/"), kind)).when(pick == 1, F.concat(F.lit("refs/tags/"), kind)).when(pick == 2, kind).otherwise("")
    return A.load(spark, sf, "events").select(ref.alias("ref"), FL.ref_name(ref).alias("name")).groupBy("ref", "name").agg(F.count("*").alias("n"))
