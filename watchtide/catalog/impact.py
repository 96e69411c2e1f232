"""Change-impact and root-cause queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deploys as D
from ..sources import adapters as A
from .base import ALL_TIME, DAY, NOW, r6, register, rn
from .tracing import edges_of

AS_OF = A.AS_OF
WINDOW = 10 * DAY
HALF = WINDOW // 4


def _health(source: str, half: int) -> str:
    """Counts around the changes of ``source`` as a range join."""
    sec = "date_trunc('second', c.\"timestamp\")"
    before = f'l."timestamp" >= {sec} - INTERVAL {half} SECOND AND l."timestamp" <= {sec}'
    after = f'l."timestamp" >= {sec} AND l."timestamp" <= least({sec} + INTERVAL {half} SECOND, {NOW})'
    bad = "l.level IN ('error', 'fatal')"
    return f"""SELECT c.tenant_id, c.service, c.id, count(*) FILTER ({before}) AS before_total, count(*) FILTER ({before} AND {bad}) AS before_err,
        count(*) FILTER ({after}) AS after_total, count(*) FILTER ({after} AND {bad}) AS after_err
        FROM {source} c LEFT JOIN {{logs}} l ON c.tenant_id = l.tenant_id AND c.service = l.service
          AND l."timestamp" >= {sec} - INTERVAL {half} SECOND AND l."timestamp" <= {sec} + INTERVAL {half} SECOND GROUP BY ALL"""


_RB = "CASE WHEN before_total > 0 THEN before_err / before_total::DOUBLE ELSE 0.0::DOUBLE END"
_RA = "CASE WHEN after_total > 0 THEN after_err / after_total::DOUBLE ELSE 0.0::DOUBLE END"
_RATES = f"""{rn(_RB, 4)} AS before_rate, {rn(_RA, 4)} AS after_rate, {rn(f"({_RA}) - ({_RB})", 4)} AS delta"""


@register(
    "change_health",
    f"""WITH h AS ({_health("{changes}", HALF)}) SELECT *, after_total > 0 AND delta > 0.02 AS degraded FROM (SELECT *, {_RATES} FROM h)""",
)
def change_health(spark, sf):
    """Error rates around every change."""
    health = D.change_health(A.change_events(spark, sf), A.logs(spark, sf), AS_OF, WINDOW)
    return health.select(
        "tenant_id", "service", "id", "before_total", "before_err", "after_total", "after_err",
        "before_rate", "after_rate", "delta", "degraded",
    )


_WEIGHT = "CASE kind WHEN 'deploy' THEN 1.0 WHEN 'rollback' THEN 0.95 WHEN 'config' THEN 0.75 WHEN 'flag' THEN 0.65 ELSE 0.70 END"
_AGE = f"greatest(epoch_us({NOW}) // 1000000 - epoch_us(\"timestamp\") // 1000000, 0)"
_NEWEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY "timestamp" DESC, id DESC) AS rn
    FROM {changes} WHERE "timestamp" > %s - INTERVAL %d SECOND AND "timestamp" <= %s) WHERE rn <= %d"""
_PRIOR = """SELECT c.tenant_id, c.service, c.id, arg_max(struct_pack(g := d.git_sha, d := d.deploy_id), (epoch_us(d."timestamp"), d.git_sha, d.deploy_id)) AS t
    FROM {changes} c JOIN {changes} d ON d.kind = 'deploy' AND c.tenant_id = d.tenant_id AND c.service = d.service
      AND d."timestamp" < date_trunc('second', c."timestamp") GROUP BY c.tenant_id, c.service, c.id"""


@register(
    "rank_deploy_culprits",
    f"""WITH top AS ({_NEWEST % (NOW, WINDOW, NOW, 15)}), h AS ({_health("top", HALF)}),
        j AS (SELECT top.*, {_AGE} AS age_seconds, before_total, before_err, after_total, after_err, {_RATES}
          FROM top JOIN h USING (tenant_id, service, id)),
        k AS (SELECT *, after_total > 0 AND delta > 0.02 AS degraded, exp(-age_seconds / {WINDOW}.0::DOUBLE) * ({_WEIGHT}) AS st FROM j),
        s AS (SELECT *, {rn("CASE WHEN after_total = 0 THEN st ELSE 0.55 * st + 0.45 * least(greatest(delta * 5, 0), 1) END", 2)} AS score FROM k),
        p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY score DESC, "timestamp" DESC, id DESC) AS position FROM s),
        d AS ({_PRIOR})
        SELECT p.tenant_id, p.service, p.id, p.kind, p.age_seconds, p.score, p.position, p.degraded,
          CASE WHEN position = 1 AND kind = 'deploy' AND degraded THEN t.g END AS rollback_git_sha,
          CASE WHEN position = 1 AND kind = 'deploy' AND degraded THEN t.d END AS rollback_deploy_id
        FROM p LEFT JOIN d USING (tenant_id, service, id)""",
)
def culprits(spark, sf):
    """Likely culprit changes per service with rollback targets."""
    ranked = D.rank_deploy_culprits(A.change_events(spark, sf), A.logs(spark, sf), AS_OF, WINDOW, limit=15)
    return ranked.select(
        "tenant_id", "service", "id", "kind", "age_seconds", "score", "position", "degraded", "rollback_git_sha", "rollback_deploy_id"
    )


@register(
    "prior_deploy",
    f"""WITH d AS ({_PRIOR}) SELECT c.tenant_id, c.service, c.id, t.g AS rollback_git_sha, t.d AS rollback_deploy_id
        FROM {{changes}} c LEFT JOIN d USING (tenant_id, service, id)""",
)
def prior(spark, sf):
    found = D.prior_deploy(A.change_events(spark, sf))
    return found.select("tenant_id", "service", "id", "rollback_git_sha", "rollback_deploy_id")


@register(
    "nearby_deploy",
    """WITH f AS (SELECT s.id, arg_max(c.deploy_id, (epoch_us(c."timestamp"), c.deploy_id)) AS d FROM {signals} s JOIN {changes} c
          ON c.kind = 'deploy' AND s.tenant_id = c.tenant_id AND s.service = c.service AND c."timestamp" <= s."timestamp"
          AND epoch_us(c."timestamp") > epoch_us(s."timestamp") - s.window_seconds * 100 * 3000000::BIGINT GROUP BY s.id)
       SELECT tenant_id, service, s.id, coalesce(d, '') AS nearby_deploy_id FROM {signals} s LEFT JOIN f ON s.id = f.id""",
)
def nearby(spark, sf):
    """Windows a hundred times the rule's, so that the thin test data has hits."""
    signals = A.signals(spark, sf).withColumn("window_seconds", F.col("window_seconds") * 100)
    return D.nearby_deploy(signals, A.change_events(spark, sf)).select("tenant_id", "service", "id", "nearby_deploy_id")


_CANDIDATES = f"""top AS ({_NEWEST % (NOW, WINDOW, NOW, 10)}),
    u AS (SELECT tenant_id, service, 'deploy' AS type, concat(kind, ' ', title) AS subject,
        {rn(f"0.9 * exp(-({_AGE}) / {WINDOW}.0::DOUBLE)", 2)} AS score, ({_AGE})::DOUBLE AS age_seconds, NULL::BIGINT AS calls,
        NULL::BIGINT AS errors, epoch_us("timestamp") AS us, id AS tie FROM top
      UNION ALL SELECT tenant_id, caller, 'dependency', callee, {rn("0.4 + 0.5 * least(errors / calls::DOUBLE, 1)", 2)}, NULL, calls, errors, NULL, callee
        FROM {{edges}} WHERE errors > 0),
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY score DESC, type DESC, us DESC NULLS LAST, tie) AS rn FROM u) WHERE rn <= 10)"""


@register(
    "rca_candidates",
    f"WITH {_CANDIDATES} SELECT tenant_id, service, type, subject, score, age_seconds, calls, errors FROM cand",
)
def candidates(spark, sf):
    found = D.rca_candidates(A.change_events(spark, sf), edges_of(spark, sf), AS_OF, WINDOW, limit=10)
    return found.select("tenant_id", "service", "type", "subject", "score", "age_seconds", "calls", "errors")


_RANKED = f"""{_CANDIDATES}, scored AS (SELECT *, {rn('''least(greatest((0.35 * CASE type WHEN 'deploy' THEN 1.0 WHEN 'dependency' THEN 0.6 ELSE 0.4 END
      + 0.30 * CASE WHEN type = 'deploy' THEN least(greatest(score, 0), 1) ELSE 0 END
      + 0.25 * CASE WHEN calls > 0 THEN least(errors / calls::DOUBLE, 1) ELSE 0 END
      + 0.10 * CASE WHEN calls > 0 THEN least(log10(1.0::DOUBLE + calls) / 4.0, 1) ELSE 0 END)::DOUBLE, 0), 1)''', 2)} AS rank_score FROM cand),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, service ORDER BY rank_score DESC, score DESC, type DESC, subject) AS position
      FROM scored WHERE rank_score >= 0.3)"""


@register(
    "rca_rank",
    f"WITH {_RANKED} SELECT tenant_id, service, type, subject, score, rank_score, position FROM ranked",
)
def ranked(spark, sf):
    """The flagship chain: spans, logs and changes to ranked likely causes."""
    found = D.rca_candidates(A.change_events(spark, sf), edges_of(spark, sf), AS_OF, WINDOW, limit=10)
    return D.rca_rank(found, gate=0.3).select("tenant_id", "service", "type", "subject", "score", "rank_score", "position")


@register(
    "rca_label_eval",
    f"""WITH {_RANKED}, fb AS (SELECT tenant_id, service, concat(kind, ' ', title) AS subject, cast(id AS bigint) % 2 AS yes FROM {{changes}})
        SELECT r.tenant_id, count(*) AS judged, cast(sum(yes) AS bigint) AS correct, {r6("avg(yes)")} AS precision_at_k
        FROM ranked r JOIN fb USING (tenant_id, service, subject) WHERE r.type = 'deploy' AND position <= 3 GROUP BY r.tenant_id""",
)
def judged(spark, sf):
    changes = A.change_events(spark, sf)
    found = D.rca_rank(D.rca_candidates(changes, edges_of(spark, sf), AS_OF, WINDOW, limit=10), gate=0.3)
    feedback = changes.select(
        "tenant_id", "service", F.lit("deploy").alias("type"), F.concat_ws(" ", "kind", "title").alias("subject"),
        (F.col("id").cast("bigint") % 2 == 1).alias("was_root_cause"),
    )
    return D.rca_label_eval(found, feedback, 3)[1]
