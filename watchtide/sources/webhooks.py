"""Deploy and flag webhooks as change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import settled, text_or_empty
from ..functions.fields import ref_name

# Provider names and the wording of change titles.
PROVIDERS = ["github", "gitlab", "launchdarkly", "ld"]
CHANGE_COLUMNS = ["service", "environment", "kind", "git_sha", "deploy_id", "flag_key", "author", "title"]

# Only what the mapping reads; everything arrives as text.
_PAYLOAD = """
    ref string, after string, status string, sha string, environment string, deployable_id string,
    object_kind string, kind string, name string, title string, titleVerb string,
    repository struct<name:string>, pusher struct<name:string>, head_commit struct<id:string>,
    project struct<name:string>, user struct<name:string>, member struct<email:string>,
    deployment struct<id:string,sha:string,ref:string,environment:string,creator:struct<login:string>>,
    workflow_run struct<id:string,name:string,head_sha:string,head_branch:string,conclusion:string,actor:struct<login:string>>,
    object_attributes struct<sha:string,ref:string,status:string>
"""


def _change(**given: Column) -> Column:
    fields = [text_or_empty(given.get(c, F.lit(""))).alias(c) for c in CHANGE_COLUMNS]
    return F.struct(*fields)


def _or_default(environment: Column) -> Column:
    text = text_or_empty(environment)
    return F.when(text == "", "(default)").otherwise(text)


def normalize_change_webhooks(df: DataFrame) -> DataFrame:
    """Webhook bodies (``provider``, ``event_type``, ``payload``) as change rows.

    Events that mark no change give no row. A body of an unknown provider or that is no JSON object
    gives a row with ``error`` set and empty change fields. Other columns stay.
    """
    provider = F.lower(text_or_empty("provider"))
    parsed = df.withColumn("_p", settled(F.from_json("payload", _PAYLOAD)))  # read once, not once per field
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    p = F.col("_p")
    deployment, run, attributes = p["deployment"], p["workflow_run"], p["object_attributes"]
    repository = p["repository"]["name"]
    pushed = F.coalesce(F.nullif(p["after"], F.lit("")), F.nullif(p["head_commit"]["id"], F.lit("")))
    event = F.col("event_type")
    deploy = F.lit("deploy")

    github = (
        F.when(
            (event == "deployment") & deployment.isNotNull(),
            _change(
                service=repository, environment=deployment["environment"], kind=deploy, git_sha=deployment["sha"],
                deploy_id=deployment["id"], author=deployment["creator"]["login"],
                title=F.concat(F.lit("Deployment of "), ref_name(deployment["ref"]), F.lit(" to "), _or_default(deployment["environment"])),
            ),
        )
        .when(
            (event == "workflow_run") & (run["conclusion"] == "success"),
            _change(
                service=repository, kind=deploy, git_sha=run["head_sha"], deploy_id=run["id"], author=run["actor"]["login"],
                title=F.concat(F.lit('Workflow "'), text_or_empty(run["name"]), F.lit('" succeeded on '), ref_name(run["head_branch"])),
            ),
        )
        .when(
            (event == "push") & pushed.isNotNull(),
            _change(
                service=repository, kind=deploy, git_sha=pushed, author=p["pusher"]["name"],
                title=F.concat(F.lit("Push to "), ref_name(p["ref"])),
            ),
        )
    )
    gitlab = F.when(
        (p["object_kind"] == "pipeline") & (attributes["status"] == "success"),
        _change(
            service=p["project"]["name"], kind=deploy, git_sha=attributes["sha"], author=p["user"]["name"],
            title=F.concat(F.lit("Pipeline succeeded on "), ref_name(attributes["ref"])),
        ),
    ).when(
        (p["object_kind"] == "deployment") & (p["status"] == "success"),
        _change(
            service=p["project"]["name"], environment=p["environment"], kind=deploy, git_sha=p["sha"],
            deploy_id=p["deployable_id"], author=p["user"]["name"],
            title=F.concat(F.lit("Deployment to "), _or_default(p["environment"])),
        ),
    )
    described = F.trim(F.concat_ws(" ", F.lit("Flag"), text_or_empty(p["name"]), text_or_empty(p["titleVerb"])))
    flag = _change(
        kind=F.lit("flag"), flag_key=p["name"], author=p["member"]["email"],
        title=F.coalesce(F.nullif(p["title"], F.lit("")), described),
    )
    error = F.when(~provider.isin(PROVIDERS), F.concat(F.lit("unknown provider "), text_or_empty("provider"))).when(
        ~readable, F.concat(provider, F.lit(" payload is not a JSON object"))
    )
    change = (
        F.when(F.col("_error").isNotNull(), _change())
        .when(provider == "github", github)
        .when(provider == "gitlab", gitlab)
        .otherwise(flag)
    )
    rows = parsed.withColumn("_error", settled(error)).withColumn("_c", settled(change)).filter(F.col("_c").isNotNull())
    kept = [c for c in df.columns if c not in ("payload", *CHANGE_COLUMNS)]
    return rows.select(*kept, "_c.*", F.col("_error").alias("error"))
