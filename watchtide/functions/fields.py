"""Field access into JSON text and label maps, and the canonical series key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import as_col, let, text_or_empty


# Text that is its own JSON literal between quotes.
PLAIN_TEXT = r"\A[ !#-\[\]-~]*\z"


def json_path(parts) -> str:
    if isinstance(parts, str):
        parts = parts.split(".")
    escaped = ["['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts]
    return "$" + "".join(escaped)


def json_field(column, path, stringify: bool = False) -> Column:
    """Value at a dotted path of a JSON text column.

    Missing and non-string values read as ``''``. With ``stringify`` numbers, flags and nested
    values come back as text, the way a live tail reads them.
    """
    found = F.try_variant_get(F.try_parse_json(as_col(column)), json_path(path), "variant")
    if stringify:
        return let(
            found,
            lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(
                F.to_json(v)
            ),
        )
    return let(
        found,
        lambda v: F.when(
            F.schema_of_variant(v) == "STRING", F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
        ).otherwise(F.lit("")),
    )


def json_has(column, path) -> Column:
    return F.try_variant_get(F.try_parse_json(as_col(column)), json_path(path), "variant").isNotNull()


def json_entries(column) -> Column:
    """Top level of a JSON object text as a map from key to the value's JSON text."""
    parsed = F.try_parse_json(as_col(column)).try_cast("map<string,variant>")
    return F.transform_values(parsed, lambda _, v: F.to_json(v))


def is_json_object(column) -> Column:
    """Whether :func:`json_entries` has a value, without writing the values out."""
    return F.try_parse_json(as_col(column)).try_cast("map<string,variant>").isNotNull()


def quote_json(text: Column) -> Column:
    """A string as a JSON literal."""
    # inside the brackets stands a quoted text or null, so no other bracket is at an end
    escaped = F.trim(F.to_json(F.array(text)), F.lit("[]"))
    return F.when(text.rlike(PLAIN_TEXT), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(escaped)


def unquote_json(token: Column) -> Column:
    """The text of a JSON string literal; NULL for other JSON values."""
    decoded = F.when(
        F.contains(token, F.lit("\\")), F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    ).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))
    return F.when(token.startswith('"'), decoded)


def build_json(entries: Column) -> Column:
    """The inverse of :func:`json_entries`, keys in order."""
    return let(
        entries,
        lambda m: F.concat(
            F.lit("{"),
            F.array_join(
                F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(quote_json(k), F.lit(":"), m[k])), ","
            ),
            F.lit("}"),
        ),
    )


def json_text(token: Column) -> Column:
    """A JSON value as plain text: strings unquoted, null empty, others verbatim."""
    return let(
        token,
        lambda t: F.when(t.isNull() | (t == "null"), F.lit("")).otherwise(F.coalesce(unquote_json(t), t)),
    )


def label(key: str, column="attributes") -> Column:
    """One metric label; a missing label reads as ``''``."""
    return F.coalesce(F.try_element_at(as_col(column), F.lit(key)), F.lit(""))


def metric_label(name: str) -> Column:
    """Label lookup that knows the labels held in their own columns."""
    lowered = name.lower()
    if lowered == "__name__":
        return F.col("metric_name")
    if lowered == "service":
        return F.col("service")
    if lowered in ("environment", "env"):
        return F.col("environment")
    return label(name)


def canonical_labels(labels: Column) -> Column:
    """Labels without empty values, as entries sorted by key."""
    return F.array_sort(F.map_entries(F.map_filter(labels, lambda _, v: F.coalesce(v, F.lit("")) != "")))


def series_key(labels: Column) -> Column:
    """Text identity of a label set: ``k=v;`` in key order, empty values removed."""
    return F.array_join(
        F.transform(canonical_labels(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), ""
    )


def linkage_key(tenant, user) -> Column:
    """Pseudonym of a user inside a tenant; blank users have none."""
    return F.when(text_or_empty(user) != "", F.sha2(F.concat_ws(":", as_col(tenant), as_col(user)), 256)).otherwise(
        F.lit("")
    )


def fingerprint(tenant, service) -> Column:
    return F.sha1(F.concat_ws("|", as_col(tenant), as_col(service)))


def keep_span(rate: float, slow_ns: int, trace_id="trace_id", status="status_code", duration="duration_ns") -> Column:
    """Keep errors and slow spans; sample the rest by a hash of the trace so traces stay whole."""
    if rate >= 1:
        return F.lit(True)
    always = (as_col(status) == "error") | (as_col(duration) >= slow_ns)
    if rate <= 0:
        return always
    hashed = F.conv(F.substring(F.sha2(as_col(trace_id), 256), 1, 8), 16, 10).cast("double")
    return always | (hashed / F.lit(4294967295.0) < rate)


def ref_name(ref) -> Column:
    """Branch or tag name of a git ref."""
    stripped = F.regexp_replace(F.regexp_replace(text_or_empty(ref), "^refs/heads/", ""), "^refs/tags/", "")
    return F.when(stripped == "", F.lit("(unknown)")).otherwise(stripped)


# Languages alerts can be rendered in.
LOCALES = ["en", "hi", "bn", "ta", "te", "mr", "gu", "kn", "ml", "pa", "or", "as", "ur"]


def resolve_locale(preference, tenant_default) -> Column:
    """Recipient preference, else tenant default, else English; region suffixes are ignored."""

    def language(column):
        tag = F.split(F.lower(F.trim(text_or_empty(column))), "[-_]")[0]
        return F.when(tag.isin(LOCALES), tag)

    return F.coalesce(language(preference), language(tenant_default), F.lit("en"))
