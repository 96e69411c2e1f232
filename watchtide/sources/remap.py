"""Per-tenant event transforms as lists of steps, folded into column expressions.

A step is a dict: ``{"set": path, "to": expr}``, ``{"del": path}``, ``{"redact": path}``,
``{"rename": path, "to": path}``, ``{"route": table}`` or ``{"if": cond, "then": step}``. A condition is
``(op, path, expr)`` with ``== != < >``, or ``("exists" | "absent", path)``. An expression is a literal,
``Path("a.b")`` or ``Call(name, args...)``. A step that fails on an event leaves it as it was and is noted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import let, settled
from ..functions.fields import build_json, json_entries, json_text, quote_json
from ..schemas import SIGNAL_TABLES

# Step limit, redaction text and the integers a JSON number holds exactly.
MAX_STEPS = 200
REDACTED = "[REDACTED]"
EXACT_INTEGERS = 9.007e15
NULL = "null"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Path:
    text: str

    @property
    def parts(self) -> list[str]:
        return [p for p in self.text.split(".") if p]


@dataclass(frozen=True, init=False)
class Call:
    name: str
    args: tuple

    def __init__(self, name: str, *args):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "args", args)


def _parts(path) -> list[str]:
    return path.parts if isinstance(path, Path) else Path(path).parts


def _entries(token: Column) -> Column:
    return F.coalesce(json_entries(token), F.create_map().cast("map<string,string>"))


def _get(event: Column, parts: list[str]) -> Column:
    """JSON text at a path, NULL when the path does not exist."""
    token = F.try_element_at(event, F.lit(parts[0]))
    for part in parts[1:]:
        token = F.try_element_at(json_entries(token), F.lit(part))
    return token


def _put(event: Column, parts: list[str], token: Column) -> Column:
    head = F.lit(parts[0])
    if len(parts) > 1:
        token = build_json(_put(_entries(F.try_element_at(event, head)), parts[1:], token))
    return F.map_concat(F.map_filter(event, lambda k, _: k != head), F.create_map(head, token))


def _remove(event: Column, parts: list[str]) -> Column:
    if len(parts) == 1:
        return F.map_filter(event, lambda k, _: k != F.lit(parts[0]))
    head = F.lit(parts[0])
    inner = json_entries(F.try_element_at(event, head))
    replaced = F.map_concat(
        F.map_filter(event, lambda k, _: k != head), F.create_map(head, build_json(_remove(inner, parts[1:])))
    )
    return F.when(inner.isNotNull(), replaced).otherwise(event)


def _to_number(token: Column) -> Column:
    text = json_text(token)
    parsed = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(token == "true", 1.0).when(token == "false", 0.0).when(token != NULL, parsed)


def _number_token(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < EXACT_INTEGERS)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _literal(value) -> Column:
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    if isinstance(value, (int, float)):
        return _number_token(F.lit(float(value)))
    return F.lit(NULL) if value is None else quote_json(F.lit(str(value)))


def _eval(expr, event: Column) -> tuple[Column, Column]:
    """``(token, error)``: the value as JSON text and why it could not be computed, if so."""
    no_error = F.lit(None).cast("string")
    if isinstance(expr, Path):
        return F.coalesce(_get(event, expr.parts), F.lit(NULL)), no_error
    if not isinstance(expr, Call):
        return _literal(expr), no_error
    known = ("to_string", "upcase", "downcase", "to_int", "to_float", "concat", "coalesce")
    if expr.name not in known:
        return F.lit(NULL), F.lit(f"unknown function `{expr.name}`")
    if not expr.args and expr.name not in ("concat", "coalesce"):
        return F.lit(NULL), F.lit(f"{expr.name}: missing argument 1")
    values = [_eval(a, event) for a in expr.args]
    if expr.name not in ("concat", "coalesce"):
        values = values[:1]
    errors = F.coalesce(*[e for _, e in values], no_error)
    tokens = [t for t, _ in values]
    if expr.name == "concat":
        return quote_json(F.concat(F.lit(""), *[json_text(t) for t in tokens])), errors
    if expr.name == "coalesce":
        # arguments behind the one that is taken are never looked at
        out, error = F.lit(NULL), no_error
        for token, failed in reversed(values):
            filled = (token != NULL) & (token != '""')
            error = F.when(failed.isNotNull(), failed).when(filled, no_error).otherwise(error)
            out = F.when(filled, token).otherwise(out)
        return out, error
    text = json_text(tokens[0])
    if expr.name == "to_string":
        return quote_json(text), errors
    if expr.name in ("upcase", "downcase"):
        return quote_json(F.upper(text) if expr.name == "upcase" else F.lower(text)), errors
    number = _to_number(tokens[0])
    failed = F.coalesce(errors, F.when(number.isNull(), F.lit(f"{expr.name}: not a number")))
    if expr.name == "to_int":
        number = F.when(number >= 0, F.floor(number).cast("double")).otherwise(F.ceil(number).cast("double"))
    return F.coalesce(_number_token(number), F.lit(NULL)), failed


def _holds(condition, event: Column) -> Column:
    op, path, *rest = condition
    left = _get(event, _parts(path))
    if op in ("exists", "absent"):
        return left.isNotNull() if op == "exists" else left.isNull()
    token, error = _eval(rest[0], event)
    right = F.when(error.isNull(), token).otherwise(NULL)
    if op in ("==", "!="):
        same = F.coalesce(left, F.lit(NULL)) == right
        return same if op == "==" else ~same
    if op not in ("<", ">"):
        raise ValueError(f"unknown condition {op!r}")
    a, b = _to_number(left), _to_number(right)
    return F.coalesce(a < b if op == "<" else a > b, F.lit(False))


def _apply(step: dict, event: Column, route: Column) -> tuple[Column, Column, Column]:
    """``(event, route, error)`` after one step."""
    fine = F.lit(None).cast("string")
    if "if" in step:
        test = _holds(step["if"], event)
        changed, routed, error = _apply(step["then"], event, route)
        return (
            F.when(test, changed).otherwise(event), F.when(test, routed).otherwise(route), F.when(test, error),
        )
    if "route" in step:
        if step["route"] not in SIGNAL_TABLES:
            return event, route, F.lit(f"route: unknown table `{step['route']}`")
        return event, F.lit(step["route"]), fine
    if "set" in step:
        token, error = _eval(step["to"], event)
        return F.when(error.isNull(), _put(event, _parts(step["set"]), token)).otherwise(event), route, error
    if "del" in step:
        return _remove(event, _parts(step["del"])), route, fine
    if "redact" in step:
        parts = _parts(step["redact"])
        return F.when(_get(event, parts).isNotNull(), _put(event, parts, quote_json(F.lit(REDACTED)))).otherwise(event), route, fine
    if "rename" in step:
        source, target = _parts(step["rename"]), _parts(step["to"])
        value = _get(event, source)
        return F.when(value.isNotNull(), _put(_remove(event, source), target, value)).otherwise(event), route, fine
    raise ValueError(f"unknown step {step!r}")


def apply_remap(df: DataFrame, steps: list[dict], column: str = "payload", default_route: str | None = None) -> DataFrame:
    """Events after the steps, with ``route_to``, ``remap_applied`` and ``remap_errors``.

    An event that is no JSON object starts out empty.
    """
    if len(steps) > MAX_STEPS:
        raise ValueError(f"program exceeds {MAX_STEPS} steps")
    start = F.struct(
        _entries(F.col(column)).alias("event"),
        F.lit(default_route).cast("string").alias("route"),
        F.array().cast("array<string>").alias("errors"),
    )

    def run(index: int, state: Column) -> Column:
        # each state is bound once, so the expression grows with the steps and not with their products
        if index == len(steps):
            return F.struct(build_json(state["event"]).alias("event"), state["route"].alias("route"), state["errors"].alias("errors"))
        event, route, error = _apply(steps[index], state["event"], state["route"])
        errors = F.array_compact(F.array_append(state["errors"], error))
        following = F.struct(event.alias("event"), route.alias("route"), errors.alias("errors"))
        return let(following, lambda s: run(index + 1, s))

    out = df.withColumn("_remapped", settled(let(start, lambda s: run(0, s))))
    return out.withColumns({
        column: F.col("_remapped.event"),
        "route_to": F.col("_remapped.route"),
        "remap_errors": F.col("_remapped.errors"),
        "remap_applied": F.lit(len(steps)) - F.size("_remapped.errors"),
    }).drop("_remapped")
