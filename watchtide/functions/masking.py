"""Personal-data detection and masking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basics import as_col, let, text_or_empty
from .fields import quote_json, unquote_json

# Detectors in the order they run.
DETECTORS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "jwt": r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b",
    "card": r"\b(?:\d[ \-]?){13,19}\b",
    "phone": r"\+\d{1,3}[\s\-]?\d{6,12}\b",
}
# The lighter text mask, in order.
BASIC_MASKS = [
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"\b\d{7,}\b", "[NUM]"),
]
ACTIONS = ("mask", "hash", "drop_field", "drop_record")

# The detectors read letters and digits of every script, the basic masks only ASCII. A plain ``\\b``
# differs between Java versions, so both are spelled out.
_ASCII_START, _ASCII_END = r"(?=[0-9])(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def _any_script(pattern: str) -> str:
    return f"(?U){pattern}" if "\\" in pattern.replace("\\-", "").replace("\\.", "") else pattern


def _ascii_only(pattern: str) -> str:
    """The edges of the basic masks all stand next to a digit."""
    if pattern.startswith(r"\b"):
        return _ASCII_START + pattern.removeprefix(r"\b").removesuffix(r"\b") + _ASCII_END
    return pattern


_SPARK_DETECTORS = {kind: _any_script(pattern) for kind, pattern in DETECTORS.items()}


# What a text must hold for a detector or mask to match at all; a cheap look that spares most texts the
# full pattern. Plain fragments, or patterns where they start with "(?".
_HINTS = {
    "email": "@", "jwt": "eyJ", "ipv4": r"(?U)\d\.\d", "ipv6": ":", "card": r"(?U)\d[ \-]?\d", "phone": "+",
}
_BASIC_HINTS = [r"(?i)bearer", "eyJ", "@", r"(?s)[0-9]\.[0-9]", r"(?s)[0-9]{7}"]


# Shortest text a detector can match.
_SHORTEST = {"ipv4": 7, "card": 13}


def _hinted(text: Column, hint: str, shortest: int = 0) -> Column:
    found = text.rlike(hint) if hint.startswith("(?") else F.contains(text, F.lit(hint))
    return (F.length(text) >= shortest) & found if shortest else found


def luhn_ok(text: Column) -> Column:
    """Mod-10 check over the digits of a 13 to 19 digit candidate."""

    def check(digits: Column) -> Column:
        n = F.length(digits)

        def add(total, place):
            digit = F.substring(digits, n - place + 1, F.lit(1)).cast("int")
            doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return total + F.when(place % 2 == 0, doubled).otherwise(digit)

        checksum = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
        return F.when(n.between(13, 19), checksum % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(text, "[^0-9]", ""), check)


def _replacement(kind: str, action: str, match: Column) -> Column:
    if action == "mask":
        return F.lit(f"[redacted:{kind}]")
    if action == "hash":
        return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(match, 256), 1, 12))
    return F.lit("")


def _rewrite_matches(text: Column, pattern: str, replace) -> Column:
    """Replace each match by a function of it: literals between matches, zipped with the matches."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tails = F.slice(pieces, F.lit(2), F.size(matches))
    joined = F.zip_with(matches, tails, lambda m, tail: F.concat(replace(m), tail))
    return F.concat(pieces[0], F.array_join(joined, ""))


def _detect(text: Column, kind: str, action: str) -> Column:
    pattern = _SPARK_DETECTORS[kind]
    if kind == "card":
        rewritten = _rewrite_matches(
            text, pattern, lambda m: F.when(luhn_ok(m), _replacement(kind, action, m)).otherwise(m)
        )
    elif action == "hash":
        rewritten = _rewrite_matches(text, pattern, lambda m: _replacement(kind, action, m))
    else:
        rewritten = F.regexp_replace(text, pattern, f"[redacted:{kind}]" if action == "mask" else "")
    return F.when(_hinted(text, _HINTS[kind], _SHORTEST.get(kind, 0)), rewritten).otherwise(text)


def mask_pii(column, actions: dict[str, str] | None = None) -> Column:
    """Run every detector over a text column.

    Returns ``struct(text, types, drop_record)``: the masked text, the sorted kinds found and
    whether a kind whose action is ``drop_record`` was found. The default action is ``mask``.
    """
    actions = {kind: (actions or {}).get(kind, "mask") for kind in DETECTORS}
    actions = {kind: a if a in ACTIONS else "mask" for kind, a in actions.items()}
    kinds = list(DETECTORS)

    def step(index: int, text: Column, found: list[Column]) -> Column:
        if index == len(kinds):
            hits = F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in zip(kinds, found)]))
            drops = [hit for k, hit in zip(kinds, found) if actions[k] == "drop_record"]
            drop = F.lit(False)
            for hit in drops:
                drop = drop | hit
            return F.struct(
                text.alias("text"), F.array_sort(hits).alias("types"), drop.alias("drop_record")
            )
        kind = kinds[index]
        return let(
            _detect(text, kind, actions[kind]), lambda masked: step(index + 1, masked, [*found, masked != text])
        )

    return let(text_or_empty(column), lambda text: step(0, text, []))


def gate_texts(df: DataFrame, column: str, actions: dict[str, str] | None = None) -> DataFrame:
    """:func:`mask_pii` over every element of an array-of-text column, as one projection per detector.

    Replaces the column and adds ``pii_types`` and ``drop_record``. Shallow steps keep the plan quick to
    build, which a stream pays for on every batch.
    """
    actions = {kind: (actions or {}).get(kind, "mask") for kind in DETECTORS}
    before, found, temporary = column, [], []
    for kind, action in actions.items():
        after = f"_gated_{kind}"
        df = df.withColumn(after, _detect_each(before, kind, action if action in ACTIONS else "mask"))
        found.append((kind, F.col(after) != F.col(before)))
        temporary.append(after)
        before = after
    drop = F.lit(False)
    for kind, hit in found:
        if actions[kind] == "drop_record":
            drop = drop | hit
    types = F.array_sort(F.array_compact(F.array(*[F.when(hit, F.lit(kind)) for kind, hit in found])))
    gated = df.withColumns({"pii_types": types, "drop_record": drop, "_gated": F.col(before)})
    return gated.withColumn(column, F.col("_gated")).drop("_gated", *temporary)


def _detect_each(column: str, kind: str, action: str) -> Column:
    # one look at all texts together spares most rows the looks at each; what it finds across a border does no harm
    hinted = _hinted(F.array_join(column, "\n"), _HINTS[kind], _SHORTEST.get(kind, 0))
    return F.when(hinted, F.transform(F.col(column), lambda text: _detect(text, kind, action))).otherwise(F.col(column))


def json_strings(column) -> Column:
    """The string literals of a JSON text in order, keys with their colon."""
    return F.regexp_extract_all(as_col(column), F.lit(JSON_STRING), F.lit(0))


def is_json_key(token: Column) -> Column:
    return token.endswith(":")


def put_json_strings(column, tokens: Column) -> Column:
    """A JSON text with its string literals replaced one by one."""
    pieces = F.split(as_col(column), JSON_STRING, -1)
    rest = F.zip_with(tokens, F.slice(pieces, F.lit(2), F.size(tokens)), lambda t, p: F.concat(t, p))
    return F.concat(pieces[0], F.array_join(rest, ""))


JSON_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'


def mask_pii_json(column, actions: dict[str, str] | None = None) -> Column:
    """:func:`mask_pii` over every string value of a JSON text; keys stay as they are."""

    def one(token: Column) -> Column:
        plain = F.struct(token.alias("text"), F.array().cast("array<string>").alias("types"), F.lit(False).alias("drop_record"))
        masked = let(
            mask_pii(unquote_json(token), actions),
            lambda m: F.struct(quote_json(m["text"]).alias("text"), m["types"].alias("types"), m["drop_record"].alias("drop_record")),
        )
        return F.when(token.endswith(":") | (F.length(token) < 3), plain).otherwise(masked)

    def rebuild(text: Column) -> Column:
        pieces = F.split(text, JSON_STRING, -1)
        tokens = F.transform(F.regexp_extract_all(text, F.lit(JSON_STRING), F.lit(0)), one)
        return let(
            tokens,
            lambda ts: F.struct(
                F.concat(
                    pieces[0],
                    F.array_join(
                        F.zip_with(ts, F.slice(pieces, F.lit(2), F.size(ts)), lambda t, p: F.concat(t["text"], p)), ""
                    ),
                ).alias("text"),
                F.array_sort(F.array_distinct(F.flatten(F.transform(ts, lambda t: t["types"])))).alias("types"),
                F.exists(ts, lambda t: t["drop_record"]).alias("drop_record"),
            ),
        )

    return let(text_or_empty(column), rebuild)


def mask_text_basic(column) -> Column:
    """Typed placeholders for bearer tokens, JWTs, e-mails, IPv4 addresses and long digit runs."""


    def step(index: int, text: Column) -> Column:
        if index == len(BASIC_MASKS):
            return text
        pattern, placeholder = BASIC_MASKS[index]
        masked = F.when(
            _hinted(text, _BASIC_HINTS[index]), F.regexp_replace(text, _ascii_only(pattern), placeholder)
        ).otherwise(text)
        return let(masked, lambda t: step(index + 1, t))

    return let(as_col(column), lambda t: step(0, t))


# ASCII runs that end a token; other characters belong to it.
TOKEN_BREAK = r"[\x00-\x7F&&[^a-z0-9]]+"


def phrase_tokens(phrase: str) -> list[str]:
    cleaned = "".join(c if c.isascii() and c.isalnum() else " " for c in phrase)
    return [t.lower() for t in cleaned.split()]


def has_all_tokens(column, phrase: str) -> Column:
    """Every alphanumeric token of the phrase occurs as a whole token, ignoring case."""
    tokens = list(dict.fromkeys(phrase_tokens(phrase)))
    if not tokens:
        return F.lit(True)
    text = F.lower(as_col(column))
    # a cheap substring test first, so that most rows never get split
    rough = F.lit(True)
    for token in tokens:
        rough = rough & F.contains(text, F.lit(token))
    exact = let(
        F.split(text, TOKEN_BREAK, -1),
        lambda found: F.forall(F.array(*map(F.lit, tokens)), lambda t: F.array_contains(found, t)),
    )
    return F.when(rough, exact).otherwise(F.lit(False))
