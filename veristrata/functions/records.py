"""JSON and time functions for semi-structured records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose values are fingerprints and no prose.
HASH_KEYS = frozenset({"evidence_sha256", "input_digest", "query_sha256"})


def strict_json(column: Column) -> Column:
    """The value as a VARIANT; null if it is no valid JSON (also duplicate keys, NaN, empty text and text behind the value).

    The parser of VARIANT ignores what follows a value. The text is therefore read as the content of
    an array and of an object field: what closes one of them too early is an error in the other, and
    a second value shows up as a second element.
    """
    items = F.try_parse_json(F.concat(F.lit("["), column, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), column, F.lit("}")))
    single = items.isNotNull() & field.isNotNull() & F.try_variant_get(items, "$[1]", "variant").isNull()
    return F.when(single, F.try_variant_get(field, "$.v", "variant"))


def is_strict_object(column: Column) -> Column:
    """Whether the text is one valid JSON object."""
    return F.coalesce(F.schema_of_variant(strict_json(column)).startswith("OBJECT"), F.lit(False))


LEXEMES = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]')


def texts_in(raw: str) -> Iterator[str]:
    """The texts of valid JSON as they follow one another, without keys and without what stands below a key of HASH_KEYS.

    The text is scanned once for strings and brackets; no value is built but the strings themselves.
    """
    depth, muted, last = 0, None, None
    for lexeme in LEXEMES.findall(raw):
        if lexeme == ":":
            if muted is None and json.loads(last) in HASH_KEYS:
                muted = depth
            last = None
            continue
        if last is not None and muted is None:  # a string that no colon followed is a value
            yield json.loads(last)
        last = None
        if lexeme[0] == '"':
            last = lexeme
        elif lexeme in "[{":
            depth += 1
        else:
            depth -= lexeme in "]}"
            if muted is not None and (depth < muted or lexeme == "," and depth == muted):
                muted = None
    if last is not None:
        yield json.loads(last)


@F.pandas_udf(T.StringType())
def text_of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All strings of a JSON value in file order, one a line, without fingerprints and blanks; null for invalid JSON.

    The order of keys in the file counts, which VARIANT does not keep; hence Arrow batches in Python.
    """

    def one(raw):
        if raw is None:
            return None
        try:
            json.loads(raw)
        except ValueError:
            return None
        return "\n".join(text for found in texts_in(raw) if (text := found.strip()))

    for series in values:
        yield series.map(one)


def canonical_json(column: Column) -> Column:
    """Compact JSON with sorted keys, equal for equal content; null for invalid JSON."""
    return F.to_json(strict_json(column))


def zoned_timestamp(column: Column) -> Column:
    """The instant of an ISO 8601 text that states its zone (``Z`` or an offset); null otherwise."""
    ok = column.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.try_to_timestamp(column))


def date_of_parts(parts: Column) -> Column:
    """``[2024, 3, 5]`` as 2024-03-05, shorter arrays as 2024-03 or 2024; null for null or empty."""
    padded = F.transform(parts, lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0")))
    return F.when(F.size(parts) > 0, F.array_join(padded, "-"))


#: What refused requests are called.
PROBLEMS = {401: "auth_required", 403: "blocked", 404: "not_found", 429: "rate_limited"}


def problem_code(status: Column) -> Column:
    """What an HTTP status means for a source."""
    out = F.when(status.between(200, 299), "ok")
    for code, name in PROBLEMS.items():
        out = out.when(status == code, name)
    return out.when(status.isNull(), "fetch_failed").otherwise("http_error")
