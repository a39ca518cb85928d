"""Strict JSON recovery from free text, with Spark's variant functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "~end-of-text-5f1c~"


def strict_json(text: Column) -> Column:
    """The text if all of it is one JSON value other than null; else null.

    The parser ignores what follows a value, so the text goes into an array with a mark behind it.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))
    whole = (F.try_variant_get(pair, "$[1]", "string") == _MARK) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(whole & ~text.rlike(r"^\s*null\s*$"), text)


def recovered_json(text: Column) -> Column:
    """The first that parses: the text, its widest array of objects, its widest object, a fenced block."""
    fence = F.nullif(F.regexp_extract(text, r"(?s)```json\s*(\[.*?\]|\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(
        strict_json(text),
        strict_json(F.regexp_substr(text, F.lit(r"(?s)\[\s*\{.*\}\s*\]"))),
        strict_json(F.regexp_substr(text, F.lit(r"(?s)\{.*\}"))),
        strict_json(fence),
    )


def truthy(value: Column) -> Column:
    """Whether a variant is present and neither null, empty, zero nor false."""
    kind = F.schema_of_variant(value)
    text = value.try_cast("string")
    full = (
        F.when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double") != 0)
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
    )
    return F.coalesce(full, F.lit(False))
