"""Coercion, time, ratios and model text: Column functions, and one Arrow UDF where a state machine is needed."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicons import PAIR_LABELS


def clip(value: Column, low: float = -365.0, high: float = 365.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clamp01(value: Column, default: float = 0.0) -> Column:
    return clip(F.coalesce(value.try_cast("double"), F.lit(default)), 0.0, 1.0)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return precision, recall, safe_div(2 * precision * recall, precision + recall)


def days_since_epoch(value: Column) -> Column:
    """Fractional UTC days of a number of days, an ISO date or time, a year and month, or a year; null otherwise. Needs a UTC session."""
    text = F.regexp_replace(F.trim(value.cast("string")), "/", "-")
    number = F.when(~text.rlike(r"^\d{4}$"), text.try_cast("double"))
    time = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    month = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-1")).try_cast("timestamp"))
    year = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-1-1")).try_cast("timestamp"))
    return F.coalesce(number, F.unix_micros(F.coalesce(time, month, year)) / F.lit(86_400_000_000.0))


def label(value: Column) -> Column:
    return F.when(value.isin(PAIR_LABELS), value).otherwise("none")


STEP = re.compile(r'\\.|["{}]', re.S)


def _balanced(text: str | None) -> dict | None:
    """The object that opens at the first brace and ends where its braces balance (strings and escapes apart); None if there is none or it is no JSON."""
    start = (text or "").find("{")
    depth, quoted = 0, False
    for m in STEP.finditer(text, start) if start >= 0 else ():
        if m[0] == '"':
            quoted = not quoted
        elif not quoted and m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return _object(text[start : m.end()])
    return None


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _written(value: dict | None) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """First balanced object in free text; null if it does not parse, whatever follows."""
    return text.map(lambda t: _written(_balanced(t)))


@F.pandas_udf(T.StringType())
def json_answer(text: pd.Series) -> pd.Series:
    """The object that a whole text, else a fenced block of it, else its first balanced object is; null if none parses."""

    def read(t: str | None) -> str | None:
        t = (t or "").strip()
        for part in [t, *re.findall(r"(?is)```(?:json)?\s*(\{.*?\})\s*```", t)]:
            if (value := _object(part)) is not None:
                return _written(value)
        return _written(_balanced(t))

    return text.map(read)


@F.pandas_udf(T.StringType())
def outer_json(text: pd.Series) -> pd.Series:
    """The object that a whole text, or all from its first brace to its last, is."""

    def read(t: str | None) -> str | None:
        t = (t or "").strip()
        low, high = t.find("{"), t.rfind("}")
        value = _object(t)
        return _written(value if value is not None or low < 0 or high <= low else _object(t[low : high + 1]))

    return text.map(read)


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(text: pd.Series) -> pd.Series:
    """A written list of values as strings; anything else is empty."""

    def read(t: str | None) -> list[str]:
        value = _literal(t)
        return [str(x) for x in value] if isinstance(value, list) else []

    return text.map(read)


def _literal(text: str | None) -> object:
    try:
        return ast.literal_eval(text) if text else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def literal_map(text: pd.Series) -> pd.Series:
    """A written map to lists of strings: single values are wrapped, keys whose value is None go; anything else is empty."""

    def read(t: str | None) -> dict[str, list[str]]:
        value = _literal(t)
        pairs = value.items() if isinstance(value, dict) else ()
        return {str(k): [str(x) for x in v] if isinstance(v, list) else [str(v)] for k, v in pairs if v is not None}

    return text.map(read)


def tagged(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>; null without them."""
    return F.nullif(F.regexp_extract(text, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))


def tagged_json(text: Column, tag: str) -> Column:
    return first_json_object(tagged(text, tag))


# Loose JSON as variants: fields under several names, values where lists are wanted. JSON's null counts as absent.


def field(value: Column, *names: str) -> Column:
    """The value of the first of the fields that is there; null otherwise."""
    some = [F.try_variant_get(value, f"$.{n}", "variant") for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in some])


def words(value: Column) -> Column:
    """A variant as trimmed text; null is empty."""
    return F.coalesce(F.trim(F.try_variant_get(value, "$", "string")), F.lit(""))


def listed(value: Column) -> Column:
    """A variant as an array of variants: one that is no array is its only element; null and "" give none."""
    alone = F.when(value.isNull() | (words(value) == ""), F.array().cast("array<variant>")).otherwise(F.array(value))
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), alone)


def texts(value: Column) -> Column:
    """listed() as texts that are not empty."""
    return F.filter(F.transform(listed(value), words), lambda x: x != "")


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_true(value: Column) -> Column:
    """Whether a variant is something: not null, false, zero, "" or empty."""
    return F.coalesce(~F.coalesce(F.to_json(value), F.lit("null")).rlike(r'^(null|false|-?0+(\.0+)?|""|\[\]|\{\})$'), F.lit(False))


def pair_payload(text: Column) -> Column:
    """(relation_type, score) of a pair classifier's answer; null without a known relation."""
    got = F.from_json(first_json_object(text), "relation_type string, score string")
    relation = F.lower(F.trim(got["relation_type"]))
    return F.when(relation.isin(PAIR_LABELS), F.struct(relation.alias("relation_type"), F.round(clamp01(got["score"]), 4).alias("score")))
