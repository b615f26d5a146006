"""Checks of one value, and coercion of one value, by a field's type. A value is a text; the result a message or null."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from metaframe.functions.text import collapse, strip
from metaframe.schema import Field

# Full-match patterns and word lists by type.
INTEGER = r"[+-]?\p{Nd}+(?:_\p{Nd}+)*"
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
FLOAT = rf"[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))"
YEAR = r"\p{Nd}{4}"
LANGUAGE = "[a-zA-Z]{2,3}(?:-[a-zA-Z]{2,4})?"
DATE_SHAPES = {r"\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d", r"\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d", r"\d{4}\.\d{1,2}\.\d{1,2}": "yyyy.M.d", r"\d{4}-\d{1,2}": "yyyy-M", r"\d{4}/\d{1,2}": "yyyy/M"}
BOOLEANS = ("true", "false", "1", "0", "yes", "no", "是", "否")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "是", "对", "有"), ("false", "0", "no", "n", "否", "不", "无")
ALIASES = {
    "中文": "zh", "汉语": "zh", "英语": "en", "英文": "en", "日语": "ja", "日文": "ja", "德语": "de", "法语": "fr", "西班牙语": "es", "俄语": "ru",
    "chinese": "zh", "english": "en", "japanese": "ja", "german": "de", "french": "fr", "spanish": "es", "russian": "ru",
}


def full(c: Column, pattern: str) -> Column:
    """Whether the pattern matches all of the text; a final line feed is not overlooked."""
    return c.rlike(rf"\A(?:{pattern})\z")


def quoted(c: Column) -> Column:
    """A text as Python's repr writes it, for printable characters and the usual escapes."""
    out = c
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def is_date(c: Column) -> Column:
    """A calendar date with one- or two-digit months and days, or a month; years from 1."""
    one = lambda shape, form: full(c, shape) & (F.left(c, F.lit(4)) != "0000") & F.try_to_timestamp(c, F.lit(form)).isNotNull()
    return reduce(lambda a, b: a | b, (one(s, f) for s, f in DATE_SHAPES.items()))


def type_message(field: Field, v: Column) -> Column:
    """What is wrong with a stripped, non-blank value for the field's type."""
    match field.data_type:
        case "integer":
            return F.when(~full(v, INTEGER), F.concat(F.lit("invalid literal for int() with base 10: "), quoted(v)))
        case "float":
            return F.when(~full(v, FLOAT), F.concat(F.lit("could not convert string to float: "), quoted(v)))
        case "year":
            return F.when(~full(v, YEAR), "Year must be in YYYY format.")
        case "date":
            return F.when(~is_date(v), "Date must be YYYY-MM-DD or a close variant.")
        case "boolean":
            return F.when(~F.lower(v).isin(*BOOLEANS), "Boolean must be true/false, yes/no, 1/0, 是/否.")
        case "enum" if field.controlled_values:
            return F.when(~v.isin(*field.controlled_values), F.concat(F.lit("Value not in controlled vocabulary: "), v))
        case "language_code":
            return F.when(~full(v, LANGUAGE), "Language code should look like zh, en, zh-CN, etc.")
    return F.lit(None).cast("string")


#: Rules of these parts mean the same in Python and Java: literals, classes, quantifiers, groups and alternation.
_PORTABLE = re.compile(r"(?:[A-Za-z0-9 _,:;/@#%&=!<>~\"'-]|\\[d.\-/()\[\]]|\[\^?(?:[A-Za-z0-9 _]|\\d|[A-Za-z0-9]-[A-Za-z0-9]|[.,:/_+-](?=[^\[]*\]))+\]|\(\?:|\((?!\?)|[|)]|[?*+]|\{\d+(?:,\d*)?\}|\.)*")


def rule_message(rule: str, v: Column) -> Column:
    """Whether a validation rule matches all of the value; a rule that is no regular expression has one message for every value."""
    if not rule:
        return F.lit(None).cast("string")
    try:
        compiled = re.compile(rule)
    except re.error as error:
        return F.lit(f"Invalid validation regex: {error}")
    failed = F.lit(f"Regex validation failed: {rule}")
    if rule.isascii() and _PORTABLE.fullmatch(rule):
        return F.when(~full(v, rule.replace(r"\d", r"\p{Nd}")), failed)

    @F.pandas_udf(BooleanType())
    def matches(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x is not None and compiled.fullmatch(x) is not None)

    return F.when(~matches(v), failed)


def value_message(field: Field, value: Column) -> Column:
    """The first of a type's and a rule's message; a blank value has none. The rule is asked only if the type is right."""
    v = strip(value)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(F.coalesce(type_message(field, v), rule_message(field.validation_rule, v)))


def coerced(field: Field, value: Column) -> Column:
    """A struct of the canonical value ("" if there is none) and a warning ("" if there is none)."""
    v = strip(F.coalesce(value, F.lit("")))
    found: Column
    what = field.data_type
    match what:
        case "boolean":
            found = F.when(F.lower(v).isin(*TRUE_WORDS), "true").when(F.lower(v).isin(*FALSE_WORDS), "false").otherwise("")
            kind = "invalid boolean value"
        case "integer" | "float":
            found = F.regexp_extract(F.replace(v, F.lit(","), F.lit("")), r"-?\p{Nd}+" if what == "integer" else r"-?\p{Nd}+(?:\.\p{Nd}+)?", 0)
            kind = f"invalid {what} value"
        case "year":
            found = F.regexp_extract(v, r"(?:18|19|20|21)\p{Nd}{2}", 0)
            kind = "invalid year value"
        case "date":
            shape = r"((?:18|19|20|21)\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
            part = lambda i, n: F.lpad(F.regexp_extract(v, shape, i), n, "0")
            found = F.when(F.regexp_extract(v, shape, 0) == "", "").otherwise(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)))
            kind = "invalid date value"
        case "enum" if field.controlled_values:
            low = {x.lower(): x for x in field.controlled_values}
            by_case = F.create_map(*(F.lit(x) for kv in low.items() for x in kv))[F.lower(v)]
            found = F.when(v.isin(*field.controlled_values), v).otherwise(F.coalesce(by_case, F.lit("")))
            kind = "value outside controlled vocabulary"
        case "language_code":
            names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
            code = F.coalesce(names[v], names[F.lower(v)], v)
            found = F.when(full(code, LANGUAGE), code).otherwise("")
            v = code
            kind = "invalid language code"
        case _:
            return F.struct(collapse(v).alias("value"), F.lit("").alias("warning"))
    warning = F.when((v != "") & (found == ""), F.concat(F.lit(f"Discarded {kind}: "), v)).otherwise("")
    return F.struct(F.when(v == "", "").otherwise(found).alias("value"), warning.alias("warning"))
