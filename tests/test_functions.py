import re

import pytest
from pyspark.sql import functions as F

from metaframe.functions import text as T
from metaframe.functions.checks import coerced, value_message
from metaframe.schema import Field, slug

VALID = {
    "integer": (["5", "+5", "-0", "1_000", "99999999999999999999", "٣", " 7 "], ["5.0", "abc", "1__0", "_1"]),
    "float": (["1e5", "nan", "inf", "Infinity", "1_0.5", ".5", "5.", "-INF"], ["1d", "1f", "0x1p3", ".", "1e"]),
    "year": (["2024", "２０２４", "٢٠٢٤"], ["24", "20245", "2024\n5"]),
    "date": (["2024-01-05", "2024-1-5", "2024/1/5", "2024.01.05", "2024-7", "2024/07", "0001-01-01"], ["2024-02-30", "2024-13", "2024.07", "24-01-05", "2024-011-5", "2024-01-05 00:00:00"]),
    "boolean": (["true", "FALSE", "1", "0", "yes", "No", "是", "否"], ["y", "真", "对", "t"]),
    "language_code": (["zh", "eng", "zh-CN"], ["zh-Hant-TW", "es-419", "english", "z"]),
    "file_path": (["a/b", "//"], []),
    "string": (["x"], []),
}


def told(spark, field, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.m for r in rows.select("i", value_message(field, F.col("v")).alias("m")).orderBy("i").collect()]


@pytest.mark.parametrize("kind", VALID)
def test_types(spark, kind):
    good, bad = VALID[kind]
    found = told(spark, Field("f", data_type=kind), good + bad)
    assert found[: len(good)] == [None] * len(good)
    assert all(found[len(good) :])


def test_messages_of_numbers_are_those_of_python(spark):
    values = ["x", "it's", "a'b\"c", "back\\slash", "5.0"]
    for kind, cast in (("integer", int), ("float", float)):
        bad = [v for v in values if kind == "integer" or v != "5.0"]
        expected = []
        for v in bad:
            with pytest.raises(ValueError) as e:
                cast(v)
            expected.append(str(e.value))
        assert told(spark, Field("f", data_type=kind), bad) == expected


@pytest.mark.parametrize("rule", [r"\d{4}", "a|b", "[a-c]+x?", r"(?P<n>a)b", r"a(?=b)b", "(?:ab)*"])
def test_rules_match_as_python_does(spark, rule):
    values = ["2024", "a", "b", "ab", "abab", "abcx", "2024 "]
    found = told(spark, Field("f", validation_rule=rule), values)
    assert found == [None if re.fullmatch(rule, v.strip()) else f"Regex validation failed: {rule}" for v in values]


def test_a_bad_rule_is_a_message_and_blank_values_have_none(spark):
    assert told(spark, Field("f", validation_rule="("), ["x", " ", ""]) == ["Invalid validation regex: missing ), unterminated subpattern at position 0", None, None]


COERCED = {
    "integer": {"1,234 kg": "1234", "3.7": "3", "none": "", "-5": "-5"},
    "float": {"1,234.50 m": "1234.50", "x": ""},
    "year": {"in 1999!": "1999", "1499": ""},
    "date": {"发表于2024年1月5日": "2024-01-05", "2024-13-45": "2024-13-45", "2024/7/1": "2024-07-01", "soon": ""},
    "boolean": {"Y": "true", "有": "true", "无": "false", "maybe": ""},
    "language_code": {"英语": "en", "English": "en", "zh-CN": "zh-CN", "klingon": ""},
    "string": {" a \n b ": "a b"},
}


@pytest.mark.parametrize("kind", COERCED)
def test_coercion(spark, kind):
    rows = spark.createDataFrame(list(COERCED[kind].items()), "v string, expected string")
    for r in rows.select("v", "expected", coerced(Field("f", data_type=kind), F.col("v")).alias("c")).collect():
        assert r.c.value == r.expected
        assert bool(r.c.warning) == (r.expected == "")


def test_enum_coercion(spark):
    f = Field("f", data_type="enum", controlled_values=("Fiction", "news"))
    rows = spark.createDataFrame([("fiction",), ("news",), ("NEWS",), ("x",), (None,)], "v string").select(coerced(f, F.col("v")).alias("c"))
    assert [tuple(r.c) for r in rows.collect()] == [("Fiction", ""), ("news", ""), ("news", ""), ("", "Discarded value outside controlled vocabulary: x"), ("", "")]


def test_slug_is_the_same_on_columns_and_driver(spark):
    values = [" Publication  Year ", "作者", "A--b__c!", "", "_x_", "É tude", "a　b", "\x1cx\x1f"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", T.slugify(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [slug(v) for v in values]
    assert [r.s for r in rows][:3] == ["publication_year", "field", "a--b_c"]


def test_strip_is_that_of_python(spark):
    values = ["\t a \x1f", "　b\xa0", "\x85c ", " ", "d"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", T.strip(F.col("v")).alias("s")).orderBy("i")
    assert [r.s for r in rows.collect()] == [v.strip() for v in values]


def test_visible_text():
    assert T.visible_text("Hello <b>wor</b>ld!") == "Hello wor ld!"
    assert T.visible_text("a&amp;lt;b") == "a<b"
    assert T.visible_text("<p>one</p><script>x</script><p>two<br>three</p>") == "one \n\ntwo \nthree"
    assert T.visible_text(None) == ""


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.truncate(F.lit("abcdefghij"), 4)) == "ab" + T.MARKER + "ij"
    assert get(T.as_list(F.lit("a; b\n;c "))) == ["a", "b", "c"]
    assert get(T.confidence(F.lit("7"))) == 1.0 and get(T.confidence(F.lit("x"))) == 0.0 and get(T.confidence(F.lit("nan"))) == 1.0
    assert get(T.json_object(F.lit('so {"a": {"b": 1}} yes'))) == '{"a": {"b": 1}}'
    assert get(T.json_object_error(F.lit(" "))) == "The model returned an empty response."
    assert get(T.charset(F.lit("text/html; Charset=gbk; x"))) == "gbk"
    assert get(T.decode(F.lit("中文".encode("gb18030")))) == "中文"
    assert get(T.decode(F.lit(b"\xef\xbb\xbfa"))) == "﻿a"
    assert get(T.parse_bool(F.lit(" 是 "))) is True and get(T.parse_bool(F.lit(None).cast("string"), True)) is True
