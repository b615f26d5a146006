import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metaframe.operators import extraction, ids, mapping, records, relations
from metaframe.plans.compiler import coerce_values, flatten, validate_records
from metaframe.schema import CORPUS_TYPES, RECORD_SCHEMA, RELATION_SCHEMA, Field, Schema, default_schema, from_headers


def rows_of(spark, *rows):
    return spark.createDataFrame([(rid, "text", fields, "", i) for i, (rid, fields) in enumerate(rows)], RECORD_SCHEMA)


def test_bundled_schemas():
    sizes = dict(zip(CORPUS_TYPES, (16, 28, 30, 30, 22, 26, 27), strict=True))
    for kind, n in sizes.items():
        made = default_schema(kind)
        assert len(made.fields) == n and made.get("corpus_type").example == kind
        assert {f.field_id for f in made.fields if f.required} == {"corpus_id", "corpus_name", "corpus_type", "text_id", "title"}
    assert default_schema("learner").get("target_language").level == "speaker"


def test_schema_edits():
    s = Schema(fields=[Field("b", order=2), Field("a", order=2), Field("c", order=1)])
    assert s.ids() == ["c", "a", "b"]
    s.move("a", -1)
    assert s.ids() == ["a", "c", "b"]
    s.move("a", -1)
    assert s.ids() == ["a", "c", "b"]
    s.edit("c", Field("d", order=9))
    assert s.ids() == ["a", "b", "d"]
    with pytest.raises(ValueError):
        s.add(Field("a"))
    s.add(Field("e"))
    assert s.get("e").order == 4
    assert from_headers(["作者", "Page No"]).ids() == ["field_1", "page_no"]
    with pytest.raises(ValueError):
        mapping.add_headers(Schema(), ["作者", "标题"], {})


def test_validation_of_one_record(spark):
    s = Schema(fields=[Field("t", required=True), Field("n", data_type="integer", validation_rule=r"\d"), Field("k")])
    found = validate_records(rows_of(spark, ("r", {"t": [" "], "n": ["x", "12", "1"], "zz": [], "aa": ["1"]}), ("ok", {"t": ["x"]}), ("none", None)), s)
    assert sorted(r.message for r in found.where("item = 'r'").collect()) == [
        "Field is not repeatable: n", "Required field is empty: t", "Unknown field not defined in schema: aa", "Unknown field not defined in schema: zz", r"n: Regex validation failed: \d", "n: invalid literal for int() with base 10: 'x'",
    ]
    assert found.where("item = 'ok'").count() == 0
    assert [r.message for r in found.where("item = 'none'").collect()] == ["Required field is empty: t"]


def test_own_rules(spark):
    s = Schema(fields=[Field("n", data_type="integer", repeatable=True)])
    rule = lambda v: F.when(v.cast("long") % 2 == 1, F.concat(v, F.lit(" is odd")))
    found = validate_records(rows_of(spark, ("r", {"n": ["1", " 3 ", "4", "x"]})), s, {"n": rule})
    assert sorted(r.message for r in found.collect()) == ["n: 1 is odd", "n: 3 is odd", "n: invalid literal for int() with base 10: 'x'"]


def test_flatten(spark):
    s = Schema(fields=[Field("author"), Field("record_type", order=5)])
    got = flatten(rows_of(spark, ("r", {"author": ["x", "", "y"], "record_type": ["own"]}), ("s", {"author": [""]})), s).orderBy("record_id").collect()
    assert [tuple(r[c] for c in ("record_id", "author", "record_type")) for r in got] == [("r", "x; ; y", "own"), ("s", "", "")]


def fold(wanted, existing=()):
    taken, out = set(existing), []
    for w in wanted:
        out.append(ids.free_id(w, taken))
        taken.add(out[-1])
    return out


NAMES = st.lists(st.sampled_from(["a", "a_2", "a_3", "a_2_2", "b", "b_2", "", "_2", "c_10"]), min_size=1, max_size=14)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(NAMES, NAMES)
def test_unique_ids_equal_the_sequential_fold(spark, wanted, existing):
    new = rows_of(spark, *((w, {}) for w in wanted))
    old = rows_of(spark, *((w, {}) for w in existing))
    assert [r.record_id for r in ids.unique_ids(new, old).orderBy("ord").collect()] == fold(wanted, existing)


def test_unique_ids_examples(spark):
    for wanted, expected in ((["a", "a_2", "a", "a"], ["a", "a_2", "a_3", "a_4"]), (["a", "a", "a_2"], ["a", "a_2", "a_2_2"])):
        assert [r.record_id for r in ids.unique_ids(rows_of(spark, *((w, {}) for w in wanted))).orderBy("ord").collect()] == expected


def test_unique_ids_steps_over_gaps(spark):
    """Copies of an id of which numbered forms exist, within a row and (beyond GAPS) in order; other records do not change."""
    have = ["a", "a_3", "a_4", "a_7", "a_x", "b_2", "a_03", *[f"c_{i}" for i in range(2, 1500, 2)], "c"]
    new = ["a", "a", "b", "b", "z_17", "z_18", *["a"] * 6, "c", "c", None, "order_1"]
    old = rows_of(spark, *((w, {}) for w in have))
    got = [r.record_id for r in ids.unique_ids(rows_of(spark, *((w, {"k": [str(i)]}) for i, w in enumerate(new))), old).orderBy("ord").collect()]
    assert [x for x in got if x] == fold([w for w in new if w], have) and got[14] is None
    many = [f"d_{i}" for i in range(2, 2500)] + ["d"]
    assert [r.record_id for r in ids.unique_ids(rows_of(spark, ("d", {}), ("d", {"x": ["1"]})), rows_of(spark, *((w, {}) for w in many))).orderBy("ord").collect()] == ["d_2500", "d_2501"]


def test_unique_ids_of_equal_places(spark):
    """Records that share an ord are not doubled."""
    rows = spark.createDataFrame([("a", "text", {}, "", 0), ("a", "text", {}, "", 0), ("b_2", "text", {}, "", 0), ("b", "text", {}, "", 0), ("b", "text", {}, "", 0)], RECORD_SCHEMA)
    assert sorted(r.record_id for r in ids.unique_ids(rows).collect()) in (["a", "a_2", "b", "b_2", "b_3"], ["a", "a_2", "b", "b_2", "b_2_2"])


def test_relations(spark):
    rel = spark.createDataFrame([("r1", "t", "a", "z", "", {}, 0), ("r2", "t", "", "b", "", {}, 1), ("r3", "t", "b", "b", "", {}, 2)], RELATION_SCHEMA)
    have = rows_of(spark, ("a", {}), ("b", {}))
    assert [tuple(r) for r in relations.dangling(rel, have).collect()] == [("warning", "r1", "Unknown target record: z")]
    left, kept = relations.cascade_delete(have, rel, have.where("record_id = 'b'"))
    assert [r.record_id for r in left.collect()] == ["a"] and [r.relation_id for r in kept.collect()] == ["r1"]


def test_mapping_of_headers_and_tags():
    s = Schema(fields=[Field("title", "标题", "Title", "ttl"), Field("late", "标题", "Late")])
    assert mapping.mapping_of([" TITLE ", "标题", "ttl", "", "Page No"], s) == ({" TITLE ": "title", "标题": "late", "ttl": "title"}, ["Page No"])
    found, unknown = mapping.mapping_of(["page", "record"], s, stripped=False)
    mapping.add_tags(s, unknown, found)
    assert found == {"page": "page"} and s.get("page").xml_tag == "page"


def test_extraction(spark):
    s = Schema(fields=[Field("title"), Field("author", repeatable=True), Field("year", data_type="year"), Field("fixed", editable=False)])
    have = rows_of(spark, ("r", {"title": [""], "year": ["1999"]}), ("s", {}))
    answer = '```{"record_type": "x", "fields": {"title": ["", "One ", "Two"], "author": "A; B;;", "year": {"value": "in 2001", "confidence": "0.4"}, "fixed": "no", "bad": 1}, "warnings": ["w", " "]}```'
    answers = spark.createDataFrame([("r", answer), ("s", "nothing")], "record_id string, answer string")
    found = extraction.normalize(answers, s).orderBy("record_id").collect()
    assert found[0].fields == {"title": ["One"], "author": ["A", "B"], "year": ["2001"], "fixed": ["no"]} and found[0].confidences["year"] == 0.4
    assert found[0].warnings[:2] == ["w", "Ignored non-schema field returned by model: bad"] and "kept the first non-empty" in found[0].warnings[2]
    assert found[1].error and found[1].fields == {}
    out = {r.record_id: r for r in extraction.apply_extraction(have, extraction.normalize(answers, s), s).collect()}
    assert out["r"].fields == {"title": ["One"], "author": ["A", "B"], "year": ["1999"]} and out["r"].n_applied == 2 and out["r"].record_type == "text"
    assert out["s"].fields == {} and out["s"].n_applied == 0
    forced = extraction.apply_extraction(have, extraction.normalize(answers, s), s, overwrite=True, selected=["year"]).where("record_id = 'r'").first()
    assert forced.fields["year"] == ["2001"] and forced.record_type == "x" and forced.n_applied == 1


def test_extractor_runs_on_executors(spark):
    s = Schema(fields=[Field("title")])
    asked = extraction.prompts(rows_of(spark, ("r", {"title": ["x"]})), s, {"project_name": "p"}, F.lit("text"))
    got = extraction.ask(asked, lambda prompts: [str("title" in p and "text" in p) for p in prompts]).first()
    assert (got.record_id, got.answer) == ("r", "True")


def test_suggestion_rules():
    s = Schema(fields=[Field("title", xml_tag="t")])
    raw = {"schema_version": " 2 ", "corpus_type": None, "fields": [
        {"label_zh": "页", "label_en": "Page No", "order": "x", "confidence": 3, "required": "是", "visible": 0, "controlled_values": "a\n b;;c", "action": "Replace"},
        {"field_id": "other", "xml_tag": "page_no", "level": "nowhere", "data_type": "enum", "order": 0, "confidence": "high", "action": "drop"},
        {"field_id": "title", "action": "replace"}, {}]}
    got = extraction.suggestion(raw, s, "odd mode", "spoken")
    assert (got.schema_name, got.schema_version, got.corpus_type, got.mode) == ("ai_generated_schema", "2", "spoken", extraction.EXTEND)
    page, other, title, last = (c.field for c in got.candidates)
    assert (page.field_id, page.label_zh, page.label_en, page.order, page.required, page.visible, page.controlled_values) == ("page_no", "页", "Page No", 1, True, False, ("a", "b", "c"))
    assert (other.xml_tag, other.level, other.order, other.label_en) == ("other", "text", 2, "other") and last.field_id == "field_4"
    assert [c.action for c in got.candidates] == ["replace", "add", "replace", "add"] and [c.confidence for c in got.candidates] == [1.0, 0.0, 0.0, 0.0]
    assert got.warnings == ["other: Duplicate suggested xml_tag was replaced with field_id.", "other: Unsupported level 'nowhere' was changed to text.", "other: Enum field has no controlled_values."]
    assert extraction.suggestion({"fields": 3}, s, "x").warnings == ["Model output did not contain a valid fields array."]
    kept, n = extraction.apply_suggestion(s, got, replace_existing=True)
    assert n == 4 and set(kept.ids()) == {"title", "page_no", "other", "field_4"} and kept.get("title").xml_tag == "title" and s.ids() == ["title"]
    assert extraction.apply_suggestion(s, extraction.suggestion({"fields": []}, s, extraction.NEW)) == (s, 0)


def test_schema_suggestion():
    s = Schema(fields=[Field("title", xml_tag="t")])
    raw = {"schema_name": "My Schema", "warnings": [" "], "fields": [{"field_id": "Title"}, {"label_en": "New Field", "xml_tag": "t", "data_type": "odd", "level": "x"}, {"field_id": "kind", "data_type": "enum", "controlled_values": "a; b"}, 3, {"field_id": "kind"}]}
    got = extraction.suggestion(raw, s, "extend_current_schema")
    assert [(c.field.field_id, c.action) for c in got.candidates] == [("title", "skip"), ("new_field", "skip"), ("kind", "add")]
    assert got.candidates[2].field.controlled_values == ("a", "b") and len(got.warnings) == 4
    made, n = extraction.apply_suggestion(s, got)
    assert n == 1 and made.ids() == ["title", "kind"]
    fresh, n = extraction.apply_suggestion(s, extraction.suggestion(raw, s, "generate_new_schema"), ["kind"])
    assert n == 1 and fresh.ids() == ["kind"] and fresh.schema_name == "my_schema"


def test_multivalue_warnings(spark):
    rows = spark.createDataFrame([(["1", "x", "x", " "],), (None,)], "v array<string>")
    f = Field("f", data_type="integer", repeatable=True)
    assert [tuple(r.c) for r in rows.select(coerce_values(f, F.col("v")).alias("c")).collect()] == [(["1"], "Discarded invalid integer value: x"), ([], "")]
    one = spark.createDataFrame([(["1"], True), (["1"], False), (["x"], True)], "v array<string>, l boolean")
    said = [r.c.warning for r in one.select(coerce_values(Field("f", data_type="integer"), F.col("v"), F.col("l")).alias("c")).collect()]
    many = "Multiple values returned for a non-repeatable field; kept the first non-empty value."
    assert said == [many, "", f"{many} Discarded invalid integer value: x"]


def test_form_defaults_and_edits(spark):
    s = Schema(fields=[Field("a", repeatable=True), Field("b", data_type="boolean"), Field("c", default_value="d")])
    form = spark.createDataFrame([("r", "text", "x; ;y", "no", None, 0)], "record_id string, record_type string, a string, b string, c string, ord long")
    assert records.from_form(form, s).first().fields == {"a": ["x", "", "y"], "b": ["false"], "c": [""]}
    have = rows_of(spark, ("r", {"a": ["1"]}))
    assert records.with_defaults(have, s).first().fields == {"a": ["1"], "c": ["d"]}
    assert have.select(records.add_value(F.col("fields"), "a", F.lit("2")).alias("f")).first().f == {"a": ["1", "2"]}


def test_empty_tables(spark):
    none = rows_of(spark, ("r", {})).limit(0)
    rel = spark.createDataFrame([], RELATION_SCHEMA)
    assert ids.unique_ids(none).count() == 0 and records.validate_project(none, rel, default_schema()).count() == 0
