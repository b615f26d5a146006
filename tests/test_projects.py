from pyspark.sql import functions as F

from metaframe.operators import projects as P
from metaframe.schema import RECORD_SCHEMA, RELATION_SCHEMA, Field, Schema
from metaframe.sources.xml import read_leaves


def rows_of(spark, *rows):
    return spark.createDataFrame([(rid, "text", f, "", i) for i, (rid, f) in enumerate(rows)], RECORD_SCHEMA)


def test_append(spark):
    got = P.append_import(rows_of(spark, ("a", {}), ("b", {})), rows_of(spark, ("", {"text_id": ["a"]}), ("", {"record_id": ["c"]}), ("", {}))).orderBy("ord").collect()
    assert [r.record_id for r in got[:4]] == ["a", "b", "a_2", "c"] and got[4].record_id.startswith("rec_") and [r.ord for r in got] == [0, 1, 2, 3, 4]
    assert P.append_import(rows_of(spark, ("a", {})).limit(0), rows_of(spark, ("", {"text_id": ["a"]}))).first().ord == 0


def test_merge(spark):
    rel = lambda *r: spark.createDataFrame([(i, "t", s, t, "", {}, n) for n, (i, s, t) in enumerate(r)], RELATION_SCHEMA)
    for rewrite, end in ((False, "a"), (True, "a_2")):
        schema = Schema(fields=[Field("x")])
        records, relations = P.merge_projects(schema, rows_of(spark, ("a", {})), rel(("r", "a", "")), Schema(fields=[Field("x"), Field("y")]), rows_of(spark, ("a", {}), ("b", {})), rel(("s", "a", "b")), rewrite)
        assert schema.ids() == ["x", "y"] and [r.record_id for r in records.orderBy("ord").collect()] == ["a", "a_2", "b"]
        assert [(r.relation_id, r.source_record, r.target_record) for r in relations.orderBy("ord").collect()] == [("r", "a", ""), ("s", end, "b")]


def test_lookups_previews_and_settings(spark, tmp_path):
    assert P.record_by_id(rows_of(spark, ("a", {"k": ["1"]}), ("a", {})), "a").first().fields == {"k": ["1"]}
    (tmp_path / "x.xml").write_text("<r><b><t>1</t><t>2</t></b><b><u>3</u></b></r>")
    assert [r["values"] for r in P.xml_preview(read_leaves(spark, f"file://{tmp_path}/x.xml")).collect()] == [{"t": "2"}, {"u": "3"}]
    assert spark.range(1).select(P.preferred_source(F.lit(" "), F.lit("p"), F.lit("q")).alias("x")).first().x == "p"
    P.Settings("u", "m", 10).save(tmp_path / "s" / "s.json")
    assert P.Settings.load(tmp_path / "s" / "s.json") == P.Settings("u", "m", 1000) and P.Settings.load(tmp_path / "none") == P.Settings()
