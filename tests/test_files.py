import csv
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest

from metaframe.operators import projects as P
from metaframe.operators.mapping import import_rows, mapping_of
from metaframe.plans.compiler import flatten
from metaframe.schema import RECORD_SCHEMA, RELATION_SCHEMA, Field, Schema, default_schema
from metaframe.sinks import writers
from metaframe.sources import files
from metaframe.sources import xml as X
from metaframe.streaming.ingest import record_stream, validate_stream

RECORDS = [("r1", "text", {"title": ["A & B <c>"], "author": ["x", "", "y"], "odd": ['"q"']}, "<a>1</a>", 0), ("r2", "speaker", {"title": [""]}, "", 1)]


def project(spark, path, schema):
    records = spark.createDataFrame(RECORDS, RECORD_SCHEMA)
    rel = spark.createDataFrame([("l1", "translation", "r1", "r2", "d", {"k": "v"}, 0)], RELATION_SCHEMA)
    writers.write_project(path, {"project_id": "p", "project_name": "n & m"}, schema, records, rel)
    return records


def test_project_round_trip(spark, tmp_path):
    schema = default_schema("learner")
    path = tmp_path / "p.xml"
    project(spark, path, schema)
    back = X.read_records(spark, f"file://{path}").orderBy("ord").collect()
    assert [(r.record_id, r.record_type, r.fields, r.original_xml) for r in back] == [r[:4] for r in RECORDS]
    rel = X.read_relations(spark, f"file://{path}").first()
    assert (rel.relation_id, rel.source_record, rel.target_record, rel.description, rel.attributes) == ("l1", "r1", "r2", "d", {"k": "v"})
    assert X.load_schema(spark, f"file://{path}").fields == schema.fields
    project(spark, path, schema)
    assert len(list((tmp_path / "backups").iterdir())) == 1


def test_schema_files(spark, tmp_path):
    for _ in range(2):
        writers.save_to_library(default_schema(), tmp_path)
    (tmp_path / "bad.xml").write_text("<x>")
    writers.write_schema(Schema("mine"), tmp_path / "own_schema.xml")
    found = X.schema_library(spark, f"file://{tmp_path}/*.xml")
    assert [(n, kind) for n, _, kind in found] == [("monolingual_default_schema.xml", "monolingual"), ("monolingual_default_schema_2.xml", "monolingual"), ("own_schema.xml", "custom")]


def test_records_xml_parts(spark, tmp_path):
    writers.write_records(spark.createDataFrame(RECORDS, RECORD_SCHEMA), Schema(fields=[Field("author", order=1), Field("title", xml_tag="t", order=2)]), f"file://{tmp_path}/out")
    parts = [ET.parse(p).getroot() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert {p.tag for p in parts} == {"records"} and sum(len(p) for p in parts) == 2
    root = [r for p in parts for r in p]
    assert [(f.get("name"), f.get("xml_tag"), f.text) for f in root[0].findall("field")] == [("author", "author", "x"), ("author", "author", None), ("author", "author", "y"), ("title", "t", "A & B <c>"), ("odd", "odd", '"q"')]
    back = X.read_records(spark, f"file://{tmp_path}/out").orderBy("ord").collect()
    assert [(r.record_id, r.record_type, r.fields, r.original_xml) for r in back] == [r[:4] for r in RECORDS]


def test_csv_and_workbook(spark, tmp_path):
    schema = Schema(fields=[Field("title", order=1), Field("author", order=2)])
    records = spark.createDataFrame(RECORDS, RECORD_SCHEMA)
    writers.write_csv_file(records, schema, tmp_path / "r.csv")
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 3
    assert list(csv.reader(raw.decode("utf-8-sig").splitlines()))[1] == ["r1", "text", "A & B <c>", "x; ; y"]
    writers.write_workbook(records, schema, tmp_path / "r.xlsx")
    headers, rows = files.read_workbook(spark, f"file://{tmp_path}/r.xlsx")
    assert headers == ["record_id", "record_type", "title", "author"]
    got = import_rows(rows, headers, mapping_of(headers, schema)[0], max_rows=5).orderBy("ord").collect()
    assert [r.fields for r in got] == [{"title": ["A & B <c>"], "author": ["x; ; y"]}, {}]
    seen = files.preview(spark, f"file://{tmp_path}/r.xlsx", schema, 1)
    assert seen.rows == [["r1", "text", "A & B <c>", "x; ; y"]] and seen.mapping == {"title": "title", "author": "author"} and seen.unknown == ["record_id", "record_type"]
    writers.write_workbook(records, schema, tmp_path / "s.xlsx")
    both = files.read_workbook(spark, f"file://{tmp_path}/*.xlsx")[1].orderBy("ord").collect()
    assert [r.cells[0] for r in both] == ["r1", "r2", "r1", "r2"] and len({r.ord for r in both}) == 4
    writers.write_workbook(records, Schema(fields=[Field("other")]), tmp_path / "t.xlsx")
    with pytest.raises(ValueError):
        files.read_workbook(spark, f"file://{tmp_path}/*.xlsx")
    assert flatten(records, schema).count() == 2


def test_generic_xml(spark, tmp_path):
    (tmp_path / "g.xml").write_text("<books><book record_id='b1'><head><Title> One </Title></head><author>X</author><author>Y</author><empty/></book><book><none>z</none></book><note>n</note></books>")
    schema = Schema(fields=[Field("title"), Field("author", repeatable=True)])
    got = X.import_xml(spark, f"file://{tmp_path}/g.xml", schema).collect()
    assert [(r.record_id, r.record_type, r.fields) for r in got] == [("b1", "book", {"title": ["One"], "author": ["X", "Y"]})]
    assert got[0].original_xml.startswith("<book record_id")
    assert X.import_xml(spark, f"file://{tmp_path}/g.xml", schema, add_unknown=True).count() == 2 and schema.get("none") is not None


def test_import_holds_no_document(spark, tmp_path):
    """Neither a whole file nor a shuffle of leaves: records stay together, and roots are found where a comment holds tags."""
    (tmp_path / "g.xml").write_text("<!-- <schema> > -->\n<r>" + "".join(f"<b record_id='{i}'><t>{i}</t><u>x</u><t>y</t></b>\n" for i in range(3000)) + "</r>")
    path = f"file://{tmp_path}/g.xml"
    assert [r.root for r in X.roots(spark, path).collect()] == ["r"]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # a reader of whole files fails
    try:
        got = X.import_xml(spark, path, Schema(fields=[Field("t", repeatable=True)]))
        rows = got.orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.record_id, r.fields) for r in rows] == [(str(i), {"t": [str(i), "y"]}) for i in range(3000)]
    plan = X.records_of(X.read_elements(spark, path), {"t": "t"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_records_of_a_document():
    for text, tags in (("<records><record/><x/></records>", ["record"]), ("<records><x/></records>", ["records"]), ("<a><b><record/></b></a>", ["record"]), ("<a><b><c/></b><d/><e><f/></e></a>", ["b", "e"]), ("<a><b/></a>", ["a"])):
        assert [e.tag for e in X.record_elements(ET.fromstring(text))] == tags


def plain_leaves(content):
    """Of a document that is parsed whole."""
    out = []
    for n, e in enumerate(X.record_elements(ET.fromstring(content))):
        leaves = [x for x in e.iter() if x is not e and not len(x) and (x.text or "").strip()]
        out += [("text" if e.tag == "record" else e.tag, e.get("record_id", ""), n, i, x.tag, x.text.strip(), ET.tostring(e, encoding="unicode") if i == 0 else None) for i, x in enumerate(leaves)]
    return out


DOCUMENTS = [
    "<r><b i='1'><t>1</t>x</b> tail <!-- <b> --> more <n>leaf</n><b><t>2</t></b><![CDATA[<b>]]></r>",
    "<r>a<g><record><t>1</t><record record_id='in'><t>2</t></record> in </record> t1 <record><t>3</t></record> t2 </g><g><x>no</x><record a='x > y'><t> &lt; 4 </t></record> t3 <x/> t4 <record/></g> end</r>",
    "<records><record><t>1</t></record>x<other><record><t>no</t></record></other><record record_id='2'><t>2</t><record><u>3</u></record></record></records>",
    "<records><x><t>1</t></x></records>",
    "<r><a>1</a><a>2</a></r>",
    "<r/>",
    "<p:r xmlns:p='u&amp;1' xmlns='v'><g xmlns:q='w'><b xmlns='' xmlns:q='z'><q:t>1</q:t></b><p:b><t>2</t></p:b></g><q:g xmlns:q='y' xmlns=''><b><q:t>3</q:t><t>4</t></b></q:g><g><t>5</t></g></p:r>",
    "<p:r xmlns:p='u' xmlns='v'><g xmlns:q='w' xmlns=''><record xmlns='k'><q:t>1</q:t></record><record><p:t>2</p:t></record><record xmlns:p='m'><p:t>3</p:t></record><record><p:t>4</p:t></record></g></p:r>",
    "<!DOCTYPE r [<!ENTITY e 'one &gt; two'><!ATTLIST b record_id CDATA 'given'>]><r><b><t>&e;</t></b> &e; <b record_id='2'><t>x</t></b></r>",
    "<!DOCTYPE r [<!ENTITY e '<b><t>1</t></b>'>]><r>&e;<b><t>2</t></b>&e;</r>",
    "<?xml version='1.0' encoding='utf-8'?><!-- <x> --><r><中 xmlns:文='字'><文:t>é</文:t></中><b><t>😀</t></b></r>\n<!-- end -->",
    "<r>" + "".join(f"<b record_id='{i}'><t>{i}</t><u>{'y' * (i % 50)}</u></b>\n" for i in range(500)) + "</r>\n",
]


def encoded(text):
    yield text.encode()
    yield b"\xef\xbb\xbf" + text.encode()
    if "encoding" not in text:
        yield text.encode("utf-16")
        if text.isascii():
            yield ("<?xml version='1.0' encoding='iso-8859-1'?>" + text.replace("tail", "t\xe9")).encode("iso-8859-1")


@pytest.mark.parametrize("piece", [1, 40, 4096])
def test_blocks_of_records(monkeypatch, piece):
    """Blocks of any size give the leaves of the whole document."""
    monkeypatch.setattr(X, "PIECE", piece)
    monkeypatch.setattr(X, "READ", 7 * piece)
    for content in (c for d in DOCUMENTS for c in encoded(d)):
        chunks = content.split(b">")
        chunks = chunks if chunks[-1] else chunks[:-1]
        rows = pa.record_batch([pa.array(x) for x in (["p"] * len(chunks), [0] * len(chunks), [len(content)] * len(chunks), chunks)], names=["path", "start", "size", "value"])
        blocks = [pa.record_batch(b.columns, names=b.schema.names) for b in X._blocks(X._pieces(iter([rows])))]
        got = [r for b in X._leaves(iter(blocks)) for r in b.to_pylist()]
        assert [(r["record_type"], r["record_id"], r["record"], r["leaf"], r["tag"], r["text"], r["original_xml"]) for r in got] == plain_leaves(content), content[:300]
        per = [r for b in X._records(iter(blocks)) for r in b.to_pylist()]
        assert [(r["record_id"], r["record"], i, x["tag"], x["text"], None if i else r["original_xml"]) for r in per for i, x in enumerate(r["leaves"])] == [w[1:] for w in plain_leaves(content)]
        assert len(content) < 10_000 or piece == 4096 or sum(map(len, blocks)) > 100


def test_leaves_of_large_documents(spark, tmp_path):
    """Documents in many splits, with paths that need escapes; no block holds more than some records."""
    text = "<r>" + "".join(f"<b record_id='{i}'><t a='>'>{i} &amp; <!-- > --></t><g><u>{'>' * (i % 90)}</u></g></b> " for i in range(20_000)) + "</r>"
    (tmp_path / "a b%+é").mkdir()
    for name in "xy":
        (tmp_path / "a b%+é" / f"{name}.xml").write_text(text)
    (tmp_path / "a b%+é" / "z.xml").write_text("<r><a>1</a></r")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        path = f"file://{tmp_path}/a b%+é"
        got = X.read_leaves(spark, [f"{path}/x.xml", f"{path}/y.xml"]).collect()
        want = plain_leaves(text)
        for name in "xy":
            rows = sorted((r for r in got if r.path.endswith(f"/a b%+é/{name}.xml")), key=lambda r: (r.record, r.leaf))
            assert [(r.record_type, r.record_id, r.record, r.leaf, r.tag, r.text, r.original_xml) for r in rows] == want
        assert len(got) == 2 * len(want)
        assert sorted((r.path[-5:], r.root) for r in X.roots(spark, f"{path}/*.xml").collect()) == [("x.xml", "r"), ("y.xml", "r"), ("z.xml", "r")]
        pieces = X._in_pieces(spark, f"{path}/x.xml")
        assert pieces.selectExpr("max(length(data))").first()[0] < 3 * X.PIECE and pieces.mapInArrow(X._blocks, X._BLOCK).selectExpr("max(length(block))").first()[0] < 3 * X.PIECE
        for broken in (f"{path}/z.xml",):
            with pytest.raises(Exception, match="ParseError|ExpatError"):
                X.read_leaves(spark, broken).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_import_by_root(spark, tmp_path):
    """Files of every kind at once: nothing is doubled, whichever files records lie in, and ids are by the elements."""
    project(spark, tmp_path / "a.xml", Schema(fields=[Field("title"), Field("pages")]))
    writers.write_schema(Schema("more", fields=[Field("kind")]), tmp_path / "b.xml")
    for name in "cde":
        (tmp_path / f"{name}.xml").write_text(f"<!-- <schema> --><books><book record_id='r1'><title>{name}1</title><page_no>4</page_no></book><book><title>{name}2</title><text_id>t</text_id></book></books>")
    empty = spark.createDataFrame([], RECORD_SCHEMA)
    start = P.Project(Schema(fields=[Field("title"), Field("text_id")]), empty, spark.createDataFrame([], RELATION_SCHEMA))
    got = P.import_documents(start, f"file://{tmp_path}/*.xml", add_unknown=True)
    rows = got.records.orderBy("ord").collect()
    assert [r.fields.get("title") for r in rows[2:]] == [["c1"], ["c2"], ["d1"], ["d2"], ["e1"], ["e2"]] and len({r.ord for r in rows}) == 8
    assert [r.record_id for r in rows if not r.record_id.startswith("rec_")] == ["r1", "r2", "r1_2", "r1_3", "r1_4"] and len({r.record_id for r in rows}) == 8
    assert got.schema.ids() == ["text_id", "title", "kind", "page_no", "pages"] or set(got.schema.ids()) == {"title", "text_id", "pages", "kind", "page_no"}
    assert got.relations.count() == 1 and P.with_schema(got, Schema("x")).schema.schema_name == "x"


def test_sources(spark, tmp_path):
    for name, content in (("a.txt", "中文".encode("gb18030")), ("b.html", b"<p>x</p>"), ("c.png", b"\x89PNG"), ("d.exe", b"MZ"), ("e.pdf", b"%PDF"), ("f.md", b"abcdefghij" * 3)):
        (tmp_path / name).write_bytes(content)
    rows = {r.path[-5:]: r for r in files.read_sources(spark, f"file://{tmp_path}/*", limit=20, pdf_reader=lambda c: ["one", " "]).collect()}
    assert rows["a.txt"].text == "中文" and rows[".html"].text == "x" and rows["c.png"].binary_base64 and rows["d.exe"].error
    assert rows["e.pdf"].text == "[PDF page 1]\none" and "truncated" in rows["/f.md"].warning
    bare = {r.path[-5:]: r for r in files.read_sources(spark, f"file://{tmp_path}/[be]*").collect()}
    assert "could not be read" in bare["e.pdf"].error and bare[".html"].text == "x"
    pages = files.fetch_pages(spark.createDataFrame([("http://x",), ("ftp://x",)], "url string"), lambda u: ("text/html; charset=nope", b"<p>hi</p>")).orderBy("url").collect()
    assert pages[1].text == "hi" and pages[0].error


def test_stream(spark, tmp_path):
    spark.createDataFrame(RECORDS, RECORD_SCHEMA).write.json(f"{tmp_path}/in")
    q = validate_stream(record_stream(spark, f"{tmp_path}/in"), Schema(fields=[Field("title", required=True)]), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").where("level = 'error'").count() == 1
