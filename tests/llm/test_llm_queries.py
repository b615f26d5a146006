import collections
import glob
import os
import shutil
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaframe.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_pipeline_equals_a_plain_version(spark, sf):
    """run() against plain versions of all stages; of toxicity, the learned grammar's scores of the texts."""
    import corpus_pipeline
    from metaframe.llm import toxicity
    from metaframe.llm.stages import tokenizer_path
    from plain_versions import contaminated, jaccard_groups, line_removals
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()
    scores = grammar.scores(toxicity.Texts(pa.array([r.text for r in rows])))
    texts = {r.doc_id: r.text for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD}
    for i, lines in line_removals(list(texts.items())).items():
        texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in lines) or None
    texts = {i: t for i, t in texts.items() if t is not None}
    ids = sorted(texts)
    groups = jaccard_groups([texts[i] for i in ids], ids)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if groups[i][1] == i and not contaminated(t, items)[3]}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == set(texts) and len(texts) > 100
    for i, t in texts.items():
        tokens = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for start, length, crc, n in sorted(got[i]):
            assert (start, n, crc) == (at, len(tokens), zlib.crc32(tokens[at : at + length].tobytes()))
            at += length
        assert at == len(tokens)


def test_stages_of_odd_tables(spark, tmp_path, sf):
    """Nulls, empty texts and tables, repeated rows, and columns with clashing and dotted names pass all stages."""
    import corpus_pipeline

    shutil.copytree(sf, tmp_path / "sf")
    rows = [(1, None, "a", 0), (2, "", "b", 0), (None, "no id here", "c", 1), (3, "the same text of some few words", "d", 2), (3, "the same text of some few words", "d", 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, row int").withColumns({c: F.lit(1) for c in ("id", "gone", "score", "n_chars", "_id", "keys")})
    for docs, left in ((odd, {1, 2, 3, None}), (odd.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, f"{tmp_path}/sf")
            assert name == "packing" or docs.columns == before
            assert {r.doc_id for r in docs.collect()} == left


def _workers_of_a_task(df):
    """The Python operators of the last stage of df: those that no exchange parts from its rows."""
    n, below = 0, None
    for line in df._jdf.queryExecution().executedPlan().treeString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if below is not None and depth > below:
            continue
        below = depth if "Exchange" in line.split("(")[0] else None
        n += "MapInArrow" in line
    return n


def test_a_task_of_the_pipeline_has_one_python_worker(spark, sf, monkeypatch):
    """Workers outlive their tasks, so a stage with two of them for a task leaves two for each core to all later ones."""
    import corpus_pipeline

    kind, most = type(spark.range(0)), []
    plain = kind.mapInArrow

    def counted(self, *a, **b):
        out = plain(self, *a, **b)
        most.append(_workers_of_a_task(out))
        return out

    once = plain(spark.range(9), lambda stream: stream, "id long")
    assert _workers_of_a_task(plain(once, lambda stream: stream, "id long")) == 2
    assert _workers_of_a_task(plain(once.repartition(3), lambda stream: stream, "id long")) == 1
    monkeypatch.setattr(kind, "mapInArrow", counted)
    corpus_pipeline.run(spark, sf)
    assert len(most) > 10 and set(most) == {1}


def test_empty_tables(spark, tmp_path, sf):
    """Every query on tables without rows; conversations have the trap alone."""
    import corpus_pipeline

    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"file://{tmp_path}/{os.path.basename(p)}")
    for name, f in (QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert f(spark, f"file://{tmp_path}").count() == (name == "op4_chat_format"), name
