"""Queries of the metadata operators over the test tables, and DuckDB SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaframe.functions import text as T
from metaframe.functions.checks import coerced, value_message
from metaframe.operators import extraction, ids, mapping, projects, records, relations
from metaframe.plans.compiler import coerce_values, flatten, typed, unknown_fields, validate_records
from metaframe.schema import CORPUS_TYPES, RECORD_SCHEMA, RELATION_SCHEMA, Field, Schema, default_schema
from metaframe.scratch import fresh_path
from metaframe.sinks import writers
from metaframe.sources import files
from metaframe.sources.xml import read_leaves, read_records, read_relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


GENRES = [f"src{i}" for i in range(15)]
SCHEMA = Schema(
    "document_schema",
    fields=[
        Field("title", required=True, order=1),
        Field("language", data_type="language_code", required=True, order=2),
        Field("genre", data_type="enum", controlled_values=tuple(GENRES), order=3),
        Field("character_count", data_type="integer", validation_rule=r"\d{1,4}", order=4),
        Field("quality", data_type="integer", required=True, order=5),
        Field("toxic", data_type="boolean", validation_rule="0|1", order=6),
        Field("keyword", order=7),
        Field("speaker", repeatable=True, order=8),
    ],
)


def document_records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents with their labels as records, and more of their columns; keyword is repeated in some, and mood is unknown to the schema."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    entries = F.array(
        pair("title", F.array(F.split_part("text", F.lit("\n"), F.lit(1)))),
        pair("language", F.array("lang")),
        pair("genre", F.array("source")),
        pair("character_count", F.array(_text("n_chars"))),
        pair("quality", F.when(F.col("quality").isNotNull(), F.array(_text("quality")))),
        pair("toxic", F.when(F.col("toxic").isNotNull(), F.array(_text("toxic")))),
        pair("keyword", F.when(F.col("doc_id") % 7 == 0, F.array("lang", F.lit(" "), "source")).when(F.col("doc_id") % 7 == 1, F.array("lang"))),
        pair("mood", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("fair")))),
    )
    fields = F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull()))
    return docs.select(F.concat(F.lit("doc_"), _text("doc_id")).alias("record_id"), F.lit("text").alias("record_type"), fields.alias("fields"), F.lit("").alias("original_xml"), F.col("doc_id").alias("ord"), *more)


_GENRE_LIST = ", ".join(f"'{g}'" for g in GENRES)
_MESSAGES = f"""
WITH d AS (SELECT 'doc_' || doc_id AS item, doc_id, split_part(text, chr(10), 1) AS title, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
messages AS (
  SELECT 'error' AS level, item, 'Required field is empty: title' AS message FROM d WHERE NOT regexp_matches(title, '[^\\s]')
  UNION ALL SELECT 'error', item, 'language: Language code should look like zh, en, zh-CN, etc.' FROM d WHERE NOT regexp_full_match(lang, '[a-zA-Z]{{2,3}}(-[a-zA-Z]{{2,4}})?')
  UNION ALL SELECT 'error', item, 'genre: Value not in controlled vocabulary: ' || source FROM d WHERE source NOT IN ({_GENRE_LIST})
  UNION ALL SELECT 'error', item, 'character_count: Regex validation failed: \\d{{1,4}}' FROM d WHERE NOT regexp_full_match(n_chars::VARCHAR, '[0-9]{{1,4}}')
  UNION ALL SELECT 'error', item, 'Required field is empty: quality' FROM d WHERE quality IS NULL
  UNION ALL SELECT 'error', item, 'toxic: Regex validation failed: 0|1' FROM d WHERE toxic NOT IN (0, 1)
  UNION ALL SELECT 'error', item, 'Field is not repeatable: keyword' FROM d WHERE doc_id % 7 = 0
  UNION ALL SELECT 'warning', item, 'Unknown field not defined in schema: mood' FROM d WHERE doc_id % 5 = 0
)
"""


@query(_MESSAGES + "SELECT level, item, message FROM messages")
def validate_record_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_records(document_records(spark, sf_dir), SCHEMA).drop("ord")


@query(_MESSAGES + "SELECT level, split_part(message, ':', 1) AS kind, count(*) AS n FROM messages GROUP BY 1, 2")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate_records(document_records(spark, sf_dir), SCHEMA)
    return found.groupBy("level", F.split_part("message", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT 'doc_' || doc_id AS record_id, 'mood' AS field FROM documents WHERE doc_id % 5 = 0")
def unknown_record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_records(spark, sf_dir).select("record_id", F.explode(unknown_fields(SCHEMA)).alias("field"))


# One value of each row for a type: well-formed and malformed ones, the same expression in Spark and DuckDB SQL.
_VALUES = {
    "integer": ("part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN '+' || CAST(p_size AS STRING) WHEN 2 THEN CAST(p_size AS STRING) || '.5' WHEN 3 THEN '1_' || CAST(p_size AS STRING) WHEN 4 THEN ' -' || CAST(p_size AS STRING) || ' ' ELSE CAST(p_size AS STRING) || 'kg, 1,200' END"),
    "float": ("part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN '.' || CAST(p_size AS STRING) WHEN 2 THEN CAST(p_size AS STRING) || '.5e3' WHEN 3 THEN CAST(p_size AS STRING) || 'd' WHEN 4 THEN 'nan' ELSE CAST(p_size AS STRING) || '.25 USD' END"),
    "year": ("orders", "o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) WHEN 1 THEN 'in ' || CAST(year(o_orderdate) AS STRING) ELSE CAST(o_orderkey AS STRING) END"),
    "date": ("orders", "o_orderkey", "CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) WHEN 2 THEN CAST(year(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING) WHEN 3 THEN CAST(year(o_orderdate) AS STRING) || '-02-30' WHEN 4 THEN o_orderstatus ELSE 'on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 00:00:00' END"),
    "boolean": ("lineitem", "l_orderkey", "CASE l_linenumber WHEN 1 THEN 'YES' WHEN 2 THEN 'n' WHEN 3 THEN '0' WHEN 4 THEN ' true ' WHEN 5 THEN '是' ELSE l_returnflag END"),
    "enum": ("part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type ELSE p_brand END"),
    "language_code": ("documents", "doc_id", "CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN lang || '-XX' WHEN 2 THEN 'English' WHEN 3 THEN '德语' ELSE source END"),
}
_TYPES = ("ECONOMY", "PROMO", "STANDARD")
_PIECES = {
    "integer": ("NOT regexp_full_match(v, '[+-]?[0-9]+(_[0-9]+)*')", "'invalid literal for int() with base 10: ''' || v || ''''", "regexp_extract(replace(v, ',', ''), '-?[0-9]+')", "invalid integer value"),
    "float": ("NOT regexp_full_match(v, '[+-]?(([0-9]+(_[0-9]+)*\\.?([0-9]+(_[0-9]+)*)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?|(?i:inf|infinity|nan))')", "'could not convert string to float: ''' || v || ''''", "regexp_extract(replace(v, ',', ''), '-?[0-9]+(\\.[0-9]+)?')", "invalid float value"),
    "year": ("NOT regexp_full_match(v, '[0-9]{4}')", "'Year must be in YYYY format.'", "regexp_extract(v, '(18|19|20|21)[0-9]{2}')", "invalid year value"),
    "date": (
        "NOT coalesce(regexp_full_match(v, '[0-9]{4}(-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2}|\\.[0-9]{1,2}\\.[0-9]{1,2}|-[0-9]{1,2}|/[0-9]{1,2})') AND coalesce(try_strptime(v, ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%Y-%m', '%Y/%m'])) IS NOT NULL, false)",
        "'Date must be YYYY-MM-DD or a close variant.'",
        "CASE WHEN regexp_matches(v, '(18|19|20|21)[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}') THEN regexp_extract(v, '((18|19|20|21)[0-9]{2})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})', 1) || '-' || lpad(regexp_extract(v, '((18|19|20|21)[0-9]{2})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})', 3), 2, '0') || '-' || lpad(regexp_extract(v, '((18|19|20|21)[0-9]{2})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})', 4), 2, '0') ELSE '' END",
        "invalid date value",
    ),
    "boolean": ("lower(v) NOT IN ('true', 'false', '1', '0', 'yes', 'no', '是', '否')", "'Boolean must be true/false, yes/no, 1/0, 是/否.'", "CASE WHEN lower(v) IN ('true', '1', 'yes', 'y', '是', '对', '有') THEN 'true' WHEN lower(v) IN ('false', '0', 'no', 'n', '否', '不', '无') THEN 'false' ELSE '' END", "invalid boolean value"),
    "enum": (f"v NOT IN {_TYPES}", "'Value not in controlled vocabulary: ' || v", f"CASE WHEN upper(v) IN {_TYPES} THEN upper(v) ELSE '' END", "value outside controlled vocabulary"),
    "language_code": ("NOT regexp_full_match(v, '[a-zA-Z]{2,3}(-[a-zA-Z]{2,4})?')", "'Language code should look like zh, en, zh-CN, etc.'", "CASE WHEN v = 'English' THEN 'en' WHEN v = '德语' THEN 'de' WHEN regexp_full_match(v, '[a-zA-Z]{2,3}(-[a-zA-Z]{2,4})?') THEN v ELSE '' END", "invalid language code"),
}


def _value_query(kind: str) -> tuple[Query, Query]:
    table, key, value = _VALUES[kind]
    f = Field("f", data_type=kind, controlled_values=_TYPES if kind == "enum" else ())

    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table).select(F.col(key).alias("k"), F.expr(value).alias("raw"))
        return rows.select("k", value_message(f, F.col("raw")).alias("message")).where("message is not null")

    def coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table).select(F.col(key).alias("k"), F.expr(value).alias("raw"))
        return rows.select("k", coerced(f, F.col("raw")).alias("c")).select("k", "c.value", "c.warning")

    return check, coerce


for _kind, (_bad, _message, _found, _said) in _PIECES.items():
    _source = f"SELECT {_VALUES[_kind][1]} AS k, trim({_VALUES[_kind][2]}) AS v FROM {_VALUES[_kind][0]}".replace("AS STRING", "AS VARCHAR")
    _check, _coerce = _value_query(_kind)
    query(f"SELECT k, {_message} AS message FROM ({_source}) WHERE {_bad}", f"validate_type_{_kind}")(_check)
    query(f"SELECT k, x AS value, CASE WHEN x = '' THEN 'Discarded {_said}: ' || v ELSE '' END AS warning FROM (SELECT k, v, {_found} AS x FROM ({_source}))", f"coerce_{_kind}")(_coerce)


@query("SELECT c_custkey AS k, 'Regex validation failed: Customer#0*[1-4]\\d*' AS message FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#0*[1-4][0-9]*')")
def validate_regex_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Field("f", validation_rule=r"Customer#0*[1-4]\d*")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), value_message(f, F.col("c_name")).alias("message")).where("message is not null")


@query("SELECT c_custkey AS k, 'Regex validation failed: (?P<a>Customer)#\\d+(?<=[02468])' AS message FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]')")
def validate_python_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose syntax only Python has runs there, in Arrow batches."""
    f = Field("f", validation_rule=r"(?P<a>Customer)#\d+(?<=[02468])")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), value_message(f, F.col("c_name")).alias("message")).where("message is not null")


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    fields = F.create_map(F.lit("speaker"), F.transform("ts", lambda t: t.role), F.lit("opening"), F.transform(F.filter("ts", lambda t: t.turn == 0), lambda t: t.text))
    return grouped.select(F.concat(F.lit("conv_"), _text("conv_id")).alias("record_id"), F.lit("text").alias("record_type"), fields.alias("fields"), F.lit("").alias("original_xml"), F.col("conv_id").alias("ord"))


@query("SELECT 'error' AS level, 'conv_' || conv_id AS item, 'Field is not repeatable: speaker' AS message FROM conversations GROUP BY conv_id HAVING count(*) FILTER (trim(role) <> '') > 1")
def validate_repeatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_records(conversation_records(spark, sf_dir), Schema(fields=[Field("speaker"), Field("opening", repeatable=True)])).drop("ord")


@query("SELECT 'conv_' || conv_id AS record_id, 'text' AS record_type, string_agg(role, '; ' ORDER BY turn, role, text) AS speaker, coalesce(string_agg(text, '; ' ORDER BY role, text) FILTER (turn = 0), '') AS opening, '' AS absent FROM conversations GROUP BY conv_id")
def flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(conversation_records(spark, sf_dir), Schema(fields=[Field("speaker", order=1), Field("opening", order=2), Field("absent", order=3)]))


@query("SELECT 'doc_' || doc_id AS record_id, n_chars::INT AS character_count, toxic = 1 AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def typed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(document_records(spark, sf_dir), SCHEMA).select("record_id", F.col("character_count").cast("int").alias("character_count"), "toxic")


@query("SELECT record_id, ord FROM (SELECT 'order_' || l_orderkey AS record_id, l_linenumber * 100000000 + l_partkey AS ord, min(l_linenumber * 100000000 + l_partkey) OVER (PARTITION BY l_orderkey) AS first FROM lineitem) WHERE ord > first")
def duplicate_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order_"), _text("l_orderkey")).alias("record_id"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("ord"))
    return ids.repeated(rows, "record_id")


_BAD_FIELDS = [("title", "title", "string", "text", ["x"]), ("", "", "string", "text", []), ("title", "heading", "string", "text", []), ("year", "title", "number", "page", []), ("kind", "kind", "enum", "text", [])]


@query(
    """SELECT * FROM (VALUES ('error', 'schema', 'Field ID is empty.'), ('error', 'title', 'Duplicate field_id.'), ('error', '', 'XML tag is empty.'), ('warning', 'year', 'Duplicate XML tag.'),
    ('error', 'year', 'Unsupported data type: number'), ('warning', 'year', 'Unknown level: page'), ('warning', 'kind', 'Enum field has no controlled values.')) t(level, item, message)"""
)
def schema_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(_BAD_FIELDS)]
    return records.schema_messages(spark.createDataFrame(rows, "pos int, field_id string, xml_tag string, data_type string, level string, controlled_values array<string>"))


def order_records(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.concat(F.lit("order_"), _text("o_orderkey")).alias("record_id"))


def line_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat_ws("_", F.lit("rel"), _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey")).alias("relation_id"), F.lit("contains").alias("relation_type"), F.concat(F.lit("order_"), _text("l_orderkey")).alias("source_record"),
        F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("order_"), _text("l_partkey"))).alias("target_record"),
    )


_LINES = "SELECT 'rel_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS relation_id, 'order_' || l_orderkey AS source_record, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'order_' || l_partkey END AS target_record FROM lineitem"
_FILLED = "SELECT 'order_' || o_orderkey AS record_id FROM orders WHERE o_orderstatus = 'F'"
_DANGLING = f"""
SELECT 'warning' AS level, relation_id AS item, 'Unknown source record: ' || source_record AS message FROM ({_LINES}) WHERE source_record NOT IN ({_FILLED})
UNION ALL SELECT 'warning', relation_id, 'Unknown target record: ' || target_record FROM ({_LINES}) WHERE target_record <> '' AND target_record NOT IN ({_FILLED})
"""


@query(_DANGLING)
def dangling_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.dangling(line_relations(spark, sf_dir), order_records(spark, sf_dir, "F"))


@query(f"SELECT relation_id, source_record, target_record FROM ({_LINES}) WHERE source_record NOT IN ({_FILLED}) AND target_record NOT IN ({_FILLED})")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _table(spark, sf_dir, "orders").select(F.concat(F.lit("order_"), _text("o_orderkey")).alias("record_id"))
    return relations.cascade_delete(every, line_relations(spark, sf_dir), order_records(spark, sf_dir, "F"))[1].drop("relation_type")


@query(
    _MESSAGES
    + """SELECT level, item, message FROM messages
    UNION ALL SELECT 'warning', 'near_' || doc_id, 'Unknown target record: doc_' || (doc_id + 500) FROM documents WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents)"""
)
def project_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_records(spark, sf_dir)
    links = _table(spark, sf_dir, "documents").select(F.concat(F.lit("near_"), _text("doc_id")).alias("relation_id"), F.concat(F.lit("doc_"), _text("doc_id")).alias("source_record"), F.concat(F.lit("doc_"), (F.col("doc_id") + 500).cast("string")).alias("target_record"))
    return records.validate_project(own, links, SCHEMA)


@query("SELECT 'fields' AS item, 8::BIGINT AS n UNION ALL SELECT 'records', count(*) FROM documents UNION ALL SELECT 'relations', count(*) FROM lineitem")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_count(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "lineitem"), SCHEMA)


@query("SELECT 'c_custkey' AS \"column\", least(greatest(greatest(max(length(c_custkey::VARCHAR)), 9) + 2, 10), 40)::BIGINT AS width FROM customer UNION ALL SELECT 'c_name', least(greatest(greatest(max(length(c_name)), 6) + 2, 10), 40)::BIGINT FROM customer UNION ALL SELECT 'c_mktsegment', least(greatest(greatest(max(length(c_mktsegment)), 12) + 2, 10), 40)::BIGINT FROM customer")
def export_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.column_widths(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


_HEADERS = ["Title", " publication year ", "作者", "Word  Count", "Publisher", "page", "", "Notes!", "GENRE"]
_BOUND = {"Title": "title", " publication year ": "publication_year", "作者": "author", "Word  Count": "word_count", "Publisher": "publisher", "page": None, "Notes!": "notes", "GENRE": "genre"}
_BOUND_SQL = ", ".join(f"('{h}', {'NULL' if f is None else repr(f)})" for h, f in _BOUND.items())


@query(f"SELECT * FROM (VALUES {_BOUND_SQL}) t(header, field_id)")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.suggest_mapping(spark.createDataFrame([(h,) for h in _HEADERS], "header string"), default_schema())


@query("SELECT 'page' AS header")
def unknown_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.unknown_headers(spark.createDataFrame([(h,) for h in _HEADERS], "header string"), default_schema())


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(v)), '\\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), ''), 'field')"


@query(f"SELECT k, {_SLUG} AS slug FROM (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name || ' & ' || p_type ELSE p_brand || '__' || p_name END AS v FROM part UNION ALL SELECT doc_id, text FROM documents)")
def slugify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name || ' & ' || p_type ELSE p_brand || '__' || p_name END").alias("v"))
    return part.unionByName(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("v"))).select("k", T.slugify(F.col("v")).alias("slug"))


_HTML = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', chr(1), 'g'), '(?si)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<svg[^>]*>.*?</svg>', chr(1), 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</?(p|div|section|article|li|tr|h1|h2|h3)(\s[^>]*)?>|<br(\s[^>]*)?/?>', chr(1) || chr(10) || chr(1), 'g'), '</?[a-zA-Z][^>]*>', chr(1), 'g') AS x FROM a),
c AS (SELECT page_id, list_transform(string_split(x, chr(1)), lambda s: CASE WHEN s = chr(10) THEN s WHEN regexp_matches(s, '[^\s]') THEN trim(s, ' ' || chr(10) || chr(9) || chr(13)) || ' ' ELSE '' END) AS l FROM b),
d AS (SELECT page_id, array_to_string(l, '') AS x FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM d),
f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM e)
SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM f
"""


@query(_HTML)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) <= 201 THEN text ELSE left(text, 100) || chr(10) || chr(10) || '[...TRUNCATED...]' || chr(10) || chr(10) || right(text, 101) END AS text FROM documents")
def truncate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 201).alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN -1 ELSE (props->>'k')::BIGINT END AS k, CASE event_id % 4 WHEN 3 THEN 'The model response does not contain a JSON object.' END AS error FROM events")
def parse_json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Here it is: ' || props || ' as asked.' WHEN 2 THEN '```json\n' || props || '\n```' ELSE 'none {' || event_type END")
    rows = _table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return rows.select("event_id", F.coalesce(F.get_json_object(T.json_object(F.col("answer")), "$.k").try_cast("long"), F.lit(-1)).alias("k"), T.json_object_error(F.col("answer")).alias("error"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type ELSE event_type || chr(10) || 'more' END AS text FROM events")
def unwrap_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("output_text")))).otherwise(F.format_string('{"output": [{"content": [{"type": "output_text", "text": "%s"}, {"text": "more"}]}, {}]}', "event_type"))
    return _table(spark, sf_dir, "events").select("event_id", T.response_text(body).alias("text"))


@query("SELECT event_id, least(1, greatest(0, CASE event_id % 3 WHEN 0 THEN value / 10 WHEN 1 THEN -value ELSE 0 END)) AS confidence FROM events")
def clamp_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("event_id") % 3 == 0, (F.col("value") / 10).cast("string")).when(F.col("event_id") % 3 == 1, (-F.col("value")).cast("string")).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", T.confidence(given).alias("confidence"))


@query("SELECT event_id, event_type IN ('y', 'yes', 'true', '1') OR event_id % 5 IN (1, 2) AS flag FROM events")
def parse_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN ' Yes ' WHEN 2 THEN '真' WHEN 3 THEN NULL ELSE 'on' END")
    return _table(spark, sf_dir, "events").select("event_id", T.parse_bool(given).alias("flag"))


@query("SELECT conv_id, list_aggregate(list_filter(list_transform(string_split(replace(string_agg(role, ' ; ' ORDER BY turn, role, text), chr(10), ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '|') AS items FROM conversations GROUP BY conv_id")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_records(spark, sf_dir).select(F.col("ord").alias("conv_id"), F.array_join(F.col("fields")["speaker"], " ; ").alias("v"))
    return rows.select("conv_id", F.array_join(T.as_list(F.col("v")), "|").alias("items"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, CASE turn % 3 WHEN 0 THEN turn || ' of ' || role WHEN 1 THEN role ELSE ' ' END AS v FROM conversations)
    SELECT conv_id, coalesce(string_agg(regexp_extract(v, '-?[0-9]+'), '|' ORDER BY turn, role, text) FILTER (regexp_matches(v, '[0-9]')), '') AS items,
    coalesce((SELECT string_agg('Discarded invalid integer value: ' || role, '; ' ORDER BY first) FROM (SELECT role, min(turn) AS first FROM t u WHERE u.conv_id = t.conv_id AND u.turn % 3 = 1 GROUP BY role)), '') AS warning
    FROM t GROUP BY conv_id"""
)
def coerce_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumn("v", F.expr("CASE turn % 3 WHEN 0 THEN turn || ' of ' || role WHEN 1 THEN role ELSE ' ' END"))
    given = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "v"))), lambda t: t.v).alias("vs"))
    done = given.select("conv_id", coerce_values(Field("f", data_type="integer", repeatable=True), F.col("vs")).alias("c"))
    return done.select("conv_id", F.array_join("c.values", "|").alias("items"), "c.warning")


@query(
    """SELECT 'doc_' || doc_id AS record_id, coalesce(quality::VARCHAR, (doc_id % 2)::VARCHAR) AS quality, lang AS language, (quality IS NULL)::BIGINT AS n_applied FROM documents LEFT JOIN labels USING (doc_id)"""
)
def apply_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_records(spark, sf_dir)
    answer = F.format_string('Sure: {"record_id": "x", "fields": {"quality": {"value": "about %s", "confidence": 7}, "language": "xx", "odd": 1}, "overall_confidence": 0.5}', (F.col("ord") % 2).cast("string"))
    found = extraction.normalize(own.select("record_id", answer.alias("answer")), SCHEMA)
    out = extraction.apply_extraction(own, found, SCHEMA)
    return out.select("record_id", F.col("fields")["quality"][0].alias("quality"), F.col("fields")["language"][0].alias("language"), "n_applied")


@query(
    """SELECT 'doc_' || doc_id AS record_id, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 END::DOUBLE AS confidence, CASE doc_id % 4 WHEN 0 THEN '3' WHEN 1 THEN doc_id::VARCHAR END AS quality,
    CASE doc_id % 4 WHEN 0 THEN 'Ignored non-schema field returned by model: odd' WHEN 1 THEN 'w; quality: Multiple values returned for a non-repeatable field; kept the first non-empty value.' WHEN 2 THEN 'Model output did not contain a valid fields object.' ELSE '' END AS warnings,
    CASE doc_id % 4 WHEN 3 THEN 'The model response does not contain a JSON object.' END AS error FROM documents"""
)
def normalize_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four kinds: parts and a value that cannot be coerced (which goes with its warning), lists, no fields object, no JSON."""
    docs = document_records(spark, sf_dir)
    n = F.col("ord").cast("string")
    answer = (
        F.when(F.col("ord") % 4 == 0, F.lit('{"fields": {"quality": {"value": 3, "confidence": 7}, "character_count": "many", "odd": 1}}'))
        .when(F.col("ord") % 4 == 1, F.concat(F.lit('{"fields": {"quality": {"value": [" ", "'), n, F.lit('"], "confidence": "0.25"}}, "warnings": ["w", " "]} as asked')))
        .when(F.col("ord") % 4 == 2, F.lit('{"fields": [1]}')).otherwise(F.lit("none {"))
    )
    found = extraction.normalize(docs.select("record_id", answer.alias("answer")), SCHEMA)
    return found.select("record_id", F.col("confidences")["quality"].alias("confidence"), F.col("fields")["quality"][0].alias("quality"), F.array_join("warnings", "; ").alias("warnings"), "error")


@query("SELECT * FROM (VALUES ('title', 1), ('publication_year', 2), ('corpus_id', 3), ('corpus_name', 4), ('corpus_type', 5), ('text_id', 6), ('author', 7)) t(field_id, pos)")
def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Schema(fields=[Field("title", order=1), Field("publication_year", order=2)])
    own.merge(Schema(fields=default_schema().fields[:6]))
    return spark.createDataFrame([(f.field_id, i) for i, f in enumerate(own.fields, 1)], "field_id string, pos int")


@query("SELECT * FROM (VALUES ('b', 1), ('c', 2), ('a', 3), ('d', 4)) t(field_id, \"order\")")
def schema_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Schema(fields=[Field("d", order=9), Field("a", order=4), Field("c", order=2), Field("b", order=2)])
    own.reindex()
    return own.frame(spark).select("field_id", "order")


@query("SELECT c_custkey AS ord, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || '_' || n END AS record_id FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("record_id"), F.col("c_custkey").alias("ord"))
    return ids.unique_ids(rows)


@query("SELECT 'order_' || o_orderkey || CASE WHEN o_orderkey % 20 = 0 THEN '_copy_2' ELSE '_copy' END AS record_id, 1000000000 + o_orderkey AS ord FROM orders")
def copy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.lit("order_"), _text("o_orderkey")).alias("record_id"), F.col("o_orderkey").alias("ord"))
    had = orders.unionByName(orders.where("ord % 20 = 0").select(F.concat("record_id", F.lit("_copy")).alias("record_id"), (F.col("ord") + 500000000).alias("ord")))
    return ids.copies(had, orders, 1_000_000_000)


_CASES = " ".join(f"WHEN contains(v, '{t}') THEN '{t}'" for t in CORPUS_TYPES)


@query(f"SELECT p_partkey, CASE {_CASES} ELSE 'custom' END AS corpus_type FROM (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'My_Spoken_' || p_type WHEN 1 THEN 'comparable and LEARNER' WHEN 2 THEN 'bilingual_parallel' ELSE p_brand END) AS v FROM part)")
def infer_corpus_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'My_Spoken_' || p_type WHEN 1 THEN 'comparable and LEARNER' WHEN 2 THEN 'bilingual_parallel' ELSE p_brand END")
    return _table(spark, sf_dir, "part").select("p_partkey", T.corpus_type(F.col("p_name"), stem, CORPUS_TYPES).alias("corpus_type"))


@query("SELECT DISTINCT lower(tag) AS tag FROM pages, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t(tag)")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower))
    return _table(spark, sf_dir, "pages").select(F.explode(tags).alias("tag")).distinct()


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS uri FROM pages")
def base64_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.replace(T.data_uri(F.lit("text/html"), F.col("html").cast("binary")), F.lit("\r\n"), F.lit("")).alias("uri"))


@query("SELECT page_id, ['image', 'pdf', 'html', 'text', NULL][page_id % 5 + 1] AS kind, ['image/png', 'application/pdf', 'text/html', 'text/csv', 'application/octet-stream'][page_id % 5 + 1] AS mime FROM pages")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in.d/x"), _text("page_id"), F.element_at(F.array(*map(F.lit, [".PNG", ".pdf", ".htm", ".csv", ".exe"])), (F.col("page_id") % 5 + 1).cast("int")))
    return _table(spark, sf_dir, "pages").select("page_id", T.source_kind(path).alias("kind"), T.mime_type(path).alias("mime"))


@query("SELECT 'doc_' || doc_id AS record_id, coalesce(toxic::VARCHAR, '0') AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = extraction.fill_missing(document_records(spark, sf_dir), "toxic", F.lit("0"))
    return filled.select("record_id", F.col("fields")["toxic"][0].alias("toxic"))


@query("SELECT p_partkey AS ord, p_name AS title, p_size::VARCHAR AS word_count FROM part WHERE p_partkey % 3 <> 0")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet to records: two columns of one field, of which the later filled one counts, and blank rows."""
    blank = F.col("p_partkey") % 3 == 0
    cells = F.array(F.when(~blank, F.lit("old")), F.when(~blank, F.col("p_name")), F.when(blank, " ").otherwise(_text("p_size")))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), cells.alias("cells"))
    headers = ["Title", "title", "Word Count"]
    done = mapping.import_rows(rows, headers, mapping.mapping_of(headers, default_schema())[0])
    return done.select("ord", F.col("fields")["title"][0].alias("title"), F.col("fields")["word_count"][0].alias("word_count"))


_FIELDS = """
WITH d AS (SELECT 'doc_' || doc_id AS record_id, doc_id, split_part(text, chr(10), 1) AS title, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
f AS (
  SELECT record_id, 'title' AS field, title AS value FROM d
  UNION ALL SELECT record_id, 'language', lang FROM d
  UNION ALL SELECT record_id, 'genre', source FROM d
  UNION ALL SELECT record_id, 'character_count', n_chars::VARCHAR FROM d
  UNION ALL SELECT record_id, 'quality', quality::VARCHAR FROM d WHERE quality IS NOT NULL
  UNION ALL SELECT record_id, 'toxic', toxic::VARCHAR FROM d WHERE toxic IS NOT NULL
  UNION ALL SELECT record_id, 'keyword', CASE doc_id % 7 WHEN 0 THEN lang || ';  ; ' || source ELSE lang END FROM d WHERE doc_id % 7 < 2
  UNION ALL SELECT record_id, 'mood', 'fair' FROM d WHERE doc_id % 5 = 0)
"""


@query(_FIELDS + "SELECT record_id, field || ': ' || value AS line FROM f")
def record_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.details(document_records(spark, sf_dir))


@query(_FIELDS + "SELECT record_id, 'text' AS record_type, field, value FROM f")
def flatten_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    from metaframe.plans.compiler import flatten_any as run

    return run(document_records(spark, sf_dir))


@query(
    """WITH had AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
    SELECT 'cust_x' || k AS record_id, k AS ord FROM had UNION ALL SELECT 'cust_x' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '_2' ELSE '' END, c_custkey + 1 + (SELECT max(k) FROM had) FROM customer"""
)
def append_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("cust_x"), _text("c_custkey")).alias("record_id"), F.col("c_custkey").alias("ord"))
    return projects.append_import(rows.where("ord % 2 = 0"), rows, derive=None)


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'pasted' END AS source FROM pages")
def preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("page_id") % 3
    return _table(spark, sf_dir, "pages").select("page_id", projects.preferred_source(F.when(at == 0, F.col("url")).otherwise(" "), F.lit(None).cast("string"), F.when(at < 2, "pasted")).alias("source"))


@query(
    """SELECT 'doc_' || doc_id AS record_id, 'test' AS project, 'document_schema' AS schema_name, 8::BIGINT AS n_fields, lang AS language,
    CASE WHEN length(text) <= 60000 THEN text ELSE left(text, 30000) || chr(10) || chr(10) || '[...TRUNCATED...]' || chr(10) || chr(10) || right(text, 30000) END AS source FROM documents"""
)
def prompt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the whole document, read back from their JSON."""
    docs = document_records(spark, sf_dir, "text")
    prompted = extraction.prompts(docs, SCHEMA, {"project_name": "test", "corpus_type": "custom"}, T.truncate(F.col("text"), 60_000))
    shape = "project struct<project_name:string>, schema struct<schema_name:string, fields:array<struct<field_id:string>>>, record struct<record_id:string, fields:map<string,array<string>>>, source struct<text:string>"
    p = prompted.select("record_id", F.from_json("prompt", shape).alias("p"))
    return p.select("record_id", F.col("p.project.project_name").alias("project"), "p.schema.schema_name", F.size("p.schema.fields").cast("long").alias("n_fields"), F.col("p.record.fields")["language"][0].alias("language"), F.col("p.source.text").alias("source"))


@query("SELECT doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN lang || doc_id WHEN 1 THEN source ELSE 'generated' END AS record_id FROM documents")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the field record_id, else text_id, else generated ones, which differ from each other."""
    docs = _table(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("record_id"), F.array(F.concat("lang", _text("doc_id"))), F.lit("text_id"), F.array("source"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("text_id"), F.array("source"))).otherwise(F.create_map(F.lit("title"), F.array("source")))
    made = ids.derive_ids(docs.select(F.lit("").alias("record_id"), own.alias("fields"), F.col("doc_id").alias("ord")))
    return made.select("ord", F.when(F.col("record_id").rlike("^rec_[0-9a-f]{10}$"), "generated").otherwise(F.col("record_id")).alias("record_id"))


# Sinks and sources: what is written to the shared folder is read back.

PARTS = Schema("parts", fields=[Field("name", xml_tag="n", order=1), Field("size", data_type="integer", order=2), Field("label", repeatable=True, order=3)])


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    fields = F.create_map(F.lit("name"), F.array(F.concat(F.lit("<"), "p_name", F.lit(' & "'), "p_brand", F.lit('">'))), F.lit("size"), F.array(_text("p_size")), F.lit("label"), F.array("p_type", F.lit(""), "p_brand"))
    return rows.select(F.concat(F.lit("part_"), _text("p_partkey")).alias("record_id"), F.lit("text").alias("record_type"), fields.alias("fields"), F.when(F.col("p_partkey") % 2 == 0, "<a>1 &amp; 2</a>").otherwise("").alias("original_xml"), F.col("p_partkey").alias("ord"))


_PARTS = """SELECT 'part_' || p_partkey AS record_id, 'text' AS record_type, '<' || p_name || ' & "' || p_brand || '">' AS name, p_size::VARCHAR AS size, p_type || '; ; ' || p_brand AS label{} FROM part"""


@query(_PARTS.format(", CASE p_partkey % 2 WHEN 0 THEN '<a>1 &amp; 2</a>' ELSE '' END AS original_xml"))
def roundtrip_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records-xml")
    writers.write_records(part_records(spark, sf_dir), PARTS, path)
    back = read_records(spark, path)
    return flatten(back.select("record_id", "record_type", F.map_concat("fields", F.create_map(F.lit("original_xml"), F.array("original_xml"))).alias("fields")), Schema(fields=[*PARTS.fields, Field("original_xml", order=4)]))


@query(_PARTS.format(""))
def roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "records-csv")
    writers.write_csv(part_records(spark, sf_dir), PARTS, path)
    return spark.read.option("header", True).option("escape", '"').schema("record_id string, record_type string, name string, size string, label string").csv(path)


def customer_documents(spark: SparkSession, sf_dir: str) -> str:
    """Generic XML documents with nested elements: each is a part of the customers."""
    path = fresh_path(spark, "customers-xml")
    rows = _table(spark, sf_dir, "customer")
    about = F.struct(F.col("c_mktsegment").alias("Segment"), F.array("c_name", F.lit("  "), F.concat(F.lit(" no. "), _text("c_custkey"))).alias("name"))
    rows.select(F.concat(F.lit("c"), _text("c_custkey")).alias("_record_id"), about.alias("about"), _text("c_nationkey").alias("nation")).write.format("xml").option("rootTag", "customers").option("rowTag", "customer").save(path)
    return path


@query(
    """SELECT 'c' || c_custkey AS record_id, 'customer' AS record_type, x.tag AS tag, x.text AS text FROM customer,
    unnest([{'tag': 'Segment', 'text': c_mktsegment}, {'tag': 'name', 'text': c_name}, {'tag': 'name', 'text': 'no. ' || c_custkey}, {'tag': 'nation', 'text': c_nationkey::VARCHAR}]) AS t(x)"""
)
def xml_leaf_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_leaves(spark, customer_documents(spark, sf_dir)).select("record_id", "record_type", "tag", "text")


@query(
    """SELECT 'c' || c_custkey AS record_id, 'customer' AS record_type, c_mktsegment AS segment, c_name || '; no. ' || c_custkey AS label, c_nationkey::VARCHAR AS nation FROM customer"""
)
def import_generic_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents imported into an empty project: tags bound by id, tag and label, an unknown one added, ids by the elements."""
    schema = Schema(fields=[Field("segment", order=1), Field("label", xml_tag="NAME", repeatable=True, order=2)])
    empty = spark.createDataFrame([], RECORD_SCHEMA), spark.createDataFrame([], RELATION_SCHEMA)
    done = projects.import_documents(projects.Project(schema, *empty), customer_documents(spark, sf_dir), add_unknown=True)
    return flatten(done.records, done.schema)


@query("SELECT n_nationkey, n_name || chr(10) AS text, 'text' AS source_kind, 'text/plain' AS mime_type FROM nation")
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation, read as sources."""
    path = fresh_path(spark, "texts")
    _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(1).write.partitionBy("n_nationkey").text(path)
    rows = files.read_sources(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "text", "source_kind", "mime_type")


@query("SELECT 'nation_' || n_nationkey AS record_id, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def roundtrip_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of records, imported again by its headers."""
    path = fresh_path(spark, "book") + ".xlsx"
    rows = _table(spark, sf_dir, "nation")
    own = rows.select(F.concat(F.lit("nation_"), _text("n_nationkey")).alias("record_id"), F.lit("text").alias("record_type"), F.create_map(F.lit("name"), F.array("n_name"), F.lit("region"), F.array(_text("n_regionkey"))).alias("fields"), F.col("n_nationkey").cast("long").alias("ord"))
    schema = Schema(fields=[Field("record_id", order=1), Field("name", order=2), Field("region", order=3)])
    writers.write_workbook(own.withColumn("fields", records.set_value(F.col("fields"), "record_id", F.array("record_id"))), schema, writers.local_path(path))
    seen = files.preview(spark, path, schema)
    _, cells = files.read_workbook(spark, path)
    return flatten(ids.derive_ids(mapping.import_rows(cells, seen.headers, seen.mapping)), schema).drop("record_type")


@query(
    """SELECT 's' || s_suppkey AS record_id, s_name AS name, 's' || s_suppkey AS source_record, 'n' || s_nationkey AS target_record, 'in & of' AS note FROM supplier"""
)
def roundtrip_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project of suppliers and their relations to nations, as one file."""
    path = fresh_path(spark, "project") + ".xml"
    rows = _table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("s"), _text("s_suppkey"))
    own = rows.select(key.alias("record_id"), F.lit("text").alias("record_type"), F.create_map(F.lit("name"), F.array("s_name")).alias("fields"), F.lit("").alias("original_xml"), F.col("s_suppkey").alias("ord"))
    links = rows.select(F.concat(F.lit("l"), key).alias("relation_id"), F.lit("located").alias("relation_type"), key.alias("source_record"), F.concat(F.lit("n"), _text("s_nationkey")).alias("target_record"), F.lit("").alias("description"), F.create_map(F.lit("note"), F.lit("in & of")).alias("attributes"), F.col("s_suppkey").alias("ord"))
    writers.write_project(writers.local_path(path), {"project_id": "p", "project_name": "suppliers"}, Schema(fields=[Field("name")]), own, links)
    back, ends = read_records(spark, path), read_relations(spark, path)
    return back.join(ends, F.col("record_id") == F.col("source_record")).select("record_id", F.col("fields")["name"][0].alias("name"), "source_record", "target_record", F.col("attributes")["note"].alias("note"))
