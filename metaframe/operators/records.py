"""Edits, counts and projections of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.functions.text import split_values
from metaframe.operators.ids import repeated
from metaframe.operators.relations import dangling
from metaframe.plans.compiler import flatten, validate_records
from metaframe.schema import Schema


def set_value(fields: Column, field_id: str, new: Column) -> Column:
    """The map with a field's values replaced by an array column; null gives no values, null elements are empty."""
    new = F.transform(F.coalesce(new, F.array().cast("array<string>")), lambda v: F.coalesce(v.cast("string"), F.lit("")))
    return F.map_concat(F.map_filter(fields, lambda k, _: k != field_id), F.create_map(F.lit(field_id), new))


def add_value(fields: Column, field_id: str, value: Column) -> Column:
    return set_value(fields, field_id, F.concat(F.coalesce(fields[F.lit(field_id)], F.array().cast("array<string>")), F.array(value)))


def with_defaults(records: DataFrame, schema: Schema) -> DataFrame:
    """New records: each non-empty default where the record has no such field."""
    fields = F.col("fields")
    for f in schema.sorted():
        if f.default_value:
            fields = F.when(F.map_contains_key(fields, f.field_id), fields).otherwise(F.map_concat(fields, F.create_map(F.lit(f.field_id), F.array(F.lit(f.default_value)))))
    return records.withColumn("fields", fields)


def from_form(rows: DataFrame, schema: Schema) -> DataFrame:
    """Records from a column of text for each field: repeatable ones split at semicolons, blanks kept; booleans always true or false."""

    def value(f) -> Column:  # noqa: ANN001
        c = F.coalesce(F.col(f"`{f.field_id}`").cast("string"), F.lit(""))
        if f.data_type == "boolean":
            return F.array(F.when(F.lower(c).isin("true", "1", "yes", "是"), "true").otherwise("false"))
        return split_values(c, keep_blank=True) if f.repeatable else F.array(c)

    pairs = [x for f in schema.sorted() for x in (F.lit(f.field_id), value(f))]
    return rows.select("record_id", "record_type", F.create_map(*pairs).alias("fields"), F.lit("").alias("original_xml"), "ord")


def record_count(records: DataFrame, relations: DataFrame, schema: Schema) -> DataFrame:
    spark = records.sparkSession
    n = spark.createDataFrame([("fields", len(schema.fields))], "item string, n long")
    return n.unionByName(records.agg(F.count("*").alias("n")).select(F.lit("records").alias("item"), "n")).unionByName(relations.agg(F.count("*").alias("n")).select(F.lit("relations").alias("item"), "n"))


def column_widths(rows: DataFrame, least: int = 10, most: int = 40) -> DataFrame:
    """(column, width): the longest value or header and two more, between `least` and `most`."""
    longest = rows.agg(*(F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).alias(c) for c in rows.columns))
    width = lambda c: F.least(F.greatest(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(len(c))) + 2, F.lit(least)), F.lit(most))
    return longest.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), width(c).cast("long").alias("width")) for c in rows.columns))).alias("x")).select("x.*")


def export_widths(records: DataFrame, schema: Schema) -> DataFrame:
    return column_widths(flatten(records, schema))


def details(records: DataFrame) -> DataFrame:
    """(record_id, line): "field: values" for each field, sorted by name."""
    lines = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e.key, F.lit(": "), F.array_join(e.value, "; "))))
    return records.select("record_id", F.explode(lines).alias("line"))


def schema_messages(fields: DataFrame) -> DataFrame:
    """(level, item, message) of a table of fields with `pos`: empty and repeated ids and tags, types, levels, vocabularies.

    The table may hold what Schema objects never do, such as unknown types.
    """
    from metaframe.schema import DATA_TYPES, LEVELS

    say = lambda df, level, text: df.select(F.lit(level).alias("level"), F.when(F.lit(text) == "Field ID is empty.", "schema").otherwise(F.col("field_id")).alias("item"), (text if isinstance(text, Column) else F.lit(text)).alias("message"))
    typed = fields.where(~F.col("data_type").isin(*DATA_TYPES)).select(F.lit("error").alias("level"), F.col("field_id").alias("item"), F.concat(F.lit("Unsupported data type: "), "data_type").alias("message"))
    levelled = fields.where(~F.col("level").isin(*LEVELS)).select(F.lit("warning").alias("level"), F.col("field_id").alias("item"), F.concat(F.lit("Unknown level: "), "level").alias("message"))
    return (
        say(fields.where("field_id = ''"), "error", "Field ID is empty.")
        .unionByName(say(repeated(fields, "field_id", "pos"), "error", "Duplicate field_id."))
        .unionByName(say(fields.where("xml_tag = ''"), "error", "XML tag is empty."))
        .unionByName(say(repeated(fields, "xml_tag", "pos"), "warning", "Duplicate XML tag."))
        .unionByName(typed).unionByName(levelled)
        .unionByName(say(fields.where("data_type = 'enum' and size(controlled_values) = 0"), "warning", "Enum field has no controlled values."))
    )


def validate_project(records: DataFrame, relations: DataFrame, schema: Schema) -> DataFrame:
    """(level, item, message): schema, repeated ids, records and relations together."""
    again = repeated(records.select("record_id", "ord"), "record_id").select(F.lit("error").alias("level"), F.col("record_id").alias("item"), F.lit("Duplicate record_id.").alias("message"))
    own = validate_records(records, schema).select("level", "item", "message")
    return schema_messages(schema.frame(records.sparkSession)).unionByName(again).unionByName(own).unionByName(dangling(relations, records))
