"""A schema compiled to column expressions on the driver: validation, flattening and coercion run as narrow plans.

There is no join of records with fields; each field becomes a few expressions over the record's map.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.functions.checks import coerced, value_message
from metaframe.functions.text import blank, strip
from metaframe.schema import Field, Schema

#: Fields in one generated projection; with more, messages are made in several.
CHUNK = 20
MANY = "Multiple values returned for a non-repeatable field; kept the first non-empty value."
_MESSAGES = "array<struct<level:string,item:string,message:string>>"


def values(field_id: str, fields: str = "fields") -> Column:
    """A field's values; none if the record does not have it."""
    return F.coalesce(F.col(fields)[F.lit(field_id)], F.array().cast("array<string>"))


def joined(field_id: str, sep: str = "; ") -> Column:
    return F.array_join(F.transform(values(field_id), lambda v: F.coalesce(v, F.lit(""))), sep)


def filled(field_id: str) -> Column:
    return F.filter(values(field_id), lambda v: ~blank(v))


#: A rule of one's own: from a stripped value to a message, null if there is nothing to say.
Rule = Callable[[Column], Column]


def field_messages(f: Field, own: Column | None = None, rule: Rule | None = None) -> Column:
    """Messages of one field of one record: missing, repeated, and one for each wrong value. own: its filled values, if a column has them; rule: asked of values that are right otherwise."""
    row = lambda text: F.struct(F.lit("error").alias("level"), F.col("record_id").alias("item"), text.alias("message"))
    none = F.array().cast(_MESSAGES)
    own = filled(f.field_id) if own is None else own
    wrong = F.transform(own, lambda v: F.coalesce(value_message(f, v), rule(strip(v))) if rule else value_message(f, v))
    found = F.transform(F.filter(wrong, lambda m: m.isNotNull()), lambda m: row(F.concat(F.lit(f"{f.field_id}: "), m)))
    if not f.repeatable:
        found = F.concat(F.when(F.size(own) > 1, F.array(row(F.lit(f"Field is not repeatable: {f.field_id}")))).otherwise(none), found)
    if f.required:
        found = F.when(F.size(own) == 0, F.array(row(F.lit(f"Required field is empty: {f.field_id}")))).otherwise(found)
    return found


def unknown_fields(schema: Schema) -> Column:
    """The record's fields that the schema lacks, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.map_keys("fields"), F.array().cast("array<string>")), F.array(*map(F.lit, schema.ids())).cast("array<string>")))


def validate_records(records: DataFrame, schema: Schema, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """(level, item, message, ord): every message of every record. Records without any give no row. rules: by field id, one's own rules."""
    unknown = F.transform(unknown_fields(schema), lambda k: F.struct(F.lit("warning").alias("level"), F.col("record_id").alias("item"), F.concat(F.lit("Unknown field not defined in schema: "), k).alias("message")))
    records = records.select("ord", "record_id", "fields", *(filled(f.field_id).alias(f"_v{i}") for i, f in enumerate(schema.fields)))  # each is used several times
    own = [field_messages(f, F.col(f"_v{i}"), (rules or {}).get(f.field_id)) for i, f in enumerate(schema.fields)]
    parts = [F.concat(*own[i : i + CHUNK]) for i in range(0, len(own), CHUNK)] + [unknown]
    frame = records.select("ord", *(p.cast(_MESSAGES).alias(f"_m{i}") for i, p in enumerate(parts)))
    return frame.select("ord", F.explode(F.concat(*(F.col(f"_m{i}") for i in range(len(parts))))).alias("m")).select("m.level", "m.item", "m.message", "ord")


def flatten(records: DataFrame, schema: Schema | None = None) -> DataFrame:
    """record_id, record_type and a column for each field, its values joined; a field of either name takes its place."""
    ids = schema.ids() if schema else []
    head = [c for c in ("record_id", "record_type") if c not in ids]
    return records.select(*head, *(joined(i).alias(i) for i in ids))


def flatten_any(records: DataFrame) -> DataFrame:
    """Without a schema: (record_id, record_type, field, value), a row for each of the record's fields."""
    entries = F.array_sort(F.map_entries("fields"), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
    return records.select("record_id", "record_type", F.explode(entries).alias("e")).select("record_id", "record_type", F.col("e.key").alias("field"), F.array_join("e.value", "; ").alias("value"))


def coerce_values(f: Field, given: Column, listed: Column | None = None) -> Column:
    """A struct of the field's canonical values and a warning, from the values that a model returned (null: none).

    listed: whether they came as a list, of which a field that is not repeatable tells, whatever its length; by default all do.
    """
    listed = given.isNotNull() if listed is None else listed
    given = F.coalesce(given, F.array().cast("array<string>"))
    if f.repeatable:
        done = F.transform(given, lambda v: coerced(f, v))
        kept = F.filter(F.transform(done, lambda x: x.value), lambda v: v != "")
        said = F.array_distinct(F.filter(F.transform(done, lambda x: x.warning), lambda w: w != ""))
        return F.struct(kept.alias("values"), F.array_join(said, "; ").alias("warning"))
    first = F.element_at(F.concat(F.filter(given, lambda v: ~blank(v)), F.array(F.lit(""))), 1)
    done = coerced(f, first)
    many = F.when(listed, MANY).otherwise("")
    return F.struct(F.filter(F.array(done.value), lambda v: v != "").alias("values"), strip(F.concat_ws(" ", many, done.warning)).alias("warning"))


def typed(records: DataFrame, schema: Schema) -> DataFrame:
    """record_id and a typed column for each field: numbers, years, dates and booleans; what cannot be cast is null."""
    kinds = {"integer": "decimal(38,0)", "float": "double", "year": "int"}

    def column(f: Field) -> Column:
        v = strip(F.element_at(F.concat(filled(f.field_id), F.array(F.lit(""))), 1))
        if f.data_type in kinds:
            return F.replace(v, F.lit("_"), F.lit("")).try_cast(kinds[f.data_type])
        if f.data_type == "date":
            return F.coalesce(*(F.try_to_timestamp(v, F.lit(form)).cast("date") for form in ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy-M", "yyyy/M")))
        if f.data_type == "boolean":
            return F.when(v != "", F.lower(v).isin("true", "1", "yes", "是"))
        return joined(f.field_id)

    return records.select("record_id", *(column(f).alias(f.field_id) for f in schema.fields if f.field_id != "record_id"))
