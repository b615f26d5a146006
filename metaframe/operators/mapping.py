"""Binding of headers and tags to fields, and imports that follow it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.functions.text import blank, slugify, strip
from metaframe.schema import Field, Schema, slug

#: Tags that stand for structure, never for fields.
STRUCTURAL = ("records", "record", "field", "relations", "relation")


def keys(schema: Schema, stripped: bool = True) -> dict[str, str]:
    """Lower-case ids, tags and labels to field ids; of fields that share one the later wins."""
    out = {}
    for f in schema.fields:
        for key in (f.field_id, f.xml_tag, f.label_zh, f.label_en):
            if key:
                out[(key.strip() if stripped else key).lower()] = f.field_id
    return out


def bound(header: Column, schema: Schema, stripped: bool = True) -> Column:
    """The field that a header (or, not stripped, a tag) names; null if none does. The schema is a literal map, so there is no join."""
    known = keys(schema, stripped)
    if not known:
        return F.lit(None).cast("string")
    lookup = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(lookup[F.lower(strip(header) if stripped else header)], lookup[slugify(header)])


def suggest_mapping(headers: DataFrame, schema: Schema, stripped: bool = True) -> DataFrame:
    """(header, field_id) of each header but empty ones; field_id is null for those that are unknown."""
    return headers.where(F.col("header") != "").select("header", bound(F.col("header"), schema, stripped).alias("field_id"))


def unknown_headers(headers: DataFrame, schema: Schema, stripped: bool = True) -> DataFrame:
    return suggest_mapping(headers, schema, stripped).where("field_id is null").select("header")


def mapping_of(headers: list[str], schema: Schema, stripped: bool = True) -> tuple[dict[str, str], list[str]]:
    """The same for a list of headers on the driver: the mapping, and the unknown ones."""
    known = keys(schema, stripped)
    found = {h: known.get((h.strip() if stripped else h).lower()) or known.get(slug(h)) for h in headers if h}
    return {h: f for h, f in found.items() if f}, [h for h in headers if h and not found[h]]


def add_headers(schema: Schema, headers: list[str], mapping: dict[str, str]) -> None:
    """Adds a string field for each unmapped header; one whose slug is a field's id is an error."""
    for h in headers:
        if h and h not in mapping:
            fid = slug(h)
            schema.add(Field(fid, h, h, fid))
            mapping[h] = fid


def add_tags(schema: Schema, tags: list[str], mapping: dict[str, str]) -> None:
    """The same for tags, but a field of the slug is used again, and structural tags are left out."""
    for t in tags:
        if t not in STRUCTURAL and t not in mapping:
            fid = slug(t)
            if schema.get(fid) is None:
                schema.add(Field(fid, t, t, t))
            mapping[t] = fid


def import_rows(rows: DataFrame, headers: list[str], mapping: Mapping[str, str], max_rows: int | None = None) -> DataFrame:
    """Records from rows of `cells` (array of strings, null for empty cells) in the order of `ord`.

    Rows without any filled cell are left out and not counted for max_rows. A later cell of the same field
    replaces an earlier one; a cell is one value, whatever is in it.
    """
    rows = rows.where(F.exists("cells", lambda c: ~blank(c)))
    if max_rows is not None:
        rows = rows.orderBy("ord").limit(max_rows)
    by_field: dict[str, list[int]] = {}
    for i, h in enumerate(headers):
        if mapping.get(h):
            by_field.setdefault(mapping[h], []).append(i)
    cell = lambda i: F.get("cells", F.lit(i))
    if not by_field:
        fields = F.create_map().cast("map<string,array<string>>")
    else:
        entries = F.array(*(F.struct(F.lit(f).alias("k"), F.coalesce(*(cell(i) for i in reversed(at))).alias("v")) for f, at in by_field.items()))
        fields = F.map_from_entries(F.transform(F.filter(entries, lambda e: e.v.isNotNull()), lambda e: F.struct(e.k, F.array(e.v))))
    return rows.select(F.lit("").alias("record_id"), F.lit("text").alias("record_type"), fields.alias("fields"), F.lit("").alias("original_xml"), "ord")
