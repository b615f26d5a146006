"""Projects: appending imports, merging, lookups, previews, source precedence and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaframe.functions.text import blank
from metaframe.operators.ids import derive_ids, unique_ids
from metaframe.schema import Schema
from metaframe.sources.xml import import_xml, load_schema, read_records, read_relations, roots

#: Rows and records of previews, and the fewest characters that a limit may be set to.
PREVIEW_ROWS, PREVIEW_RECORDS, LEAST_CHARS = 100, 20, 1000


def append_import(records: DataFrame, new: DataFrame, derive: str | None = "sheet") -> DataFrame:
    """records and new ones behind them, whose ids are derived by where they are from (None: taken as they are) and made unique against all before."""
    last = records.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    new = derive_ids(new, derive) if derive else new
    placed = new.crossJoin(F.broadcast(last)).withColumn("ord", F.col("ord") + F.col("last") + 1).select(records.columns)  # one row, not a product
    return records.unionByName(unique_ids(placed, records))


@dataclass
class Project:
    """A schema with its records and relations."""

    schema: Schema
    records: DataFrame
    relations: DataFrame


def with_schema(project: Project, schema: Schema) -> Project:
    """The project with another schema in its place; its records stay, and values of fields that it lacks are those of unknown fields."""
    return Project(schema, project.records, project.relations)


def import_documents(project: Project, path: str, add_unknown: bool = False, preserve: bool = True) -> Project:
    """XML documents of any kind taken into the project, by their roots: whole projects are merged, of schemas the new fields are taken, and all others give records by the schema's names.

    Files are taken by path; of generic documents the records have their element's record_id, or a generated one.
    """
    spark = project.records.sparkSession
    by_root: dict[str, list[str]] = {}
    for r in roots(spark, path).orderBy("path").collect():  # a row for each file
        by_root.setdefault(r.root if r.root in ("metadata_project", "schema") else "", []).append(r.path)
    for one in by_root.get("schema", []):
        project.schema.merge(load_schema(spark, one))
    for one in by_root.get("metadata_project", []):
        records, relations = merge_projects(project.schema, project.records, project.relations, load_schema(spark, one), read_records(spark, one), read_relations(spark, one))
        project = Project(project.schema, records, relations)
    if generic := by_root.get(""):
        new = import_xml(spark, generic, project.schema, add_unknown, preserve)
        project = Project(project.schema, append_import(project.records, new.select(project.records.columns), "xml"), project.relations)
    return project


def merge_projects(schema: Schema, records: DataFrame, relations: DataFrame, other_schema: Schema, other_records: DataFrame, other_relations: DataFrame, rewrite_relations: bool = False) -> tuple[DataFrame, DataFrame]:
    """Another project taken into this one: new fields, its records with ids made unique, its relations.

    Relations keep their ends, so those of a record that is renamed point at the record that was here first;
    rewrite_relations makes them follow it.
    """
    schema.merge(other_schema)
    merged = append_import(records, other_records, derive=None)
    if rewrite_relations:
        last = records.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
        renamed = merged.join(F.broadcast(last)).where(F.col("ord") > F.col("last")).select((F.col("ord") - F.col("last") - 1).alias("_o"), F.col("record_id").alias("_new"))
        # of records that shared an id before, relations follow the first
        names = other_records.groupBy("record_id").agg(F.min("ord").alias("_o")).join(renamed, "_o").select(F.col("record_id").alias("_old"), "_new")
        for end in ("source_record", "target_record"):
            other_relations = other_relations.join(names, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    shift = relations.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    added = other_relations.join(F.broadcast(shift)).withColumn("ord", F.col("ord") + F.col("last") + 1).select(relations.columns)
    return merged, relations.unionByName(added)


def record_by_id(records: DataFrame, record_id: str) -> DataFrame:
    """The first record of an id."""
    return records.where(F.col("record_id") == record_id).orderBy("ord").limit(1)


def xml_preview(leaves: DataFrame, n: int = PREVIEW_RECORDS) -> DataFrame:
    """(record, values): the first records of generic XML leaves, a map of tags to texts; of repeated tags the last counts."""
    last = leaves.groupBy("path", "record", "tag").agg(F.max_by("text", "leaf").alias("text"))
    return last.groupBy("path", "record").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "text")))).alias("values")).orderBy("path", "record").limit(n)


def preferred_source(file_text: Column, page_text: Column, pasted: Column) -> Column:
    """The text that counts: a file's, else a page's, else pasted text; null if there is none."""
    return F.when(~blank(file_text), file_text).when(~blank(page_text), page_text).when(~blank(pasted), pasted)


@dataclass
class Settings:
    """Settings of an extractor, kept in a JSON file; a file that is missing or broken gives the defaults."""

    base_url: str = ""
    model: str = ""
    max_chars: int = 60_000

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
            out = cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})
            out.max_chars = max(LEAST_CHARS, int(out.max_chars))
        except (OSError, ValueError, TypeError):
            return cls()
        return out

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")
