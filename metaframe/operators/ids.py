"""Unique ids in the order of records, and repeated ids."""

from __future__ import annotations

from collections.abc import Container, Iterator
from functools import reduce
from itertools import chain, count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaframe.scratch import written

#: Consecutive records that are numbered together; an id with more copies is numbered in several tasks.
RUN = 100_000
#: Most numbered forms of an id that exist already and are stepped over within a row; with more, its records are resolved in order.
GAPS = 1000
_ENDINGS = r"((?:_[0-9]+)+)\z"


def _forms(base: str) -> Iterator[str]:
    """base, base_2, base_3, ..."""
    return chain([base], (f"{base}_{n}" for n in count(2)))


def free_id(base: str, taken: Container[str]) -> str:
    """The first form of base that is not taken."""
    return next(x for x in _forms(base) if x not in taken)


def _resolve(group: pa.Table) -> pa.Table:
    """Records of one base (place: their rank; null for ids that exist already) with their new ids."""
    known = set(group.filter(pc.is_null(group["_place"]))["_wanted"].to_pylist())
    new = group.filter(pc.is_valid(group["_place"])).sort_by("_place")
    forms: dict[str, Iterator[str]] = {}
    out = []
    for wanted in new["_wanted"].to_pylist():
        left = forms.setdefault(wanted, _forms(wanted))  # what it has gone past is taken for good
        out.append(next(x for x in left if x not in known))
        known.add(out[-1])
    return new.set_column(new.schema.get_field_index("_wanted"), "_wanted", pa.array(out, pa.string()))


def _prefixes(c: Column) -> Column:
    """An id and what is left of it without one, two, ... numbered endings, shortest first."""
    tail = F.regexp_extract(c, _ENDINGS, 1)
    stem = F.left(c, F.length(c) - F.length(tail))
    parts = F.filter(F.split(tail, "_"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, stem).otherwise(F.concat(stem, F.lit("_"), F.array_join(F.slice(parts, F.lit(1), i), "_"))))


def _conflicts(records: DataFrame, existing: DataFrame | None) -> DataFrame:
    """(base, exists, ordered, gaps) of each id that repeats or exists already.

    ordered: its copies meet new ids that are it with numbered endings, or more than GAPS existing ones. gaps: for the
    i-th numbered form that exists, how many free numbers are below it.
    """
    new = records.select("record_id", F.lit(1).alias("new"))
    both = new if existing is None else new.unionByName(existing.select("record_id", F.lit(0).alias("new")))
    each = written(both.where("record_id is not null").groupBy("record_id").agg(F.sum("new").alias("n"), (F.min("new") == 0).alias("had")), "ids")
    bases = each.where("n > 1 or n = 1 and had").select(F.col("record_id").alias("base"))
    forms = each.select("*", F.explode(_prefixes(F.col("record_id"))).alias("base")).join(bases, "base")
    number = F.regexp_extract("record_id", r"_([1-9][0-9]{0,17})\z", 1)
    simple = F.col("had") & (F.col("record_id") == F.concat("base", F.lit("_"), number))
    told = forms.groupBy("base").agg(
        F.max(F.col("had") & (F.col("record_id") == F.col("base"))).alias("exists"), F.max((F.col("n") > 0) & (F.col("record_id") != F.col("base"))).alias("mixed"),
        F.count_if(simple).alias("many"), F.count_if(simple & (number.try_cast("long") > 1)).alias("some"),
    )
    told = told.select("base", "exists", (F.col("mixed") | (F.col("many") > GAPS)).alias("ordered"), "some")
    least = forms.where(simple).join(told.where("not ordered and some > 0").select("base"), "base", "left_semi").groupBy("base").agg(F.array_sort(F.collect_list(number.try_cast("long"))).alias("t"))  # GAPS at most
    gaps = least.select("base", F.transform(F.filter("t", lambda t: t > 1), lambda t, i: t - 2 - i).alias("gaps"))
    return told.drop("some").join(gaps, "base", "left")


def unique_ids(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """records with record_id made unique in the order of `ord`, after the ids of `existing` (column record_id).

    Only conflicts cost anything: ids that repeat or exist already, and ids that are such a one with numbered
    endings, which its copies could take. All others stay as they are, and without conflicts all records do. Copies
    of an id are numbered by ranks in runs of `ord` with the counts of earlier runs added, over the gaps that
    existing ids leave, so an id of a third of all records is no single task. Where new ids with numbered endings
    meet their base's copies, the records of that base are resolved in order, in one task. Nothing is joined by
    `ord`; records of one `ord` are numbered in any order. Null ids stay null.
    """
    known = written(_conflicts(records, existing), "conflicts")
    if known.isEmpty():
        return records
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("_row"), F.col("record_id").alias("_wanted"), F.coalesce(F.col("ord").cast("long"), F.lit(-1)).alias("_place"), _prefixes(F.col("record_id")).alias("_prefixes"))
    deep = rows.agg(F.coalesce(F.max(F.size("_prefixes")), F.lit(1))).first()[0]
    for i in range(deep):
        rows = rows.join(known.select(F.col("base").alias(f"_b{i}")), F.get("_prefixes", F.lit(i)) == F.col(f"_b{i}"), "left")
    rows = rows.select("_row", "_wanted", "_place", F.coalesce(*(F.col(f"_b{i}") for i in range(deep))).alias("base"))
    free = rows.where("base is null").select("_row", "_wanted")
    met = written(rows.where("base is not null").join(known, "base"), "met")

    # the j-th copy (from 0; 1 if the base exists) is the base, or the j-th number from 2 on that no existing id has
    plain = met.where("not ordered").withColumn("_run", F.floor(F.col("_place") / RUN))
    sizes = plain.groupBy("base", "_run").agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("base").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = plain.join(ahead, ["base", "_run"]).withColumn("_j", F.row_number().over(Window.partitionBy("base", "_run").orderBy("_place")) - 1 + F.col("_ahead") + F.col("exists").cast("int"))
    number = F.col("_j") + 1 + F.coalesce(F.size(F.filter("gaps", lambda g: g < F.col("_j"))), F.lit(0))
    numbered = ranked.select("_row", F.when(F.col("_j") == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), number.cast("string"))).alias("_wanted"))
    parts = [free, numbered]
    ordered = known.where("ordered").select("base")
    if not ordered.isEmpty():
        inner = met.where("ordered").select("base", "_row", "_wanted", "_place")
        if existing is not None:
            had = existing.select(F.col("record_id").alias("_wanted"), F.explode(_prefixes(F.col("record_id"))).alias("base")).join(ordered, "base").distinct()
            inner = inner.unionByName(had.select("base", F.lit(None).cast(met.schema["_row"].dataType).alias("_row"), "_wanted", F.lit(None).cast("long").alias("_place")))
        parts.append(inner.groupBy("base").applyInArrow(_resolve, inner.schema).select("_row", "_wanted"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*[F.col("_wanted").alias(c) if c == "record_id" else F.col(f"_row.`{c}`").alias(c) for c in records.columns])


def generated_id() -> Column:
    """An id that depends on the record alone, so that a task that runs again gives the same."""
    return F.concat(F.lit("rec_"), F.left(F.md5(F.concat_ws("\x1f", F.col("ord").cast("string"), F.to_json("fields")).cast("binary")), F.lit(10)))


def derive_ids(records: DataFrame, source: str = "sheet") -> DataFrame:
    """record_id by where the records are from. "sheet": the field record_id, else text_id; "xml": the element's own; either way else a generated one."""
    first = lambda k: F.nullif(F.array_join(F.coalesce(F.col("fields")[F.lit(k)], F.array().cast("array<string>")), "; "), F.lit(""))
    own = (first("record_id"), first("text_id")) if source == "sheet" else (F.nullif("record_id", F.lit("")),)
    return records.withColumn("record_id", F.coalesce(*own, generated_id()))


def copies(records: DataFrame, which: DataFrame, first_ord: int) -> DataFrame:
    """Copies of the records named in `which` (record_id), as <id>_copy made unique, numbered from first_ord."""
    chosen = records.join(which.select("record_id").distinct(), "record_id", "left_semi")
    # ords stay apart by construction: the copy of ord n is first_ord + n
    made = chosen.withColumn("record_id", F.concat("record_id", F.lit("_copy"))).withColumn("ord", F.col("ord") + first_ord)
    return unique_ids(made, records)


def repeated(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Every row of a key after its first. The first is found by a partial aggregate, so a hot key is no single task."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, rows[key].eqNullSafe(first[key])).where(F.col(order) > F.col("_first")).drop("_first").drop(first[key])


def renamed(old_id: str, new_id: str, taken: Container[str]) -> str:
    """The id of an edited record: unique only if it changes and is taken."""
    return new_id if new_id == old_id or new_id not in taken else free_id(new_id, taken)

