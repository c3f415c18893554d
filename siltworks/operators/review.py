"""Manual corrections as an append-only event table, their undo, and incremental revalidation; views on rows and issues.

Edits: (seq, label, row_index, field, before, after). A batch shares its seq; the overrides are the latest value of each cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.exprs import blank_to_null, text
from ..model import Contract
from ..sources.tables import written
from .validate import recounted, validate, value_counts

EDITS = "seq long, label string, row_index long, field string, before string, after string"


def edit_cell(rows: DataFrame, seq: int, row_index: int, field: str, value: str | None) -> DataFrame:
    """The event of one edit; an empty value is null."""
    after = None if value == "" else value
    return rows.where(F.col("row_index") == row_index).select(F.lit(seq).cast("long").alias("seq"), F.lit("edit").alias("label"), "row_index", F.lit(field).alias("field"), F.col(field).alias("before"), text(after).alias("after"))


def _same(c: Column, value: str | None) -> Column:
    return F.coalesce(c, F.lit("")) == F.lit(value or "")


def bulk_replace(rows: DataFrame, seq: int, field: str, old: str | None, new: str | None, match_original: bool = False) -> DataFrame:
    """Events for the rows whose current (or original) value equals ``old``; null equals empty."""
    where = _same(F.col(field), old) | (_same(F.col("original")[field], old) if match_original else F.lit(False))
    return rows.where(where).select(F.lit(seq).cast("long").alias("seq"), F.lit("replace").alias("label"), "row_index", F.lit(field).alias("field"), F.col(field).alias("before"), blank_to_null(text(new)).alias("after"))


def bulk_trim(rows: DataFrame, seq: int, field: str) -> DataFrame:
    tidy = N.trim(F.col(field))
    return rows.where(F.col(field).isNotNull() & ~F.col(field).eqNullSafe(tidy)).select(F.lit(seq).cast("long").alias("seq"), F.lit("trim").alias("label"), "row_index", F.lit(field).alias("field"), F.col(field).alias("before"), tidy.alias("after"))


def undo_last(edits: DataFrame) -> DataFrame:
    """The events without the last batch."""
    return edits.join(F.broadcast(edits.agg(F.max("seq").alias("last"))), F.col("seq") == F.col("last"), "left_anti")


def reset_column(edits: DataFrame, field: str) -> DataFrame:
    return edits.where(F.col("field") != field)


def overrides(edits: DataFrame) -> DataFrame:
    """(row_index, overrides map): the latest value of each edited cell, null values included."""
    latest = edits.groupBy("row_index", "field").agg(F.max_by(F.struct("after"), "seq").alias("v"))
    return latest.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("v.after").alias("after")))).alias("overrides"))


@dataclass(frozen=True)
class Counts:
    """How often each value of each unique field occurs: a table written once, and a small one of what edits have changed since."""

    base: DataFrame
    changes: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, contract: Contract) -> Counts:
        return cls(written(value_counts(rows, contract)))

    def at(self, values: DataFrame) -> DataFrame:
        """(field, value, n) of the given (field, value) alone."""
        if self.changes is None:
            return self.base.join(values, ["field", "value"], "left_semi")
        both = self.base.unionByName(self.changes).join(values, ["field", "value"], "left_semi")
        return both.groupBy("field", "value").agg(F.sum("n").alias("n"))

    def changed(self, changes: DataFrame) -> Counts:
        every = changes if self.changes is None else self.changes.unionByName(changes)
        return Counts(self.base, written(every.groupBy("field", "value").agg(F.sum("n").alias("n")).where("n <> 0")))


def count_changes(old: DataFrame, new: DataFrame, contract: Contract) -> DataFrame:
    """(field, value, n): by how many the values of unique fields become more or fewer as rows change."""
    fewer = value_counts(old, contract).select("field", "value", (-F.col("n")).alias("n"))
    return fewer.unionByName(value_counts(new, contract)).groupBy("field", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def revalidated(before: DataFrame, counts: Counts, changed: DataFrame, contract: Contract, provided: set[str]) -> tuple[DataFrame, Counts]:
    """Validated rows, their counts, and rows that edits have changed, as ``transform`` gives them -> (the rows whose issues may be others now, validated; the counts).

    Beside the changed rows these are the rows with a value of a unique field that became one of many, or the only one.
    Only such values are looked up, and no value is counted again: the table is read by filters and joins with what changed.
    Several rows may change at once; row_index must be unique. An edit that changes nothing gives its row as it was.
    """
    plain = [c for c in before.columns if c not in ("issues", "row_status")]
    judged = [c for c in changed.columns if c == "codes" and changed.schema[c].dataType.names]  # what the normalizers found
    changed = written(changed.select(*plain, *judged))
    unique = [f.name for f in contract.fields if f.unique]
    if not unique:
        return validate(changed, contract, provided).select(*before.columns), counts
    old = before.join(changed.select("row_index"), "row_index", "left_semi")
    changes = written(count_changes(old, changed, contract))
    was = counts.at(changes.select("field", "value")).withColumnRenamed("n", "was")
    flipped = changes.join(was, ["field", "value"], "left").select("field", "value", "n", F.coalesce("was", F.lit(0)).alias("was")).where("(was > 1) <> (was + n > 1)")
    flipped = written(flipped.select("field", "value"))
    others, hit = before.join(changed.select("row_index"), "row_index", "left_anti"), F.lit(False)
    for f in unique:
        mine = flipped.where(F.col("field") == f).select(F.col("value").alias("__value"), F.lit(True).alias(f"__hit_{f}"))
        others = others.join(mine, F.col(f) == F.col("__value"), "left").drop("__value")
        hit = hit | F.coalesce(f"__hit_{f}", F.lit(False))
    others = written(others.where(hit).select(*before.columns))
    counts = counts.changed(changes)
    cells = lambda rows: rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in unique])).alias("v")).select("v.*")
    now = counts.at(cells(others).union(cells(changed)).distinct())
    fresh = validate(changed, contract, provided, now).select(*before.columns)
    return fresh.unionByName(recounted(others, contract, now)), counts


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same row_index."""
    return old.join(new.select("row_index"), "row_index", "left_anti").unionByName(new)


# ---- views


def rows_by_status(validated: DataFrame, wanted: str) -> DataFrame:
    """ready, warning or error; ``issues`` is all that isn't ready; anything else is all rows."""
    if wanted == "issues":
        return validated.where("row_status <> 'ready'")
    return validated.where(F.col("row_status") == wanted) if wanted in ("ready", "warning", "error") else validated


def rows_with_issue(validated: DataFrame, field: str | None = None, code: str | None = None) -> DataFrame:
    hit = lambda i: (i["field"] == field if field else F.lit(True)) & (i["code"] == code if code else F.lit(True))
    return validated.where(F.exists("issues", lambda i: F.coalesce(hit(i), F.lit(False))))


def search(validated: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Rows with the text in any value or original value, in either case."""
    cells = F.array(*[F.col(f) for f in fields], *[F.col("original")[f] for f in fields])
    return validated.where(F.exists(cells, lambda c: F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))))


def page(rows: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """A page from 1, by the given columns, nulls first."""
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def row_view(validated: DataFrame, fields: list[str], edits: DataFrame | None = None) -> DataFrame:
    """row_index, row_number as shown, row_status and, for each field, value, original, its issues and whether it was edited."""
    rows = validated
    if edits is not None:
        rows = rows.join(edits.groupBy("row_index").agg(F.collect_set("field").alias("edited")), "row_index", "left")
    edited = lambda f: F.coalesce(F.array_contains("edited", f), F.lit(False)) if edits is not None else F.lit(False)
    cell = lambda f: F.struct(F.col(f).alias("value"), F.col("original")[f].alias("original"), F.filter("issues", lambda i: i["field"] == f).alias("issues"), edited(f).alias("edited"))
    return rows.select("row_index", (F.col("row_index") + 2).alias("row_number"), "row_status", *[cell(f).alias(f) for f in fields])


def latest_first(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)
