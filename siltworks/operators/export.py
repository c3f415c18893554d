"""Sinks and reports: guarded CSV, JSON lines, error rows, the import report."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.exprs import text
from ..functions.normalize import NUMBERS, guard
from ..model import ERROR, TransformSpec


def scope(validated: DataFrame, wanted: str) -> DataFrame:
    """ready: rows without an error, so with warnings, too; errors: rows with one; all."""
    if wanted == "ready":
        return validated.where("row_status <> 'error'")
    return validated.where("row_status = 'error'") if wanted == "errors" else validated


def guarded(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select("row_index", *[guard(F.col(f)).alias(f) for f in fields])


def write_csv(rows: DataFrame, fields: list[str], path: str) -> None:
    """A folder of CSV parts with CRLF line ends and guarded cells, null as nothing; each part has the header."""
    guarded(rows, fields).sortWithinPartitions("row_index").select(*fields).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", lineSep="\r\n", quote='"', escape='"')


def csv_lines(rows: DataFrame, fields: list[str]) -> DataFrame:
    """row_index (-1: the header), line: guarded cells of header and rows, quoted where they hold a quote, a comma or a line end."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = lambda cells: F.concat_ws(",", *map(cell, cells))
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("row_index"), line([guard(F.lit(f)) for f in fields]).alias("line"))
    return head.unionByName(rows.select(F.col("row_index").cast("long").alias("row_index"), line([guard(F.col(f)) for f in fields]).alias("line")))


def write_single_csv(rows: DataFrame, fields: list[str], path: str) -> None:
    """One CSV part with a byte-order mark, for spreadsheets; a single task writes it, so it's for tables of a spreadsheet's size."""
    marked = csv_lines(rows, fields).select("row_index", F.when(F.col("row_index") == -1, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")).alias("line"))
    marked.coalesce(1).sortWithinPartitions("row_index").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def json_array_lines(rows: DataFrame, fields: list[str]) -> DataFrame:
    """row_index, line: the lines of one JSON array of all rows, nulls included, indented by two; the brackets are the first and the last."""
    value = lambda f: F.when(F.col(f).isNull(), F.lit("null")).otherwise(F.expr(f"substring(to_json(struct(`{f}` as x)), 6, length(to_json(struct(`{f}` as x))) - 6)"))
    body = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'    "{f}": '), value(f)) for f in fields]), F.lit("\n  }"))
    last = rows.agg(F.max("row_index").alias("last"))
    each = rows.select("row_index", body.alias("body")).join(F.broadcast(last), how="left").select(F.col("row_index").cast("long").alias("row_index"), F.when(F.col("row_index") == F.col("last"), F.col("body")).otherwise(F.concat("body", F.lit(","))).alias("line"))
    ends = rows.sparkSession.range(2).select(F.when(F.col("id") == 0, -1).otherwise((1 << 63) - 1).cast("long").alias("row_index"), F.when(F.col("id") == 0, "[").otherwise("]").alias("line"))
    return each.unionByName(ends)


def write_json_array(rows: DataFrame, fields: list[str], path: str) -> None:
    """One JSON file; a single task writes it."""
    json_array_lines(rows, fields).coalesce(1).sortWithinPartitions("row_index").select("line").write.mode("overwrite").text(path)


def json_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """row_index, json: all fields, nulls included, not guarded."""
    return rows.select("row_index", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, fields: list[str], path: str) -> None:
    json_rows(rows, fields).select("json").write.mode("overwrite").text(path)


def error_rows(validated: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with an error: _row as shown, _issues (field: message of errors, joined), then the guarded fields."""
    errors = F.filter("issues", lambda i: i["severity"] == ERROR)
    told = F.array_join(F.transform(errors, lambda i: F.concat_ws(": ", i["field"], i["message"])), "; ")
    return validated.where(F.size(errors) > 0).select((F.col("row_index") + 2).alias("_row"), told.alias("_issues"), *[guard(F.col(f)).alias(f) for f in fields])


def report(validated: DataFrame, issues: DataFrame, contract_name: str, file_name: str, limit: int = 8, *, scope: str = "ready", mapping: dict[str, str | None] | None = None, specs: Sequence[TransformSpec] = (), template: str | None = None, generated_at: datetime | None = None, job_id: str | None = None) -> DataFrame:
    """One row: when and of what, counts, what a scope exports, the mapping, the transformations in effect and the top issues with their messages."""
    of = lambda s: F.count_if(F.col("row_status") == s)
    totals = validated.agg(F.count("*").alias("rows"), of("ready").alias("ready"), of("warning").alias("warning"), of("error").alias("error"))
    first = F.min(F.struct(F.coalesce("row_index", F.lit(-1)).alias("r"), F.col("seq"), F.col("message")))
    ranked = issues.groupBy("code", "severity", "field").agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").limit(limit)
    top = ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col("first"), "code", "field", "severity", F.col("first.message").alias("message"), "n"))).alias("top_issues"))
    strings = lambda rows, *names: F.array(*[F.struct(*[text(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]) if rows else F.expr(f"cast(array() as array<struct<{','.join(f'{n}:string' for n in names)}>>)")
    pairs = strings(list((mapping or {}).items()), "source", "target")
    steps = strings([(s.kind, s.target, s.label) for s in specs if s.enabled], "kind", "target", "label")
    exported = {"ready": F.col("ready") + F.col("warning"), "errors": F.col("error")}.get(scope, F.col("rows"))
    share = F.when(F.col("rows") > 0, F.round(F.lit(100.0) * F.col("ready") / F.col("rows"), 1)).otherwise(0.0)
    head = (F.lit(generated_at or datetime.now(UTC).replace(microsecond=0, tzinfo=None)).cast("timestamp_ntz").alias("generated_at"), text(job_id).alias("job_id"), F.lit(contract_name).alias("contract"), F.lit(file_name).alias("file"), text(template).alias("template"))
    return totals.join(F.broadcast(top), how="left").select(*head, "rows", "ready", "warning", "error", share.alias("ready_pct"), F.lit(scope).alias("scope"), exported.alias("exported"), pairs.alias("mapping"), steps.alias("transformations"), F.transform("top_issues", lambda t: t.dropFields("order", "first")).alias("top_issues"))


def report_rows(told: Row) -> list[tuple[str, str]]:
    """A report as the rows of a sheet: names and values, then the mapping, the transformations and the top issues under their own heads, cells guarded."""
    safe = lambda v: "'" + v if v[:1] in "=+-@\t\r" and not re.fullmatch(NUMBERS, v.strip()) else v
    names = (("Generated at", "generated_at"), ("Source file", "file"), ("Contract", "contract"), ("Template", "template"), ("Rows in file", "rows"), ("Ready", "ready"), ("Warnings", "warning"), ("Errors", "error"), ("Exported rows", "exported"), ("Scope", "scope"))
    out = [(name, safe(str(told[c]))) for name, c in names if told[c] is not None]
    parts = (("Mapping", [(m["source"], m["target"] or "(ignored)") for m in told["mapping"]]), ("Transformations", [(t["kind"], t["label"] or t["target"] or "") for t in told["transformations"]]), ("Top issues", [(i["message"], str(i["n"])) for i in told["top_issues"]]))
    for head, rows in parts:
        out += [("", ""), (head, ""), *[(safe(a), safe(b)) for a, b in rows]]
    return out
