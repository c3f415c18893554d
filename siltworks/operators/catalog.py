"""Catalogs of contracts, templates and jobs as tables, stored rows and issues by job, and names of uploads.

A catalog is a table whose rows have a key. It's never changed in place: each function gives the table as it is afterwards.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import strip
from ..model import Contract

CONTRACTS = "schema string, version int, builtin boolean, created_at timestamp, position int, field string, type string, spec string"


def put(catalog: DataFrame, entries: DataFrame, *key: str) -> DataFrame:
    """The catalog with ``entries`` in place of the rows of the same keys."""
    return delete(catalog, entries, *key).unionByName(entries)


def delete(catalog: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return catalog.join(keys.select(*key).distinct(), list(key), "left_anti")


def listed(catalog: DataFrame, *order: Column) -> DataFrame:
    """The rows in order, numbered from 1 in the column ``place``."""
    return catalog.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def contract_order() -> list[Column]:
    """Built-in contracts first, then by creation and name; the fields of each by position."""
    return [F.desc("builtin"), F.asc("created_at"), F.asc("schema"), F.asc("position")]


def template_order() -> list[Column]:
    """The newest first."""
    return [F.desc("created_at"), F.desc("template_id")]


def contract_rows(spark: SparkSession, contract: Contract, created_at, builtin: bool = False) -> DataFrame:
    """A contract as catalog rows, one a field, with its position and its specification as JSON."""
    rows = [(contract.name, contract.version, builtin, created_at, i, f.name, f.type, json.dumps(asdict(f), sort_keys=True)) for i, f in enumerate(contract.fields)]
    return spark.createDataFrame(rows, CONTRACTS)


def latest(catalog: DataFrame, key: str = "schema", version: str = "version") -> DataFrame:
    """The rows of each key's highest version."""
    return catalog.join(catalog.groupBy(key).agg(F.max(version).alias(version)), [key, version], "left_semi")


def counted_use(templates: DataFrame, applied: DataFrame) -> DataFrame:
    """templates (template_id, use_count, ...) after each row of applied (template_id) has used one."""
    more = applied.groupBy("template_id").agg(F.count("*").alias("__n"))
    return templates.join(more, "template_id", "left").withColumn("use_count", F.col("use_count") + F.coalesce("__n", F.lit(0))).drop("__n").select(*templates.columns)


def effective(mapping: DataFrame) -> DataFrame:
    """The mapping with ignored sources (ignored) mapped to nothing."""
    return mapping.withColumn("target", F.when(~F.coalesce("ignored", F.lit(False)), F.col("target")))


def mapping_view(mapping: DataFrame, profiled: DataFrame) -> DataFrame:
    """Each source with its effective target and what the profile says of its column; a source without a column keeps its row."""
    told = profiled.select(F.col("column").alias("source"), "detected_type", "non_empty_count", "empty_pct", "examples")
    return effective(mapping).join(told, "source", "left")


def replace_issues(issues: DataFrame, job_id: int, path: str) -> None:
    """Write a job's issues in place of those that it had; other jobs' stay."""
    issues.withColumn("job_id", F.lit(job_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def cell_text(c: Column, kind: str) -> Column:
    """A typed cell as the text that it would have in a workbook: dates without a time of midnight, whole numbers without a point."""
    if kind == "boolean":
        return c.cast("string")
    if kind in ("timestamp", "timestamp_ntz"):
        midnight = c == F.date_trunc("day", c)
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if kind in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return F.nullif(F.regexp_replace(c.cast("string"), "^﻿", ""), F.lit(""))


def text_rows(rows: DataFrame) -> DataFrame:
    """Every column of a typed table as text, so that it's conformed like a file."""
    return rows.select(*[cell_text(F.col(f"`{f.name}`"), f.dataType.simpleString().split("(")[0]).alias(f.name) for f in rows.schema.fields])


def upload_name(name: Column, token: Column) -> Column:
    """A name under which an upload is kept: its last path part, letters, digits, points and dashes only, after a token."""
    last = F.regexp_extract(strip(name), r"[^/\\]*\z", 0)
    tidy = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+", "")
    return F.concat_ws("_", token, F.when(tidy == "", F.lit("file")).otherwise(F.substring(tidy, -80, 80)))


def expired(files: DataFrame, at: Column, days: int) -> DataFrame:
    """files (modified_at, ...) that are older than so many days."""
    return files.where(F.col("modified_at") < at - F.expr(f"interval {int(days)} days"))
