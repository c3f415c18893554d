"""Summaries of validated rows and their issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.dimension import country_names
from ..functions.exprs import let, text
from ..sources.tables import written
from .similarity import nearest_names


def summary(validated: DataFrame) -> DataFrame:
    """One row: rows, ready, warning, error, importable, ready_pct and the number of issues of each severity, in one aggregation."""
    of = lambda s: F.count_if(F.col("row_status") == s)
    n = lambda s: F.coalesce(F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s)).cast("long")), F.lit(0))
    out = validated.agg(F.count("*").alias("rows"), of("ready").alias("ready"), of("warning").alias("warning"), of("error").alias("error"), n("ERROR").alias("n_error"), n("WARNING").alias("n_warning"), n("INFO").alias("n_info"))
    return out.withColumn("importable", F.col("ready") + F.col("warning")).withColumn("ready_pct", F.when(F.col("rows") > 0, F.round(F.lit(100.0) * F.col("ready") / F.col("rows"), 1)).otherwise(0.0))


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("row_status").agg(F.count("*").alias("n"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def top_issues(issues: DataFrame, limit: int = 8) -> DataFrame:
    """The most frequent (code, severity, field), ties by first occurrence."""
    first = F.min(F.struct(F.coalesce("row_index", F.lit(-1)).alias("r"), F.col("seq")))
    return issues.groupBy("code", "severity", "field").agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").limit(limit).drop("first")


def fix_for(code: Column, value: Column) -> Column:
    """What a bulk fix would put in place of a value, or null."""
    mail = F.regexp_replace(value, r"\s+", "")
    fixed = let(N.email(mail), lambda r: F.when(r["warning"].isNull(), r["value"]))
    return F.when((code == "email_invalid") & value.rlike(r"\S\s+\S"), fixed)


def bulk_fixes(validated: DataFrame, fields: list[str], countries: DataFrame | None = None, limit: int = 8, per_code: int = 5) -> DataFrame:
    """field, code, value, fixed, n: for the most frequent bad values of each field and code, what would mend them; and residual white space.

    ``countries`` (name, code): unknown countries get the nearest name's code (a score of 80 or more), compared once a distinct value;
    all names and aliases by default.
    """
    validated = written(validated.select(*fields, "issues"))  # it's read three times
    record = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])
    bad = validated.select(record.alias("m"), F.explode("issues").alias("i")).select(F.col("i.field").alias("field"), F.col("i.code").alias("code"), F.element_at("m", F.col("i.field")).alias("value")).where("value is not null")
    counted = bad.groupBy("field", "code", "value").agg(F.count("*").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("field", "code").orderBy(F.desc("n"), "value"))).where(F.col("k") <= per_code).drop("k")
    proposed = top.withColumn("fixed", fix_for(F.col("code"), F.col("value")))
    countries = country_names(validated.sparkSession) if countries is None else countries
    near = nearest_names(top.where("code = 'country_unknown' and length(value) >= 3").select("value").distinct(), countries, 80).withColumnRenamed("code", "near")
    proposed = proposed.join(near, "value", "left").withColumn("fixed", F.coalesce("fixed", F.when(F.col("code") == "country_unknown", F.col("near")))).drop("near")
    cells = validated.select(F.explode(record).alias("field", "value")).where("value is not null")
    spaces = cells.where(~F.col("value").eqNullSafe(N.trim(F.col("value")))).groupBy("field").agg(F.count("*").alias("n")).select("field", F.lit("trim").alias("code"), text().alias("value"), text().alias("fixed"), "n")
    found = proposed.where("fixed is not null and fixed <> value").select("field", "code", "value", "fixed", "n")
    return found.unionByName(spaces).orderBy(F.desc("n"), "field", "code", "value").limit(limit)


def dashboard(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, schema, status, rows) -> one row of counters."""
    return jobs.agg(F.count("*").alias("imports"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "validated").alias("needs_review"), F.count_distinct("schema").alias("schemas"))
