"""Column statistics of a raw table: one row a column.

Columns are unpivoted once; counts, distinct values, examples and the type sample come from one
aggregation over (column, value) and one per-column ranking by first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import strip

EXAMPLES, TYPE_SAMPLE = 5, 500
# Patterns, least shares, and their order.
TYPES: tuple[tuple[str, str, float], ...] = (
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", 0.8),
    ("boolean", r"(?i)^(true|false|yes|no|y|n|1|0)$", 0.95),
    ("url", r"(?i)^https?://", 0.8),
    ("date", r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9}\.? \d{4})([ T]\d{1,2}:\d{2}(:\d{2})?)?$", 0.8),
    ("integer", r"^[+-]?\d{1,18}$", 0.9),
    ("phone", r"^(?=(?:\D*\d){7})\+?[\d\s\-().]{7,20}$", 0.8),
    ("decimal", r"^[+-]?[\d.,\s]*\d[\d.,]*$", 0.9),
    ("country_code", r"^[A-Za-z]{2,3}$", 0.9),
)


def cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(row_index, column, value): the table's cells, one row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return rows.select("row_index", F.explode(pairs).alias("x")).select("row_index", "x.*")


def type_ladder(shares: dict[str, Column], n: Column) -> Column:
    out = F.lit("string")
    for name, _, least in reversed(TYPES):
        out = F.when(shares[name] >= least, F.lit(name)).otherwise(out)
    return F.when(n == 0, F.lit("empty")).otherwise(out)


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, index, total, non_empty_count, empty_pct, distinct_count, unique_pct, is_empty, is_duplicate_header, detected_type, examples.

    Rounding is half-up. The type is guessed on the first 500 non-empty values by row_index. The row ranking is limited within
    each partition first, so a task never holds a column.
    """
    every = cells(rows, columns)
    filled = every.where(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    distinct = filled.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
    counts = distinct.groupBy("column").agg(F.sum("n").alias("non_empty_count"), F.count("*").alias("distinct_count"))
    by_first = Window.partitionBy("column").orderBy("first", "value")
    examples = distinct.withColumn("k", F.row_number().over(by_first)).where(F.col("k") <= EXAMPLES).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("examples"))
    sample = filled.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("row_index"))).where(F.col("k") <= TYPE_SAMPLE)
    shares = sample.groupBy("column").agg(*[F.avg(F.col("value").rlike(p).cast("int")).alias(f"s_{n}") for n, p, _ in TYPES])
    base = F.regexp_replace
    heads = [(i, c) for i, c in enumerate(columns)]
    head = rows.sparkSession.createDataFrame(heads, "index int, column string").withColumn("base", base("column", r" \(\d+\)$", ""))
    head = head.withColumn("is_duplicate_header", F.count("*").over(Window.partitionBy("base")) > 1).drop("base")
    total = rows.agg(F.count("*").alias("total")).first()["total"]
    out = head.join(counts, "column", "left").join(examples, "column", "left").join(shares, "column", "left").withColumn("total", F.lit(total)).withColumns({"non_empty_count": F.coalesce("non_empty_count", F.lit(0)), "distinct_count": F.coalesce("distinct_count", F.lit(0))})
    n, d, t = F.col("non_empty_count"), F.col("distinct_count"), F.col("total")
    return out.select(
        "column", "index", "total", "non_empty_count",
        F.when(t > 0, F.round(F.lit(100.0) * (t - n) / t, 1)).otherwise(100.0).alias("empty_pct"),
        "distinct_count", F.when(n > 0, F.round(F.lit(100.0) * d / n, 1)).otherwise(0.0).alias("unique_pct"),
        (n == 0).alias("is_empty"), "is_duplicate_header",
        type_ladder({k: F.col(f"s_{k}") for k, _, _ in TYPES}, n).alias("detected_type"),
        F.coalesce("examples", F.expr("cast(array() as array<string>)")).alias("examples"),
    )
