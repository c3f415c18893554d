"""Reference names as small tables, met by broadcast joins.

A cell meets a table on one key, so a country or a currency costs one hash lookup a row and a few lines of plan. The
tables grow with the ISO lists and never with the data: some 8 000 keys of countries and parts of their names, 500 keys of
currencies.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata
from .exprs import strip


def name_key(c: Column) -> Column:
    """``refdata.name_key`` of a column."""
    plain = F.translate(F.lower(strip(c)), "".join(refdata.PLAIN_LETTERS), "".join(refdata.PLAIN_LETTERS.values()))
    return F.regexp_replace(plain, r"^[. ]+|[. ]+$", "")


def _table(spark: SparkSession, pairs: dict[str, str], *names: str) -> DataFrame:
    return spark.createDataFrame(pa.table([list(pairs), list(pairs.values())], names=list(names)))


def country_names(spark: SparkSession) -> DataFrame:
    """(name, code) of every country's names and aliases; codes aren't names, as they're near to each other."""
    return _table(spark, dict(sorted(refdata.country_names().items())), "name", "code")


def countries(spark: SparkSession) -> DataFrame:
    """(key, code): codes, names, aliases, and parts of names that only one country's hold."""
    return _table(spark, refdata.country_keys(), "key", "code")


def currencies(spark: SparkSession) -> DataFrame:
    """(key, code): codes, names, symbols and words, lower case; an empty code is ambiguous."""
    return _table(spark, refdata.currencies(), "key", "code")


def met(rows: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
    """The rows with the code of a key in a table of fixed size as a column; null where it isn't there. Every key of the table stands once, so rows stay as many."""
    return rows.join(F.broadcast(table.select(F.col("key").alias("__key"), F.col("code").alias(name))), key == F.col("__key"), "left").drop("__key")


def country_codes(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return met(rows, countries(rows.sparkSession), name_key(value), name)


def currency_codes(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return met(rows, currencies(rows.sparkSession), F.lower(strip(value)), name)
