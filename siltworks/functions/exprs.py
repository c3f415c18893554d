"""Building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BUILT: dict[tuple, tuple] = {}


def once(key: tuple, build: Callable[[], object]):
    """What ``build`` gives, built once a context: expressions on column names alone serve every table, and building long ones takes thousands of calls to the JVM."""
    context = SparkContext._active_spark_context
    held = _BUILT.get(key)
    if held is None or held[0] is not context:
        if len(_BUILT) > 2000:
            _BUILT.clear()
        held = _BUILT[key] = context, build()
    return held[1]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that's computed once, so that chains of steps stay linear in size.

    (A projection for each step was slower: Spark makes them one method, too long for the JVM to compile.)
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


#: What Unicode calls white space. Trimming these looks at both ends alone; a pattern is tried at each character.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, or null. A long table is one folded map for each first character, as maps are searched key by key."""

    def found(part: dict[str, str]) -> Column:
        keys, values = F.lit("\x01".join(part)), F.lit("\x01".join(part.values()))
        return F.try_element_at(F.map_from_arrays(F.split(keys, "\x01"), F.split(values, "\x01", -1)), key)

    if len(table) <= 64:
        return found(table)
    parts: dict[str, dict[str, str]] = {}
    for k, v in table.items():
        parts.setdefault(k[:1], {})[k] = v

    def choose(first: Column) -> Column:
        out = text()
        for letter, part in parts.items():
            out = F.when(first == letter, found(part)).otherwise(out)
        return out

    return let(F.substring(key, 1, 1), choose)


def normalized(value: Column, warning: Column | None = None) -> Column:
    return F.struct(value.cast("string").alias("value"), (text() if warning is None else warning).cast("string").alias("warning"))


def sealed(rows: DataFrame, *apart: str) -> DataFrame:
    """The same rows, with all columns but those ``apart`` as the fields of one generated struct.

    A filter on a generated column stays above it. Else the optimizer puts it below the projections that made the column and
    repeats their whole chain of expressions in it, once for each use.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in apart]
    return rows.select(*apart, F.explode_outer(F.array(F.struct(*rest))).alias("__row")).select(*apart, "__row.*")
