"""Predicates to issues. One pass builds each row's array of issues; only uniqueness needs a shuffle, one a unique field.

Issue: row_index (null: the data set), seq (a fixed order within a row), field, severity, code, message, original_value.
"""

from __future__ import annotations

import functools
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dimension
from ..functions import normalize as N
from ..functions.exprs import full_match, is_empty, let, lookup, once, sealed, text
from ..model import ERROR, INFO, WARNING, Contract, FieldSpec

# Severity and message of each type code.
TYPE_ISSUES = {
    "email_invalid": (ERROR, "Invalid email"),
    "phone_invalid": (ERROR, "Invalid phone number"),
    "phone_unparseable": (WARNING, "Could not normalize phone"),
    "country_unknown": (WARNING, "Unknown country"),
    "currency_unknown": (WARNING, "Unknown currency"),
    "currency_ambiguous": (WARNING, "Ambiguous currency symbol"),
    "boolean_invalid": (ERROR, "Invalid boolean"),
    "decimal_invalid": (ERROR, "Invalid decimal"),
    "decimal_ambiguous": (WARNING, "Ambiguous decimal separator"),
    "integer_invalid": (ERROR, "Invalid integer"),
    "date_invalid": (ERROR, "Invalid date"),
    "date_ambiguous": (WARNING, "Ambiguous date (day/month order assumed)"),
    "datetime_invalid": (ERROR, "Invalid date-time"),
    "url_invalid": (ERROR, "Invalid URL"),
}
ISSUE = "struct<seq:int,field:string,severity:string,code:string,message:string,original_value:string>"
NO_ISSUES = f"cast(array() as array<{ISSUE}>)"
RANK = {ERROR: 2, WARNING: 1, INFO: 0}


def issue(seq: int, field: str | None, severity, code, message, original: Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(seq).cast("int").alias("seq"), F.lit(field).cast("string").alias("field"), as_col(severity).alias("severity"), as_col(code).alias("code"), as_col(message).alias("message"), original.cast("string").alias("original_value"))


def type_code(kind: str, value: Column, found: Column | None = None) -> Column:
    """The code of what's wrong with a value of a type, or null; ambiguities were told before, and a country must be its code. ``found``: what a country's or currency's dimension has for it."""
    if kind not in N.BY_TYPE:
        return text()

    def judge(r: Column) -> Column:
        code = F.when(~F.coalesce(r["warning"].endswith("_ambiguous"), F.lit(False)), r["warning"])
        return F.when(r["warning"].isNull() & (value != r["value"]), F.lit("country_unknown")).otherwise(code) if kind == "country" else code

    return let(N.BY_TYPE[kind](value) if found is None else N.BY_TYPE[kind](value, found), judge)


def _by_code(code: Column, i: int) -> Column:
    return lookup({k: v[i] for k, v in TYPE_ISSUES.items()}, code)


_PLAIN = re.compile(r"([+-]?)0*(\d*)(?:\.(\d*?)0*)?")


def compared(v: Column, bound: str) -> Column:
    """-1, 0 or 1 as a plain decimal text is below, at or above a bound; null where it's no such text. By digits, so of any size and scale."""
    minus, whole, rest = _PLAIN.fullmatch(format(Decimal(bound), "f")).groups()
    whole, rest = whole or "", rest or ""
    order = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)

    def digits(v: Column) -> Column:
        return F.struct(v.alias("v"), F.regexp_extract(v, r"^[+-]?0*(\d*)", 1).alias("w"), F.regexp_extract(v, r"\.(\d*?)0*$", 1).alias("r"))

    def judge(x: Column) -> Column:
        w, r = x["w"], x["r"]
        size = F.when(F.length(w) != len(whole), order(F.length(w), F.lit(len(whole)))).when(w != whole, order(w, F.lit(whole))).otherwise(order(r, F.lit(rest)))
        zero = (w == "") & (r == "")
        negative = x["v"].startswith("-") & ~zero
        if not whole and not rest:
            return F.when(zero, 0).when(negative, -1).otherwise(1)
        if minus == "-":
            return F.when(negative, -size).otherwise(1)
        return F.when(negative, -1).otherwise(size)

    return F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), let(digits(v), judge))


def rule_checks(f: FieldSpec, v: Column) -> list[tuple[Column, str, str]]:
    """(fails, code, message) of a field's rules, in their fixed order."""
    r, out = f.rules or {}, []
    if "min_length" in r:
        out.append((F.length(v) < int(r["min_length"]), "min_length", f"Shorter than {r['min_length']} characters"))
    if "max_length" in r:
        out.append((F.length(v) > int(r["max_length"]), "max_length", f"Longer than {r['max_length']} characters"))
    if r.get("regex") and _compiles(r["regex"]):
        out.append((~full_match(v, r["regex"]), "regex", "Does not match the required pattern"))
    if r.get("enum"):
        allowed = [str(a) for a in r["enum"]]
        out.append((~F.lower(v).isin(*[a.lower() for a in allowed]), "enum", f"Value not in allowed list ({', '.join(allowed[:6])})"))
    if f.type in ("integer", "decimal"):
        for key, sign, word in (("min", -1, "Below minimum"), ("max", 1, "Above maximum")):
            if key in r:
                out.append((compared(v, str(r[key])) == sign, key, f"{word} {r[key]}"))
    if f.type in ("date", "datetime"):
        d = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
        for key, fails, word in (("min_date", lambda b: d < b, "Earlier than"), ("max_date", lambda b: d > b, "Later than")):
            if r.get(key):
                out.append((fails(F.lit(r[key]).cast("date")), key, f"{word} {r[key]}"))
    return out


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _comparable(v: Column) -> Column:
    """(days, number): a date where the text is one, else a decimal."""
    day = F.when(F.length(v) >= 10, F.try_to_date(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(v, 1, 10)), "yyyy-MM-dd"))
    return F.struct(day.alias("day"), F.when(day.isNull(), v.try_cast("decimal(38,10)")).alias("number"))


_COMPARE = {"gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b}


def clause(c: dict, value_of) -> Column:
    """Whether a rule's clause holds. Comparisons with a missing operand, or of a date with a number, hold; so do unknown operators."""
    op, expected, v = c.get("op", "eq"), c.get("value"), value_of(c.get("field"))
    if op in ("eq", "neq"):
        same = F.coalesce(v, F.lit("None")) == F.lit(str(expected))
        return same if op == "eq" else ~same
    if op == "in":
        return F.coalesce(v.isin(*[str(x) for x in expected]), F.lit(False)) if expected else F.lit(False)
    if op in ("empty", "not_empty"):
        return is_empty(v) if op == "empty" else ~is_empty(v)
    if op == "phone_region":
        return F.coalesce(N.phone_region(v) == str(expected).upper(), F.lit(True))
    base = op.removesuffix("_field")
    if base not in _COMPARE:
        return F.lit(True)
    other = value_of(expected) if op.endswith("_field") else F.lit(str(expected))
    present = ~is_empty(v) & ~is_empty(other)

    def both(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.coalesce(_COMPARE[base](a["day"], b["day"]), _COMPARE[base](a["number"], b["number"]), F.lit(True))

    return F.when(present, let(F.struct(_comparable(v).alias("a"), _comparable(other).alias("b")), both)).otherwise(F.lit(True))


def counted_duplicates(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(F.col(field).alias(f"__v_{field}")).agg(F.count_if(~is_empty(F.col(field))).alias("n")).where("n > 1")


def duplicates(rows: DataFrame, field: str) -> DataFrame:
    """The non-empty values that occur more than once."""
    return counted_duplicates(rows, field).drop("n")


def value_counts(rows: DataFrame, contract: Contract) -> DataFrame:
    """(field, value, n): how many rows have each value of each unique field; empty ones don't count. One pass."""
    unique = [f.name for f in contract.fields if f.unique]
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in unique]) if unique else F.expr("cast(array() as array<struct<field:string,value:string>>)")
    return rows.select(F.explode(each).alias("c")).select("c.*").where(~is_empty(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("n"))


def validate(rows: DataFrame, contract: Contract, provided: set[str], counts: DataFrame | None = None) -> DataFrame:
    """rows as ``transform`` gives them -> the same with ``issues`` (an array) and ``row_status``.

    ``provided``: fields that a column, a structure or a default fills; a required field outside them is one issue of the data set.
    ``counts`` (field, value, n): how often the rows' values of unique fields occur in the whole table, if these are some of its rows.
    """
    out = rows
    for f in contract.fields:
        if f.unique:
            out = with_duplicates(out, rows, f.name) if counts is None else counted(out, counts, f.name)
    known = rows.schema["codes"].dataType.names if "codes" in rows.columns else []
    met = [f for f in contract.fields if f.type in ("country", "currency") and f.name not in known]
    for f in met:
        out = (dimension.country_codes if f.type == "country" else dimension.currency_codes)(out, F.col(f.name), f"__met_{f.name}")
    out = out.withColumn("issues", once(("issues", repr(contract), tuple(sorted(provided)), tuple(known)), lambda: _issues(contract, provided, known)))
    out = out.drop("codes", *[f"__dup_{f.name}" for f in contract.fields if f.unique], *[f"__met_{f.name}" for f in met])
    return sealed(out, "row_index").withColumn("row_status", status(F.col("issues")))


def counted(out: DataFrame, counts: DataFrame, field: str) -> DataFrame:
    """``out`` with a flag on the rows whose value of a field is counted more than once."""
    again = counts.where((F.col("field") == field) & (F.col("n") > 1)).select(F.col("value").alias("__value"), F.lit(True).alias(f"__dup_{field}"))
    return out.join(again, F.when(~is_empty(F.col(field)), F.col(field)) == F.col("__value"), "left").drop("__value")


def with_duplicates(out: DataFrame, rows: DataFrame, field: str, most: int = 500, parts: int = 997) -> DataFrame:
    """``out`` with a flag on the rows whose value of a field repeats in ``rows``.

    The ``most`` most frequent values are sent to the rows; the others meet them by a shuffle, in which rows without a value
    to look for are dealt to ``parts`` keys of their own. So no value's rows, nor the empty ones, are one task's.
    """
    again = counted_duplicates(rows, field)
    often = again.orderBy(F.desc("n")).limit(most).select(F.col(f"__v_{field}").alias("__often"), F.lit(True).alias("__hot"))
    out = out.join(F.broadcast(often), F.when(~is_empty(F.col(field)), F.col(field)) == F.col("__often"), "left")
    rest = again.select(f"__v_{field}", F.lit(0).alias("__part"), F.lit(True).alias("__rest"))
    key = F.when(F.col("__hot").isNull() & ~is_empty(F.col(field)), F.col(field))
    part = F.when(key.isNull(), F.pmod(F.xxhash64("row_index"), F.lit(parts)).cast("int")).otherwise(0)
    out = out.join(rest, (key == F.col(f"__v_{field}")) & (part == F.col("__part")), "left")
    return out.withColumn(f"__dup_{field}", F.coalesce("__hot", "__rest")).drop("__often", "__hot", "__rest", "__part", f"__v_{field}")


#: Numbers of a field's issues in the order of a row's.
PLACES = 12


def _duplicate(f: FieldSpec, seq: int) -> Column:
    return F.when(~is_empty(F.col(f.name)) & F.col(f"__dup_{f.name}"), issue(seq + 1, f.name, ERROR, "duplicate", "Duplicate value", F.col("original")[f.name]))


def recounted(validated: DataFrame, contract: Contract, counts: DataFrame) -> DataFrame:
    """Validated rows of which nothing has changed but how often their values of unique fields occur: ``counts`` (field, value, n) tells."""
    out = validated
    for f in contract.fields:
        if f.unique:
            out = counted(out, counts, f.name)
    again = F.array(*[_duplicate(f, PLACES * i) for i, f in enumerate(contract.fields) if f.unique])
    issues = F.sort_array(F.concat(F.filter("issues", lambda i: i["code"] != "duplicate"), F.filter(again, lambda i: i.isNotNull())))
    return out.withColumn("issues", issues).withColumn("row_status", status(F.col("issues"))).select(*validated.columns)


def _issues(contract: Contract, provided: set[str], known: list[str]) -> Column:
    """A row's issues, in the order of seq; ``known``: fields of which the struct ``codes`` has the type's code."""
    seq, parts, lists = 0, [], []
    for f in contract.fields:
        v, original = F.col(f.name), F.col("original")[f.name]
        empty = is_empty(v)
        if f.required and (f.name in provided or f.default not in (None, "")):
            parts.append(F.when(empty, issue(seq, f.name, ERROR, "required_missing", "Missing required value", original)))
        if f.unique:
            parts.append(_duplicate(f, seq))
        checks = rule_checks(f, v)
        if f.type in N.BY_TYPE:

            def of_type(code: Column, f=f, v=v, original=original, checks=checks, seq=seq) -> Column:
                bad = issue(seq + 2, f.name, _by_code(code, 0), code, _by_code(code, 1), F.coalesce(original, v))
                rules = [F.when(fails, issue(seq + 3 + k, f.name, ERROR, c, m, original)) for k, (fails, c, m) in enumerate(checks)]
                return F.when(code.isNotNull(), F.array(bad)).otherwise(F.array(*rules) if rules else F.expr(NO_ISSUES))

            lists.append(F.when(~empty, let(F.col("codes")[f.name] if f.name in known else type_code(f.type, v, F.col(f"__met_{f.name}") if f.type in ("country", "currency") else None), of_type)))
        else:
            parts += [F.when(~empty & fails, issue(seq + 3 + k, f.name, ERROR, c, m, original)) for k, (fails, c, m) in enumerate(checks)]
        seq += PLACES
    value_of = lambda n: F.col(n) if n in contract.names else text()
    for rule in contract.rules:
        then = rule.get("then")
        if then:
            v = value_of(then.get("field"))
            fails = ~is_empty(v) & ~clause(then, value_of)
            if rule.get("when"):
                fails &= clause(rule["when"], value_of)
            message = rule.get("message") or f"Rule failed: {then.get('field')} {then.get('op')} {then.get('value')}"
            parts.append(F.when(fails, issue(seq, then.get("field"), rule.get("severity", WARNING), "cross_field", message, v)))
        seq += 1
    for f in contract.fields:
        def of_note(code: Column, f=f, seq=seq) -> Column:
            return F.when(code.isNotNull(), issue(seq, f.name, _by_code(code, 0), code, _by_code(code, 1), F.col(f.name)))

        parts.append(let(F.try_element_at("notes", F.lit(f.name)), of_note))
        seq += 1
    arrays = lists + ([F.array(*parts)] if parts else [])
    # seq is the order, and first in the struct
    return F.sort_array(F.filter(F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull())), lambda i: i.isNotNull())) if arrays else F.expr(NO_ISSUES)


def status(issues: Column) -> Column:
    """The worst severity's status; INFO leaves a row ready."""
    worst = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    return F.when(worst(ERROR), F.lit("error")).when(worst(WARNING), F.lit("warning")).otherwise(F.lit("ready"))


def issue_rows(validated: DataFrame, *, severity: str | None = None, field: str | None = None, code: str | None = None) -> DataFrame:
    """The issues as rows; filters are put on the array, below the explode."""
    given = [(n, v) for n, v in (("severity", severity), ("field", field), ("code", code)) if v is not None]
    wanted = F.filter("issues", lambda i: functools.reduce(lambda a, g: a & (i[g[0]] == g[1]), given, F.lit(True))) if given else F.col("issues")
    return validated.select("row_index", F.explode(wanted).alias("i")).select("row_index", "i.*")


def dataset_issues(spark: SparkSession, contract: Contract, provided: set[str]) -> DataFrame:
    """One row for each required field that nothing provides and that has no default."""
    missing = [(None, -1, f.name, ERROR, "required_field_unmapped", f'Required field "{f.display_name or f.name}" is not mapped to any column', None) for f in contract.fields if f.required and f.name not in provided and f.default in (None, "")]
    return spark.createDataFrame(missing, "row_index long, seq int, field string, severity string, code string, message string, original_value string")


def all_issues(validated: DataFrame, contract: Contract, provided: set[str]) -> DataFrame:
    return dataset_issues(validated.sparkSession, contract, provided).unionByName(issue_rows(validated))
