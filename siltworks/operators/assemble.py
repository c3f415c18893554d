"""From source columns to contract fields: mapping, structure, defaults, manual values, then the field transformations in order.

The result has ``row_index``, one column a field, ``original`` (a struct of each field's first source value),
``notes`` (a map from field to ambiguity code) and ``codes`` (a struct with what the normalizer of a field's type found
wrong, of the fields to which it was the last to be applied). All of it is one narrow projection chain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dimension
from ..functions import normalize as N
from ..functions.exprs import blank_to_null, full_match, is_empty, let, once, strip, text
from ..model import FIELD_KINDS, Contract, TransformSpec

EMPTY_OVERRIDES = "row_index bigint, overrides map<string,string>"


def sources_of(mapping: dict[str, str | None]) -> dict[str, list[str]]:
    """Field to its source columns, in mapping order."""
    out: dict[str, list[str]] = {}
    for source, target in mapping.items():
        if target:
            out.setdefault(target, []).append(source)
    return out


def first_value(columns: list[Column]) -> Column:
    """The first that's neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns]) if columns else text()


def combine(template: str, value_of) -> Column:
    """``{Name}`` parts filled in (null as nothing), white space as single spaces, commas and spaces at the ends dropped; empty is null."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{([^{}]+)\}", template)):
        if i % 2:
            parts.append(F.coalesce(value_of(piece.strip()), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    joined = F.regexp_replace(strip(F.concat(*parts)) if parts else F.lit(""), r"(?U)\s+", " ")
    return blank_to_null(F.regexp_replace(joined, r"^[,\s]+|[,\s]+$", ""))


def split_value(value: Column, into: int, separator: str = " ", mode: str = "first_rest") -> list[tuple[Column, Column]]:
    """For each of ``into`` targets, (whether it's set, its value): first and rest, rest and last, or by position. Empty parts are dropped."""
    parts = F.filter(F.split(value, re.escape(separator), -1), lambda x: x != "")
    n = F.size(parts)
    join = lambda a: blank_to_null(F.array_join(a, separator))
    if mode == "first_rest":
        pieces = [F.get(parts, F.lit(0)), join(F.when(n > 1, F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>")))]
    elif mode == "rest_last":
        pieces = [join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.try_element_at(parts, F.lit(-1))]
    else:
        return [(value.isNotNull() & (n > i), F.get(parts, F.lit(i))) for i in range(into)]
    return [(value.isNotNull(), p) for p in pieces[:into]]


def date_order(rows: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Columns of slashed dates that can only be read day-first (True) or month-first (False) as a whole; one aggregation for all."""
    if not columns:
        return {}
    pattern = r"^\s*(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}"
    aggs = []
    for i, c in enumerate(columns):
        a, b = (F.regexp_extract(F.col(f"`{c}`"), pattern, k).try_cast("int") for k in (1, 2))
        aggs += [F.count_if((a > 12) & (b <= 12)).alias(f"d{i}"), F.count_if((b > 12) & (a <= 12)).alias(f"m{i}")]
    got = rows.agg(*aggs).first()
    return {c: got[f"d{i}"] > 0 for i, c in enumerate(columns) if (got[f"d{i}"] > 0) != (got[f"m{i}"] > 0)}


def infer_date_order(rows: DataFrame, mapping: dict[str, str | None], specs: list[TransformSpec]) -> list[TransformSpec]:
    """The specs, with ``dayfirst`` set on date transformations whose first source column decides it."""
    sources = sources_of(mapping)
    open_ = {s.target: sources[s.target][0] for s in specs if s.enabled and s.kind in ("date", "datetime") and "dayfirst" not in s.params and sources.get(s.target)}
    order = date_order(rows, sorted(set(open_.values())))
    return [TransformSpec(s.kind, s.target, {**s.params, "dayfirst": order[open_[s.target]], "inferred": True}, s.enabled, s.suggested, s.label) if s.target in open_ and s.kind in ("date", "datetime") and open_[s.target] in order else s for s in specs]


def apply(spec: TransformSpec, value: Column, record, code: Column | None = None) -> tuple[Column, Column | None]:
    """One transformation of one field: (new value, ambiguity code or None). ``code``: what a dimension has for the value, or for a phone's country."""
    p, kind = spec.params, spec.kind
    if kind == "default":
        return N.default_value(value, p.get("value")), None
    if kind == "trim":
        return N.trim(value), None
    if kind == "null_normalize":
        return N.null_tokens(value, tuple(p.get("tokens", ()))), None
    if kind == "case":
        return N.case(value, p.get("mode", "title")), None
    if kind == "replace":
        return N.replace_values(value, p.get("mapping", {})), None
    if kind == "phone":
        got = N.phone(value, phone_region(p, record), code) if p.get("country_field") else N.phone(value, p.get("region"))
    elif kind in ("date", "datetime"):
        got = N.BY_TYPE[kind](value, p.get("dayfirst"))
    elif kind in ("country", "currency"):
        got = N.BY_TYPE[kind](value, code)
    else:
        got = N.BY_TYPE[kind](value)
    return got, F.lit("struct")


def phone_region(params: dict, record) -> Column:
    """What a phone's region is told by: the country of its row, else the one given for all."""
    return F.coalesce(blank_to_null(record(params["country_field"])), text(params.get("region")))


def looked_up(rows: DataFrame, spec: TransformSpec, targets: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with a code joined from a dimension for each target of a country, currency or phone transformation, and those columns."""
    codes: dict[str, Column] = {}
    for n in targets:
        if spec.kind == "country":
            rows = dimension.country_codes(rows, F.col(n), f"__met_{n}")
        elif spec.kind == "currency":
            rows = dimension.currency_codes(rows, F.col(n), f"__met_{n}")
        elif spec.kind == "phone" and spec.params.get("country_field"):
            rows = dimension.country_codes(rows, phone_region(spec.params, F.col), f"__met_{n}")
        else:
            continue
        codes[n] = F.col(f"__met_{n}")
    return rows, codes


def transform(rows: DataFrame, contract: Contract, mapping: dict[str, str | None], specs: list[TransformSpec], defaults: dict[str, str] | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """rows (row_index, source columns) -> row_index, fields, original, notes, codes.

    ``overrides``: (row_index, overrides map<string,string>) of manual values, which the transformations still run on; a null value is one.
    """
    names, sources = contract.names, sources_of(mapping)
    columns = set(rows.columns)
    specs = [s for s in specs if s.enabled]
    value = {n: first_value([F.col(f"`{s}`") for s in sources.get(n, []) if s in columns]) for n in names}
    firsts = [(F.col(f"`{sources[n][0]}`") if sources.get(n) and sources[n][0] in columns else text()).cast("string").alias(n) for n in names]

    def cell_first(key: str) -> Column:
        return F.coalesce(F.col(f"`{key}`"), value.get(key, text())) if key in columns else value.get(key, text())

    for s in specs:
        if s.kind == "combine" and s.target in value:
            value[s.target] = combine(s.params.get("template", ""), cell_first)
        elif s.kind == "split":
            source, into = s.params.get("source"), s.params.get("into", [])
            whole = value[source] if source in value else F.col(f"`{source}`") if source in columns else text()
            for target, (sets, piece) in zip(into, split_value(whole, len(into), s.params.get("separator", " "), s.params.get("mode", "first_rest")), strict=False):
                if target in value:
                    value[target] = F.when(sets, piece).otherwise(value[target])
    for n, v in (defaults or {}).items():
        if n in value:
            value[n] = N.default_value(value[n], v)
    out = rows.select("row_index", *[value[n].cast("string").alias(n) for n in names], F.struct(*firsts).alias("original"))
    if overrides is not None:
        out = out.join(overrides.select("row_index", "overrides"), "row_index", "left")
        out = out.select("row_index", *[F.when(F.coalesce(F.map_contains_key("overrides", F.lit(n)), F.lit(False)), F.element_at("overrides", F.lit(n))).otherwise(F.col(n)).alias(n) for n in names], "original")
    noted: dict[str, str] = {}
    judged: dict[str, str] = {}
    kinds = {f.name: f.type for f in contract.fields}
    for s in (s for s in specs if s.kind in FIELD_KINDS):
        targets = [n for n in ([s.target] if s.target else names) if n in names]
        structs: list[str] = []
        out, codes = looked_up(out, s, targets)

        def built(s=s, targets=targets, structs=structs, codes=codes) -> dict[str, Column]:
            step = {}
            for n in targets:
                got, is_struct = once(("apply", repr(s), n, n in codes), lambda n=n: apply(s, F.col(n), F.col, codes.get(n)))
                step[n if is_struct is None else f"__{n}"] = got
                structs += [] if is_struct is None else [n]
            return step

        out = out.withColumns(built())
        judged = {n: c for n, c in judged.items() if n not in targets}
        step = {}
        for n in structs:
            step[n] = F.col(f"__{n}.value")
            doubt = F.when(F.col(f"__{n}.warning").endswith("_ambiguous"), F.col(f"__{n}.warning"))
            step[f"__note_{n}"] = F.coalesce(doubt, F.col(f"__note_{n}")) if n in noted else doubt
            noted[n] = f"__note_{n}"
            if s.kind == kinds[n]:
                step[f"__code_{n}"] = F.when(~F.coalesce(F.col(f"__{n}.warning").endswith("_ambiguous"), F.lit(False)), F.col(f"__{n}.warning"))
                judged[n] = f"__code_{n}"
        if structs:
            out = out.withColumns(step).drop(*[f"__{n}" for n in structs], *[f"__met_{n}" for n in codes])
    entries = [F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in noted.items()]
    notes = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries else F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))")
    codes = F.struct(*[F.col(c).cast("string").alias(n) for n, c in judged.items()]) if judged else F.lit(None).cast("struct<>")
    return out.select("row_index", *names, "original", notes.alias("notes"), codes.alias("codes"))


__all__ = ["apply", "combine", "date_order", "first_value", "full_match", "infer_date_order", "is_empty", "let", "sources_of", "split_value", "transform"]
