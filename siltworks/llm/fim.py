"""Fill-in-middle transformation by lookaround splitting, in built-in functions only.

A unit grammar is told by the borders between its units: pairs of neighbouring character classes. Each becomes a regex of
zero width, a lookbehind for the class before and a lookahead for the class after, so a split at it loses no character and every
unit ends where the next begins. The empty text has no border and no unit, though a split of it gives one empty piece.

A document's digest draws two cuts among its units and the form of its output.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each unit the classes before and after its borders. Equal to the units that the regex beside it matches, from left to right.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "char": [(r"[\s\S]", r"[\s\S]")],  # [\s\S]
    "line": [(r"\n", r"[\s\S]")],  # [^\n]*\n|[^\n]+
    "word": [(r"\s", r"\S")],  # \S*\s+|\S+
    "paragraph": [(r"\n\n", r"[^\n]")],  # [\s\S]*?\n{2,}|[\s\S]+
    "token": [(r"[A-Za-z]", r"[^A-Za-z]"), (r"[0-9]", r"[^0-9]"), (r"\s", r"\S"), (r"[^A-Za-z0-9\s]", r"[\s\S]")],  # [A-Za-z]+|[0-9]+|\s+|[\s\S]
}
SENTINELS = ("<P>", "<S>", "<M>")


def boundary(pairs: Sequence[tuple[str, str]]) -> str:
    """The regex of zero width that matches between the classes of any pair; a class before must be of fixed length."""
    return "|".join(f"(?<={before})(?={after})" for before, after in pairs)


def pieces(text: Column, unit: str | Sequence[tuple[str, str]] = "line") -> Column:
    """The units of a text, array<string>, which joined are the text; none for the empty text, null for null."""
    pairs = GRAMMARS[unit] if isinstance(unit, str) else unit
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(pairs)))


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels must be told apart wherever they stand: none is empty, within another, or begins as one ends."""
    p, s, m = sentinels
    for a in sentinels:
        for b in sentinels:
            if not a or any(a.endswith(b[:n]) for n in range(1, len(b))) or (a != b and a in b):
                raise ValueError("sentinels must not be empty or overlap")
    if len({p, s, m}) < 3:
        raise ValueError("sentinels must differ")
    return p, s, m


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight digits of the sha256 of ``seed:doc_id``, as longs; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def transform(docs: DataFrame, unit: str | Sequence[tuple[str, str]] = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n, form, prefix, middle, suffix, output; a row for each row.

    n: number of units. Of the two cuts, drawn from 0 to n, the smaller ends the prefix and the larger the middle. ``form`` is
    plain for the empty text, for a text that holds a sentinel, and for all but ``percent`` of a hundred documents, by the third
    draw; else spm (suffix first) for ``spm_percent`` of a hundred by the fourth, else psm. A plain output is the text, and
    has no parts (null).

    A null text is empty. Rows of one doc_id are cut by the same draws, equal rows alike; a null doc_id has its own. Texts of any
    length are cut whole, within their row. Other columns are left out, so their names can't clash. An empty table gives none.
    """
    p, s, m = _checked(sentinels)
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", pieces(text, unit).alias("units"), F.array(*draws(F.col("doc_id"), seed)).alias("h"))
    n = F.size("units")
    cuts = [F.col("h")[k] % (n + 1) for k in (0, 1)]
    held = text.contains(p) | text.contains(s) | text.contains(m)
    form = F.when((text == "") | held | (F.col("h")[2] % 100 >= percent), "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, size), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("doc_id", "n", "form", "text", part(F.lit(0), a).alias("prefix"), part(a, b - a).alias("middle"), part(b, F.size("units") - b).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The exact text, from an output and its form alone."""
    parts = F.split(output, "|".join(re.escape(x) for x in _checked(sentinels)))  # nothing before the first sentinel
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(order)
