"""From source columns to contract fields: a ladder of saved, exact, normalized, alias, fuzzy and type matches, first hit wins.

Keys and the equal-key levels are joins, so the headers of many files are mapped together; the fuzzy scorer
is a pandas UDF over (header, name) pairs, of which there are as many as headers times names of a contract.
The greedy assignment is per file and bounded by its headers and the contract's fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MappingError
from ..functions.exprs import strip
from ..model import Contract
from . import similarity

HIGH, MEDIUM, LOW, UNMAPPED = "HIGH", "MEDIUM", "LOW", "UNMAPPED"
# Words without meaning in headers, score thresholds, and field types that a detected type suits.
NOISE_WORDS = ("the", "of", "a", "an", "no", "num", "number", "nr", "col", "column", "field")
FUZZY_MEDIUM, FUZZY_LOW, TEMPLATE_LEAST = 88, 72, 0.8
COMPATIBLE = {
    "email": ("email",), "phone": ("phone",), "date": ("date", "datetime"), "boolean": ("boolean",), "url": ("url",),
    "integer": ("integer", "decimal", "string"), "decimal": ("decimal",), "country_code": ("country", "currency", "enum", "string"),
}
#: Detected types that say enough to map a column by type alone.
DISTINCTIVE = ("email", "phone", "date", "boolean", "url")


def header_key(name: Column) -> Column:
    """Lower case, letters and digits only (Latin, Cyrillic, Hebrew, Arabic), without noise words unless nothing else is left."""
    spaced = F.regexp_replace(F.lower(strip(name)), r"[\s_\-./\\()\[\]:#'\"]+", " ")
    kept = F.regexp_replace(spaced, "[^a-z0-9а-яё֐-׿؀-ۿ ]+", "")
    words = F.filter(F.split(strip(kept), r"\s+"), lambda w: (w != "") & ~w.isin(*NOISE_WORDS))
    return F.when(F.size(words) > 0, F.array_join(words, "")).otherwise(F.regexp_replace(kept, r"\s+", ""))


def dedupe_headers(headers: DataFrame) -> DataFrame:
    """headers (pos from 0, name) -> pos, name: stripped, blank as ``Column N``, repeats as ``name (2)``, ``name (3)``."""
    named = headers.select("pos", F.when(F.coalesce(strip(F.col("name")), F.lit("")) == "", F.concat(F.lit("Column "), (F.col("pos") + 1).cast("string"))).otherwise(strip(F.col("name"))).alias("name"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    return named.withColumn("k", k).select("pos", F.when(F.col("k") > 1, F.concat("name", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"))


def target_names(spark, contract: Contract) -> DataFrame:
    """(target, ordinal, type, multiple, level, priority, name, key): each field under its name, display name and aliases."""
    rows = []
    for i, f in enumerate(contract.fields):
        for level, priority, name in [("exact", 1, f.name), ("normalized", 2, f.display_name), ("normalized", 2, f.name.replace("_", " ")), *[("alias", 3, a) for a in f.aliases]]:
            if name:
                rows.append((f.name, i, f.type, f.allow_multiple_sources, level, priority, name))
    return spark.createDataFrame(rows, "target string, ordinal int, type string, multiple boolean, level string, priority int, name string").withColumn("key", header_key(F.col("name")))


def by_key(sources: DataFrame, names: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """sources (source, ordinal, detected) -> (source, target, confidence, method) of those that a saved pair, or an equal key, decides."""
    keyed = sources.select("source", F.col("ordinal").alias("at"), header_key(F.col("source")).alias("key"))
    hits = keyed.join(names, "key").select("source", "target", F.col("level").alias("method"), "priority", "ordinal")
    if memory is not None:
        known = memory.select(F.col("key").alias("mkey"), "target")
        saved = keyed.join(known, F.col("key") == F.col("mkey")).unionByName(keyed.join(known, F.col("source") == F.col("mkey"))).join(names.select("target", "ordinal").distinct(), "target")
        hits = hits.unionByName(saved.select("source", "target", F.lit("saved").alias("method"), F.lit(0).alias("priority"), "ordinal"))
    best = Window.partitionBy("source").orderBy("priority", "ordinal", "target")
    return hits.withColumn("k", F.row_number().over(best)).where("k = 1").select("source", "target", F.lit(HIGH).alias("confidence"), "method")


def fuzzy_scores(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(source, at, target, ordinal, multiple, score): the best name's score, 6 more for a type that suits (100 at most), 15 less for one that doesn't."""
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    # each header meets the names of one contract, which are a literal of the plan
    held = names.select("target", "ordinal", "type", "multiple", "name").collect()
    each = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("target", "ordinal", "type", "multiple", "name")]) for r in held])
    pairs = sources.select("source", F.col("ordinal").alias("at"), "detected", F.explode(each).alias("to")).select("source", "at", "detected", "to.*")
    scored = pairs.withColumn("s", similarity.best_score(spaced(F.col("source")), spaced(F.col("name")))).groupBy("source", "at", "detected", "target", "ordinal", "type", "multiple").agg(F.max("s").alias("s"))
    suits, known = F.lit(False), F.col("detected").isin(*COMPATIBLE)
    for detected, types in COMPATIBLE.items():
        suits = suits | ((F.col("detected") == detected) & F.col("type").isin(*types))
    adjusted = F.when(suits, F.least(F.col("s") + 6, F.lit(100.0))).when(known & ~F.col("type").isin("string", "enum"), F.col("s") - 15).otherwise(F.col("s"))
    return scored.select("source", "at", "target", "ordinal", "multiple", "type", "detected", adjusted.alias("score"))


Provider = Callable[[list[dict], list[dict]], dict[str, tuple[str, str]]]


def suggest(sources: DataFrame, contract: Contract, memory: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """sources (source, ordinal, detected) of one file -> (source, target, confidence, method, ordinal, confirmed), every source once, in order; what's sure (HIGH) counts as confirmed.

    ``provider``: an optional callable from unresolved sources and free targets to {source: (target, high or other)}; its errors
    and unknown targets are ignored.
    """
    spark = sources.sparkSession
    names = target_names(spark, contract)
    done = {r["source"]: (r["target"], r["confidence"], r["method"]) for r in by_key(sources, names, memory).collect()}  # a row a header
    multiple = {f.name for f in contract.fields if f.allow_multiple_sources}
    taken = {t for t, _, _ in done.values()}
    headers = {r["source"]: r for r in sources.collect()}
    open_ = sources.where(~F.col("source").isin(*done)) if done else sources
    scores = sorted(fuzzy_scores(open_, names).where(F.col("score") >= FUZZY_LOW).collect(), key=lambda r: (-r["score"], r["at"], r["ordinal"]))
    for r in scores:
        if r["source"] not in done and (r["target"] not in taken or r["target"] in multiple):
            done[r["source"]] = (r["target"], MEDIUM if r["score"] >= FUZZY_MEDIUM else LOW, "fuzzy")
            taken.add(r["target"])
    for s, r in sorted(headers.items(), key=lambda x: x[1]["ordinal"]):
        fits = [f.name for f in contract.fields if f.type in COMPATIBLE.get(r["detected"], ()) and f.name not in taken]
        if s not in done and r["detected"] in DISTINCTIVE and len(fits) == 1:
            done[s] = (fits[0], LOW, "type")
            taken.add(fits[0])
    left = [s for s in headers if s not in done]
    if provider and left:
        free = [f for f in contract.fields if f.name not in taken]
        try:
            answers = provider([{"name": s, "detected": headers[s]["detected"]} for s in left], [{"name": f.name, "type": f.type} for f in free])
        except Exception:
            answers = {}
        for s, (target, sure) in answers.items():
            if s in left and target in {f.name for f in free} - taken:
                done[s] = (target, MEDIUM if sure == "high" else LOW, "ai")
                taken.add(target)
    rows = [(s, *(d := done.get(s, (None, UNMAPPED, "none"))), r["ordinal"], d[1] == HIGH) for s, r in headers.items()]
    return spark.createDataFrame(rows, "source string, target string, confidence string, method string, ordinal int, confirmed boolean").orderBy("ordinal")


def conflicts(mapping: DataFrame, contract: Contract) -> DataFrame:
    """(target, sources): fields with more than one source that may have only one."""
    several = mapping.where("target is not null").groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources")).where(F.size("sources") > 1)
    allowed = [f.name for f in contract.fields if f.allow_multiple_sources]
    return several.where(~F.col("target").isin(*allowed)) if allowed else several


def confirm(mapping: DataFrame, manual: dict[str, str | None], contract: Contract) -> DataFrame:
    """The mapping with manual targets put in; unknown sources and targets and conflicts are errors."""
    spark = mapping.sparkSession
    known = {r["source"] for r in mapping.select("source").collect()}
    if unknown := [s for s in manual if s not in known] + [t for t in manual.values() if t and t not in contract.names]:
        raise MappingError(f"unknown: {', '.join(unknown)}")
    if manual:
        given = spark.createDataFrame([(s, t) for s, t in manual.items()], "source string, given string").withColumn("set", F.lit(True))
        merged = mapping.join(F.broadcast(given), "source", "left")
        pick = lambda a, b: F.when(F.col("set"), a).otherwise(b)
        mapping = merged.select("source", pick(F.col("given"), F.col("target")).alias("target"), pick(F.when(F.col("given").isNull(), UNMAPPED).otherwise(HIGH), F.col("confidence")).alias("confidence"), pick(F.lit("manual"), F.col("method")).alias("method"), "ordinal", *[pick(F.lit(True), F.col(c)).alias(c) for c in mapping.columns if c == "confirmed"])
    if clash := conflicts(mapping, contract).collect():
        raise MappingError("; ".join(f"{r['target']}: {', '.join(r['sources'])}" for r in clash))
    return mapping


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of header keys; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def detect_template(headers: DataFrame, templates: DataFrame, least: float = TEMPLATE_LEAST) -> DataFrame:
    """headers (job_id, schema, keys), templates (template_id, schema, keys) -> (job_id, template_id, score): the nearest of the schema, the first of equals."""
    scored = headers.join(templates.select("template_id", "schema", F.col("keys").alias("tkeys")), "schema").withColumn("score", jaccard(F.col("keys"), F.col("tkeys"))).where(F.col("score") >= least)
    return scored.groupBy("job_id").agg(F.max_by("template_id", F.struct("score", -F.col("template_id"))).alias("template_id"), F.max("score").alias("score"))


def apply_template(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """sources (source, ordinal), pairs (key, target) of a template -> the mapping by header key."""
    joined = sources.withColumn("key", header_key(F.col("source"))).join(pairs, "key", "left")
    return joined.select("source", "target", F.when(F.col("target").isNull(), UNMAPPED).otherwise(HIGH).alias("confidence"), F.lit("template").alias("method"), "ordinal")


def merge_template(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """mapping (source, target, confidence, method, ordinal, confirmed), pairs (key, target) of a template, of which a key stands once -> the mapping with the template's targets, confirmed, where a header's key is one of its own; a null target ignores the source. Others stay."""
    known = pairs.select(F.col("key").alias("__key"), F.col("target").alias("__target"))
    joined = mapping.join(known, header_key(F.col("source")) == F.col("__key"), "left")
    pick = lambda new, name: F.when(F.col("__key").isNotNull(), new).otherwise(F.col(name)).alias(name)
    return joined.select("source", pick(F.col("__target"), "target"), pick(F.when(F.col("__target").isNull(), UNMAPPED).otherwise(HIGH), "confidence"), pick(F.lit("template"), "method"), "ordinal", pick(F.lit(True), "confirmed"))


def remember(memory: DataFrame, confirmed: DataFrame) -> DataFrame:
    """memory (schema, key, target, hits), confirmed (schema, source, target) -> memory: a repeated target counts one more hit, another one starts at 1."""
    new = confirmed.where("target is not null").select("schema", header_key(F.col("source")).alias("key"), F.col("target").alias("new")).dropDuplicates(["schema", "key"])
    merged = memory.join(new, ["schema", "key"], "full")
    hits = F.when(F.col("new").isNull(), F.col("hits")).when(F.col("target") == F.col("new"), F.col("hits") + 1).otherwise(F.lit(1))
    return merged.select("schema", "key", F.coalesce("new", "target").alias("target"), F.coalesce(hits, F.lit(1)).cast("long").alias("hits"))
