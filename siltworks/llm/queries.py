"""The registered queries of the corpus operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, bpe, cascade, crossparse, fim, huffman, impact, licenses, minhash, secrets, spbpe, suffixdedup, winnow
from .common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths, so each digit of a doc_id but the last is a directory below its source; they have no licence files, so headers speak for directories."""
    docs = table(spark, sf_dir, "documents")
    digits = F.split(F.col("doc_id").cast("string"), "")
    path = F.concat_ws("/", "source", F.array_join(F.slice(digits, F.lit(1), F.greatest(F.size(digits) - 1, F.lit(0))), "/"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.regexp_replace(path, "//+", "/")
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), headers_declare=True)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    digest = F.sha2(secrets.joined_spans(secrets.base_only(spans)).cast("binary"), 256)
    return found.select("doc_id", *[secrets.number_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")], digest.alias("base_sha256"), secrets.joined_spans(spans).alias("spans"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = impact.vectors(table(spark, sf_dir, "embeddings"))
    return impact.top_k(base, base.where("vec_id % 100 = 0"))


#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Domains that are blocked where no rule decides, by rule: each SITES name, alone and numbered up to NUMBERED, and each
#: third name of a LEFT and a RIGHT part in their order, all under example.com, example.net and example.org.
SITES, NUMBERED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), 3000
LEFT = ("th", "ther", "thth", "thon", "tion", "thou")
RIGHT = ("an", "ble", "ea", "ed", "en", "er", "es", "ha", "he", "in", "ing", "ly", "nd", "nt", "on", "or", "ou", "re", "sh", "st", "th", "ther", "ti", "tion", "wh")
TLDS = ("com", "net", "org")


def listed(spark: SparkSession) -> DataFrame:
    """key: 18 006 * 3 numbered sites and the 150 * 3 / 3 two-part names of the rule."""
    strings = lambda x: F.array(*map(F.lit, x))
    numbered = spark.range(NUMBERED + 1).select(F.explode(strings(SITES)).alias("s"), "id").select(F.when(F.col("id") == 0, F.col("s")).otherwise(F.concat("s", F.lit("-"), F.col("id").cast("string"))).alias("name"), F.lit(0).alias("i"))
    pairs = spark.range(len(LEFT) * len(RIGHT)).select(F.concat(F.get(strings(LEFT), F.expr(f"cast(id div {len(RIGHT)} as int)")), F.get(strings(RIGHT), F.expr(f"cast(id % {len(RIGHT)} as int)"))).alias("name"), F.col("id").alias("i"))
    third = F.when(F.col("third"), (F.col("i") + F.col("t")) % 3 == 0).otherwise(True)
    names = numbered.withColumn("third", F.lit(False)).unionByName(pairs.withColumn("third", F.lit(True)))
    return names.select("name", "i", "third", F.posexplode(strings(TLDS)).alias("t", "tld")).where(third).select(F.concat_ws(".", "name", F.lit("example"), "tld").alias("key"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(table(spark, sf_dir, "pages"), RULES, listed(spark))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crossparse.fit(docs.where(~held_out()))
    return crossparse.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_dir(spark)
    huffman.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), store)
    return huffman.read_ids(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spbpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    base = balltree.vectors(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return balltree.hard_negatives(base, base.where("vec_id % 50 = 0"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Query] = {"op1_licenses": op1_licenses, "op2_minhash": op2_minhash, "op3_secrets": op3_secrets, "op4_topk": op4_topk, "op5_urls": op5_urls, "op6_language": op6_language, "op7_decontaminate": op7_decontaminate, "op8_huffman": op8_huffman, "op9_suffix": op9_suffix, "op10_sentencepiece": op10_sentencepiece, "op11_negatives": op11_negatives, "op12_bpe": op12_bpe, "op13_fim": op13_fim}
ORACLE: dict[str, str] = {
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_urls": """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
b AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(x, length(regexp_extract(x, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
rules(verdict, h, p) AS (VALUES """
    + ", ".join(map(str, RULES))
    + """),
tlds(t, tld) AS (VALUES """
    + ", ".join(map(str, enumerate(TLDS)))
    + """),
sites(s) AS (VALUES """
    + ", ".join(f"('{s}')" for s in SITES)
    + """),
l(x, a) AS (VALUES """
    + ", ".join(map(str, enumerate(LEFT)))
    + """),
r(y, b) AS (VALUES """
    + ", ".join(map(str, enumerate(RIGHT)))
    + f"""),
listed(k) AS (SELECT s || CASE WHEN n = 0 THEN '' ELSE '-' || n END || '.example.' || tld FROM sites, range({NUMBERED} + 1) g(n), tlds
              UNION ALL SELECT a || b || '.example.' || tld FROM l, r, tlds WHERE (x * {len(RIGHT)} + y + t) % 3 = 0),
"""
    + """f AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
      FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
m AS (SELECT DISTINCT page_id FROM b JOIN listed ON host = k OR ends_with(host, '.' || k))
SELECT b.page_id, host, path, rule, coalesce(verdict, CASE WHEN m.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM b LEFT JOIN f ON f.page_id = b.page_id AND n = 1 LEFT JOIN m ON m.page_id = b.page_id""",
    "op11_negatives": """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.a, p.b AS p, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM r WHERE rank <= 3""",
    "op13_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || substr(x, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
