"""A corpus pipeline of five stages, each written to the shared folder and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import crossparse, minhash, secrets, spbpe, winnow
from siltworks.llm.common import small_batches, stash, table
from siltworks.llm.queries import held_out

#: SQL can't express cross-parsing, so there's none for the rows.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: without a letter, or with more phrases than pay in any language (over 8 bits a byte).

    Null and empty texts have no letter and go; equal rows go or stay together. Without any label
    all texts with a letter stay. Other columns pass as they are, whatever their names.
    """
    small_batches(spark)
    return crossparse.known(docs, crossparse.fit(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id; all rows of a kept doc_id stay.

    Null and empty texts, and rows with a null doc_id, are in no group and stay.
    """
    small_batches(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Null and empty texts have none and stay; with an empty benchmark all do."""
    small_batches(spark)
    return winnow.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no document is dropped. A null text stays null."""
    found = secrets.find(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), F.col("text").isNull().alias("_null"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest")), carry="rest")
    text = F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.when(~F.col("rest._null"), F.col("text")))
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("rest.n_chars"))}
    return found.select(*[own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, the ids and their digests, one row per input row; a null text is empty. Other columns are left out."""
    small_batches(spark)
    return spbpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=True).drop("decoded")


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("secret scans", redact_secrets), ("SentencePiece encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
