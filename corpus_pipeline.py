"""Corpus pipeline: five stages over the documents table, each calling one operator of ``sanscope.llm``.

Every stage takes (spark, docs, sf_dir) and reads all rows its predecessor kept; all but the last
return the columns of ``docs`` unchanged. The two dedup stages judge documents, that is distinct pairs of
an id and a text: rows that share only the id are different documents, rows without an id are told
apart by their texts, and of rows that repeat both one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanscope.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from sanscope.llm.common import SPACE_CLASS, Scratch, text_or_empty
from sanscope.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _only(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """One row of ``docs`` for every (doc_id, text digest) of ``kept``; null ids are equal."""
    named, kept = docs.withColumn("_digest", digest), kept.toDF("_kept_id", "_kept_digest")
    same = named["doc_id"].eqNullSafe(kept["_kept_id"]) & (named["_digest"] == kept["_kept_digest"])
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_digest"]).drop("_digest")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (4): documents more likely toxic than not go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (3): of equal texts the least doc_id stays."""
    judged = exact_dedup.exact_dedup(docs)
    digest = F.sha2(F.encode(F.regexp_replace(text_or_empty("text"), SPACE_CLASS, " "), "UTF-8"), 256)  # as op3 has it
    return _only(docs, judged.where("kept").select("doc_id", "text_sha256"), digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (9): of each linked group the document with the least doc_id stays, ids before nulls.

    The operator's nodes are ids. Where ids are null or repeated, documents are numbered in the order
    of their ids first.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"))
        return docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    scratch, digest = Scratch(spark, "near-copies"), F.sha2(F.encode(text_or_empty("text"), "UTF-8"), 256)
    number = scratch.keep(
        docs.select("doc_id", digest.alias("digest")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "digest")
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_its_digest"), F.monotonically_increasing_id().alias("_number")), "numbers")
    named = docs.withColumn("_digest", digest)
    texts = scratch.keep(named.join(number, named["doc_id"].eqNullSafe(number["_id"]) & (named["_digest"] == number["_its_digest"]))
                         .select("_number", "text"), "texts")
    kept = minhash.near_duplicates(texts, id_col="_number").where("kept").select(F.col("doc_id").alias("_number")).distinct()
    return _only(docs, number.join(kept, "_number").select("_id", "_its_digest"), digest)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2): documents that hold a copy of an item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (6): token ids instead of the text, and whether they decode to it."""
    coded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, offsets=False)
    back = bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return back.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("lossless", whole).drop("text", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]
#: A trained classifier, similarity links and edit distances decide on rows: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
