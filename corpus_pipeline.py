"""From raw documents to packed token sequences: quality rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last keep
the columns of documents, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structlab.llm.best_fit_pack import pack_documents
from structlab.llm.common import Scratch, bounded, id_and_text, one_row_per_id, repeated_ids, table
from structlab.llm.exact_dedup import KEY_BOUND, duplicate_groups
from structlab.llm.jaccard_join import jaccard_components
from structlab.llm.quality_rules import base_failed, fit_rules, rule_column, text_statistics
from structlab.llm.source_mix import emit_mix

#: No stage after the first can be told in SQL: the rules are learned, and packing is a greedy algorithm.
ORACLE_SQL = None
#: Most ids or digests that are broadcast; more are joined by a shuffle.
ID_BOUND = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or meet a learned rule (fitted on what ``labels`` says of these documents)."""
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"))
    judged = text_statistics(rows, "__text", ("__row",))
    return judged.filter(~base_failed() & (rule_column(rules) == 0)).select("__row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, once; different texts of one id all stay."""
    groups = duplicate_groups(docs).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__sha"))
    joined = rows.join(bounded(groups, KEY_BOUND // 4), F.col("__sha") == F.col("__digest"), "left")
    kept = joined.filter(F.col("__digest").isNull() | F.col("__id").eqNullSafe(F.col("__keep_id"))).select("__row.*")
    return one_row_per_id(kept, "doc_id")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more, the one with the smallest id of each group stays.

    Where ids repeat, documents are told apart by id and text.
    """
    if not repeated_ids(docs, "doc_id").isEmpty():
        keyed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"), id_and_text(docs, "doc_id").alias("__key"))
        rows = jaccard_components(keyed, n=5, percent=80, id_col="__key", text_col="__text")
        return without(spark, keyed, rows, "__key").select("__row.*")
    return without(spark, docs, jaccard_components(docs, n=5, percent=80), "doc_id")


def without(spark: SparkSession, docs: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the documents that aren't the first of their component."""
    dropped = rows.filter("row_id <> component").select(F.col("row_id").alias("__dropped")).distinct()
    dropped = Scratch(spark, "near").save(dropped, "dropped")
    return docs.join(bounded(dropped, ID_BOUND), F.col(id_col) == F.col("__dropped"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return emit_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("row_id", "doc_id")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = work.save(out, name) if k + 1 < len(STAGES) else out
    return docs
