"""The operators bound to the test tables: thin queries and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structlab.llm.best_fit_pack import pack_documents
from structlab.llm.common import table
from structlab.llm.exact_dedup import exact_dedup
from structlab.llm.hilbert_shard import hilbert_shards
from structlab.llm.html_consensus import extract_main_text
from structlab.llm.jaccard_join import jaccard_components
from structlab.llm.oracles import ORACLES  # noqa: F401
from structlab.llm.piece_codec import decode_pieces, encode_pieces
from structlab.llm.quality_rules import apply_rules, fit_rules
from structlab.llm.secret_ledger import BASE_RULES, RULES, joined_spans, ordered_spans, scan_in_steps
from structlab.llm.skip_chain_pii import KINDS, find_personal_data
from structlab.llm.source_mix import mix_sources
from structlab.llm.suffix_dedup import suffix_dedup
from structlab.llm.target_resample import resample
from structlab.llm.vector_file import hard_negatives


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    judged = apply_rules(docs, rules)
    return judged.select(
        F.col("row_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])
    return placed.select(
        F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select(F.col("row_id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return rows.select(
        F.col("row_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op5_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return rows.select(
        F.col("row_id").alias("doc_id"), *counts,
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return rows.select(F.col("row_id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("row_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("row_id", "doc_id")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    half = docs.agg(F.percentile_approx("doc_id", F.lit(0.5))).first()[0]  # the table as it was, then as it is
    found, _ = scan_in_steps(docs, [] if half is None else [half])
    rows = found.select("path_id", ordered_spans(F.col("findings"), BASE_RULES).alias("base"), ordered_spans(F.col("findings"), RULES).alias("every"))
    counts = [count_of("base", r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return rows.select(
        F.col("path_id").alias("doc_id"), *counts,
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("every")).alias("spans"),
    )


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_pieces(table(spark, sf_dir, "documents"), path)
    spanned = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, k: n + k)
    coded = coded.select(
        F.col("row_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), spanned.alias("n_spanned"), "ids",
    )
    decoded = decode_pieces(coded, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_spanned")


def op12_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("row_id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_html_consensus": op3_html_consensus,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_skip_chain_pii": op5_skip_chain_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_source_mix": op7_source_mix,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_best_fit_pack": op9_best_fit_pack,
    "op10_secret_ledger": op10_secret_ledger,
    "op11_piece_codec": op11_piece_codec,
    "op12_vector_file": op12_vector_file,
    "op13_target_resample": op13_target_resample,
}
