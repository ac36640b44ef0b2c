"""The registered queries of this package. Each takes the session and the folder of the tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import (
    decontaminate,
    divergence,
    fuzzy_lines,
    katz,
    minhash,
    packing,
    page_text,
    pii,
    quality,
    resampling,
    tokenfiles,
    toxicity,
    warc,
)
from caselens.llm.common import scratch, table


def bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    heads = warc.read_headers(spark, path)
    found = heads.join(warc.verified_payloads(spark, path), "sha256", "left")
    same = F.col("stored_digest").eqNullSafe(F.col("payload_digest"))
    return found.select(
        F.col("record_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        F.when(same, F.col("stored_digest"))
        .otherwise(F.raise_error(F.lit("a header's digest does not match the stored payload")))
        .alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.dedupe_lines(docs).select("doc_id", "n_lines", "dropped", "text")


def sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    tokenfiles.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = tokenfiles.read_token_files(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def fair_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.score_texts(table(spark, sf_dir, "documents"), held_out)


def level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def position_crc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bootstrapped_pii": bootstrapped_pii,
    "op2_sos_packing": sos_packing,
    "op3_quality_rules": quality_rules,
    "op4_warc_archive": warc_archive,
    "op5_fuzzy_lines": fuzzy_line_dedup,
    "op6_token_files": token_files,
    "op7_seed_alignment": seed_alignment,
    "op8_bbit_minhash": bbit_minhash,
    "op9_fair_toxicity": fair_toxicity,
    "op10_katz_scores": katz_scores,
    "op11_level_products": level_products,
    "op12_dom_marginals": dom_marginals,
    "op13_position_crc_resample": position_crc_resample,
}
