"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, context_tree, embedding_dedup, html_extract, line_dedup, merkle, packing, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts
from pathloom.plans.scratch import materialize
from pathloom.plans.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = materialize(simhash.with_fingerprint(docs, "text", shingle=4, keep=["doc_id"]), "op2")
    labels = simhash.component_labels(marked, "doc_id", distance=4)
    return marked.join(labels, F.col("_fp") == F.col("_lfp")).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_html(pages).select("page_id", "url", "text", "n_chars")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeated_words(docs, window=35, rewrite=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "lang", "text")
    tokenizers = {token_counts.WORDS: "", "byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json")}
    return token_counts.rollup_documents(docs, tokenizers)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "_task", "_nth")
    return packing.place_pieces(digests, 1024, numbers=("_task", "_nth")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.embedding_links(vectors, cosine=0.95).select("vec_id", "n_links", "component_id", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeated_bytes(docs, window=400, rewrite=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = context_tree.score_documents(docs, held_out, depth=5)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = merkle.leaf_digest(*[changed if c == "text" else F.col(c) for c in columns])
    return merkle.merkle_manifest(docs, columns, keep=["doc_id"], claim=claim)


_OPERATORS = [op1_line_dedup, op2_simhash_near_dedup, op3_html_extraction, op4_substring_dedup, op5_token_counts, op6_best_fit_packing, op7_embedding_near_dedup, op8_bpe, op9_suffix_array_dedup, op10_quality_rules, op11_lm_scoring, op12_merkle_manifest]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
