"""The queries of this subpackage: thin functions of (spark, sf_dir) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import decontaminate as op10
from tessaline.llm import embedding_dedup as op4
from tessaline.llm import html_text as op5
from tessaline.llm import line_dedup as op9
from tessaline.llm import pieces as op8
from tessaline.llm import prefix_trie as op12
from tessaline.llm import quality as op6
from tessaline.llm import quality_rules as op11
from tessaline.llm import recurrent_lm as op2
from tessaline.llm import run_index as op1
from tessaline.llm import simhash as op7
from tessaline.llm import token_counts as op3
from tessaline.llm import vector_codes as op13
from tessaline.llm.common import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.remove_repeats(table(spark, sf_dir, "documents"))


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.score(table(spark, sf_dir, "documents"))


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.section_tokens(table(spark, sf_dir, "documents"), *op3.default_vocabulary())


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op6.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(op6.fold(F.col("doc_id")) == op6.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.encode(table(spark, sf_dir, "documents"), op8.default_model())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = op9.apply_keep_runs(docs, op9.dedup_lines(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), F.array_join(F.transform("keep_runs", lambda r: F.concat_ws("+", r["start"].cast("string"), r["length"].cast("string"))), ",").alias("keep_runs"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = op10.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op11.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_recurrent_lm": op2_recurrent_lm,
    "op3_section_tokens": op3_section_tokens,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_main_text": op5_main_text,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}
