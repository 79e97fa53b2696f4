"""From raw documents to training pieces: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes all that its predecessor kept, written as Parquet in the shared folder and read
again; a table goes as soon as the next one is written. All stages but the last return the columns
of their input, whatever these are; they need doc_id and text. n_chars, where there is one,
follows the text.

The near-duplicate stage compares fingerprints of five-word shingles and links them at 6 of 64
differing bits or fewer, the most that keeps chance links rare among 10^9 documents. Six bits stand for a
similarity of about 0.92, so that every group holds documents alike in 0.8 or more; README.md states how
many of the pairs at 0.8 it finds.

Defined results: a null text counts as an empty one in every decision and stays null where it is
kept; empty texts are documents like others, and near-duplicates of one another; very long
texts are handled whole; a row with a null doc_id passes or fails by its own text and is never a
duplicate; rows that share a doc_id are one document for line and near-duplicate decisions, so that
repeated rows stay or go together; of a group the smallest doc_id stays; an empty table
gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import decontaminate, line_dedup, pieces, quality, simhash
from tessaline.llm.common import remove_folder, scratch_folder, table, write_table

WORDS, BITS = 5, 6  # of a shingle, and that may differ
OWN = ("doc_id", "text")


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, out of the way of the operators' names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("rest"))


def _widen(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c) if c in OWN else F.col("rest").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return _widen(quality.classify(_narrow(docs), table(spark, sf_dir, "labels")).filter("predicted = 1"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat."""
    own = _narrow(docs)
    kept = line_dedup.apply_keep_runs(own, line_dedup.dedup_lines(own))
    changed = F.col("n_dropped") > 0
    kept = kept.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("rest", F.when(changed, F.col("rest").withField("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))).otherwise(F.col("rest")))
    return _widen(kept, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    own = _narrow(docs)
    found = simhash.near_duplicates(own, WORDS, BITS)
    gone = found.filter(F.col("component") < F.col("doc_id")).select(F.col("doc_id").alias("gone"))
    return _widen(own.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return _widen(decontaminate.decontaminate(_narrow(docs), table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")), docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of each document."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("pieces", piece_stage),
]

#: SQL cannot express the classifier or the hash; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = scratch_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
