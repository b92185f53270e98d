"""A training corpus from raw documents: quality, repeated lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.llm._spark import unused, written
from groundling.llm.decontam import find_leaks
from groundling.llm.fertility import quality
from groundling.llm.jaccard_join import near_duplicates
from groundling.llm.line_dedup import remove_all_repeated_lines
from groundling.llm.packing import pack_sequences

#: Not expressible in SQL: tokenisers, prefix trees and packing; tests hold every stage against brute force.
ORACLE_SQL = None

# All stages: an empty table gives no rows, other columns of documents stay as they are whatever their names (working columns take names that
# are free), very long texts are processed whole, and equal rows are treated alike.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null or empty texts are rejected, null ids are no matter; repeated rows stay or go together."""
    verdict = unused(docs, "_quality")
    return docs.withColumn(verdict, quality()).where(f"`{verdict}`.kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; one of which no word is left (or whose text is null) goes. n_chars follows the text. Null ids come last; repeated rows share their result."""
    lines = unused(docs, "_lines")
    out = remove_all_repeated_lines(docs, out_col=lines).withColumn("text", F.col(f"`{lines}`.kept")).where("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the least id; of rows equal in id and text one. Documents without words stay. Rows without an id stay if no row with one is near them."""
    groups = near_duplicates(docs).where("component_id IS NULL OR doc_id = component_id")
    id_, hash_, kept = (unused(docs, n) for n in ("_id", "_hash", "_kept"))
    keep = groups.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(kept)).distinct()
    rows = docs.withColumn(hash_, F.xxhash64("text"))
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(F.col(id_)) & (rows[hash_] == F.col(kept)), "left_semi")
    return rows.dropDuplicates(["doc_id", hash_]).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none. Null ids and repeated rows as all others."""
    found = unused(docs, "_leaks")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=found).where(f"size(`{found}`) = 0").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences and offsets: the columns of ``pack_sequences``. Null and empty texts are one end token; repeated rows and null ids are documents of their own."""
    return pack_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
