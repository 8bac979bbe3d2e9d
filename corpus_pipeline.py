"""A corpus pipeline of five operators: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage works on all that its predecessor kept, and its result is written as Parquet and read again as the next
one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, fertility, line_dedup, mixing, ngram_join
from strandline.llm.common import table, written


def _resized(docs: DataFrame, changed: Column) -> DataFrame:
    """docs with n_chars, if they have it, following a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep. Null and empty texts have too few words and go; rows alike stay or go
    together; values on a fence stay; an empty table stays empty."""
    return fertility.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated three-line windows; n_chars follows; those that lose all their words go. Null and
    empty texts stay as they are; of equal windows the first by doc_id stays (null ids are last, rows alike are one)."""
    out = line_dedup.dedup_lines(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(empty, F.lit(False)))
    return _resized(out, F.col("n_removed") > 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts, the one of the least doc_id (and rows alike to it). Texts without words
    and rows without an id stay."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged by id and text. Null and empty texts hold none and stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: a row per copy that is trained on, sorted by its position (ties by doc_id), a copy taken in part cut
    after its last word; n_chars follows. Texts without words are never taken; a null source is one of its own."""
    out = mixing.curriculum(docs)
    return _resized(out, F.col("words") < F.col("size"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

#: Tokenising isn't expressible in SQL; tests hold run() against one by plain loops and the operators' SQL, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
