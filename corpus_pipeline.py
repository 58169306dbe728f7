"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  What a stage returns is written as
Parquet and read again as the next one's ``docs``, so a stage begins by deleting
the intermediate tables of the ones before it that ``docs`` does not read.  Each
works on all rows of its predecessor.  No stage can be expressed in SQL; tests hold them against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm._common import clear_scratch, written
from tidecast.llm.language_id import UNKNOWN, fit_ppm, predict_language
from tidecast.llm.line_dedup import line_dedup
from tidecast.llm.mixing import mix_sources
from tidecast.llm.near_dedup import near_components, row_hash
from tidecast.llm.packing import pack, tokenize_pieces
from tidecast.llm.queries import op5_training_rows, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_REPEATS = 1.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    told = predict_language(docs.select(*COLUMNS), fit_ppm(op5_training_rows(docs)))
    return told.where(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with one line per component of near-equal lines left in the corpus."""
    clear_scratch(docs)
    kept = line_dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard 0.8: that of smallest id (null after all), then of least text hash."""
    clear_scratch(docs)
    rows = docs.select(*COLUMNS, row_hash(F.col("doc_id"), F.col("text")).alias("row"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    keep = near_components(rows).groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.row").alias("kept_row"))
    # Joined by row alone, so that rows are dealt once, for the join and for what repeats.
    same_id = F.coalesce(F.col("doc_id") == F.col("id"), F.col("doc_id").isNull() & F.col("id").isNull())
    first = rows.join(keep, (F.col("row") == F.col("kept_row")) & same_id, "left_semi")
    return first.dropDuplicates(["doc_id", "row"]).select(*COLUMNS)  # rows that repeat the kept one


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to ``MAX_REPEATS`` times on average."""
    clear_scratch(docs)
    return mix_sources(docs.select(*COLUMNS), max_repeats=MAX_REPEATS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece with its ids and its place."""
    clear_scratch(docs)
    return pack(tokenize_pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
