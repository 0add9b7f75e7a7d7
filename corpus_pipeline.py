"""Corpus pipeline: quality, language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs. Null texts count as empty; an empty table passes through; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetide.llm.common import materialize, release, small_batches, table, written
from wavetide.llm.langid import fit_language, keep_language
from wavetide.llm.ngram_join import jaccard_components
from wavetide.llm.packing import best_fit_pack
from wavetide.llm.quality import fit_quality, keep_quality
from wavetide.llm.substring_dedup import remove_repeats

#: Column that numbers the rows while near copies are looked for.
ROW = "near_copies_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels of docs, gives a score of at least 0.5."""
    small_batches(spark)
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the random field finds with a score of at least 0.35."""
    small_batches(spark)
    return keep_language(docs, fit_language(docs, F.lit(True)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Rows are linked and dropped by a number of their own: of copies with one id a single row stays, and a null id is
    larger than any other."""
    small_batches(spark)
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))
    groups = materialize(jaccard_components(rows.select(ROW, "text"), id_col=ROW, k=5, num=80, den=100).where("component_id <> doc_id"))
    members = groups.select("component_id", F.col("doc_id").alias(ROW))
    members = members.unionByName(groups.select("component_id", F.col("component_id").alias(ROW)).distinct())
    ids = rows.select(ROW, F.col("doc_id").cast("long").alias("id"))
    first = members.join(ids, ROW).groupBy("component_id").agg(F.min(F.struct(F.isnull("id"), "id", ROW)).alias("first"))
    copies = members.select(ROW).join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti")
    return rows.join(copies, ROW, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that a smaller id has, too; characters cut in half go as well.

    Rows of one id don't remove each other's bytes, and rows without an id keep theirs."""
    small_batches(spark)
    cut = remove_repeats(docs, carry=True, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return best_fit_pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("repeats", repeats), ("packing", packing)]
#: SQL can't say these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage's rows are written, its other tables and those of the stages before it go."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
