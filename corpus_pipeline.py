"""The corpus pipeline: quality, toxicity, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm import jaccard, linededup, packing, quality, toxicity
from proseloom.llm.common import merged, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the Kneser-Ney quality classifier keeps, each judged by its own text, null and repeated ids too."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=True).where("keep").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold of the toxicity model, each by its own text; null and empty ones are scored as empty."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("__score") < toxicity.THRESHOLD).select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; texts of which no word is left go, null and empty ones too.

    Rows that repeat a doc_id are one document of all their lines; null ids are one document after all others.
    """
    kept = linededup.dedup_lines(docs).where(F.col("kept_text").rlike(r"\S"))
    n = F.length("kept_text").cast("bigint")
    return kept.select(*(F.col("kept_text").alias("text") if c == "text" else n.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at 0.8: that of the smallest doc_id, null ids last.

    Rows are nodes by their place in a staged copy, so rows with null or repeated ids are compared by their own texts; of
    equal ids the first row stays. Rows without words are linked with nothing and all stay.
    """
    at = "place"
    while at in docs.columns:
        at += "_"
    rows = staged(docs.withColumn(at, F.monotonically_increasing_id()), "placed")
    groups = jaccard.similar_documents(rows.select(F.col(at).alias("doc_id"), "text"))
    named = merged(groups.select(F.col("doc_id").alias(at), "component_id"), rows.select(at, "doc_id"), at)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", at)).alias("first")).select(F.col(f"first.{at}"))
    return merged(rows, first, at, "left_semi").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each word of each row goes: bins of 4096 words without two copies of a text (of a shard)."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]
#: The stages are models, graph components and sequential packing, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is staged as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
