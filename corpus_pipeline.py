"""A training corpus from ``documents``: good, without boilerplate, without near copies, without benchmark passages, mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, line_dedup, mixing, near_join, quality
from tidewatch.scratch import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are frequent in their source; copies count once, or they would all be emptied."""
    return line_dedup.drop_boilerplate(docs, distinct=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return near_join.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many; more than a document's own words are repeats.

    Words are joined back by doc_id; documents without one go through the mix as a whole.
    """
    whole = F.when(F.col("doc_id").isNull(), F.struct(*docs.columns))
    taken = mixing.mix(docs, carry=whole).where("taken > 0").select("doc_id", F.col("size").alias("n_words"), "taken", "carried")
    taken = written(taken, "mix-taken")
    known = docs.join(taken.where("doc_id IS NOT NULL").drop("carried"), "doc_id")
    return known.unionByName(taken.where("doc_id IS NULL").select("carried.*", "n_words", "taken"))


STAGES = [
    ("quality", good),
    ("line dedup", without_boilerplate),
    ("near duplicates", one_of_each),
    ("decontamination", unseen),
    ("mixing", mixed),
]

#: Trained weights decide in the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
