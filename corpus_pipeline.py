"""From raw documents to packed sequences: stages that each write their result and read it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import importance, lines, packing, rules, simhash
from tilewright.llm.common import MADE, discard, fresh
from tilewright.session import load


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time: whole documents are long, and a batch is held on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def target_like(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: the documents that importance resampling draws."""
    small_batches(spark)
    found = importance.resample(docs, load(spark, sf_dir, "labels"))
    return found.where("kept").select("row.*")


def well_formed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that pass by themselves and aren't made of their host's frequent lines."""
    small_batches(spark)
    return rules.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line deduplication: every document stays, without the lines that came before."""
    small_batches(spark)
    found = lines.dedup_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def first_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: the document with the smallest id of each group."""
    small_batches(spark)
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every document in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.harmonic_packing(docs)


STAGES = [
    ("quality classifier", target_like),
    ("quality rules", well_formed),
    ("line dedup", without_repeated_lines),
    ("near-dedup", first_of_each_group),
    ("packing", packed),
]

#: Hashed models, noise and tokenizers can't be expressed in SQL; tests/llm/test_pipeline.py holds the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage and the ones before it wrote goes once the next documents are written."""
    docs, since = load(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES:
        docs = fresh(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(spark, since, docs)
    return docs
