"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage before wrote.
All but the last return the columns of documents, whatever those are. A table without rows
passes through; null ids and texts, empty texts and repeated rows are told below.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pixtables.llm import bpe, decontaminate, jaccard_join, quality_classifier, secret_scan
from pixtables.session import configure, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: good prose, not abusive. Texts without words (null too) go."""
    configure(spark)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = docs.select(F.struct("*").alias("_row"), quality_classifier.score(F.col("text"), model).alias("_score"))
    return judged.where("_score.good >= 0.5 and _score.abusive < 0.5").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest doc_id; texts without words stay."""
    configure(spark)
    return jaccard_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by benchmark items; texts without words stay."""
    configure(spark)
    judged = decontaminate.decontaminate(docs.select(F.struct("*").alias("_row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=["_row"])
    return judged.where(~F.col("contaminated")).select("_row.*")


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark and n_chars is counted anew."""
    configure(spark)
    found = docs.select(F.struct("*").alias("_row"), secret_scan.redacted(F.col("text")).alias("_new"))
    text, changed = F.coalesce("_new", "_row.text"), F.col("_new").isNotNull()
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded bytes; null texts have no ids."""
    configure(spark)
    coded = docs.select("doc_id", bpe.coded(F.col("text")).alias("c")).select("doc_id", "c.*")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark_free),
    ("secret_scan", secrets_redacted),
    ("bpe", tokens),
]
ORACLE_SQL = None  # a trained classifier and a vocabulary's merges are beyond SQL; see tests/llm/test_pairs.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
