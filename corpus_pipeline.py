"""A corpus from raw documents to packed sequences: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents. ORACLE_SQL is None: the stages rest on a trained classifier, hashed
candidates and tokenizers, which SQL doesn't express; tests/llm holds them against brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import decontam, neardup, packing, quality, secrets
from gondola.llm.common import work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1. It learns from the labelled documents of this stage's input.

    Null and empty texts get the score of the model's bias, equal texts stay or go together, rows without doc_id are scored
    like any others, an empty table stays empty; a column of docs named score is kept as it is.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = {c: f"own_{c}" for c in docs.columns if c == "score"}
    kept = quality.score_quality(docs.withColumnsRenamed(names), model).filter(F.col("score") >= quality.THRESHOLD)
    return kept.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Texts without words are linked with nothing and stay; rows that repeat a doc_id stay or go together, and so do rows
    without one, which stay; an empty table stays empty.
    """
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts stay, rows that repeat a doc_id stay or go
    together, rows without one stay, an empty table or benchmark takes nothing away."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark; n_chars follows. Null and empty texts stay as they are, an
    empty table stays empty; own columns named like the spans are kept as they are."""
    names = {c: f"own_{c}" for c in docs.columns if c in ("base_spans", "secret_spans")}
    found = secrets.scan_secrets(docs.withColumnsRenamed(names))
    some = F.size("secret_spans") > 0
    text = F.when(some, secrets.redact(F.coalesce("text", F.lit("")), F.col("secret_spans"))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places there. Null and empty texts are the end id alone, rows
    that repeat a doc_id are packed like any others, an empty table gives an empty one."""
    return packing.pack_pieces(packing.token_pieces(docs))


STAGES = [("quality classifier", keep_quality), ("near duplicates", keep_one_copy), ("benchmark decontamination", keep_uncontaminated), ("secret scans", redact_secrets), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{work_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
