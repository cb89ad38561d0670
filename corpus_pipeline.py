"""Corpus pipeline: five of the training-data operators in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes
it as Parquet below ``spark.checkpoint.dir`` and reads it again as the next
stage's input.  Every stage but the last returns the columns of ``documents``.

1. toxicity: documents predicted toxic go.
2. line_dedup: lines that match an earlier line go; a document stays even if no
   line is left (its text is then empty).
3. jaccard_join: of every group of near-duplicate documents the one of least
   id stays; texts without words are copies of equal texts alone, and null texts all stay.
4. decontaminate: documents with a benchmark window go.
5. bpe: token ids of every remaining text and the digest of the decoded ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm import op1_bpe, op2_decontaminate, op4_jaccard, op6_toxicity, op7_lines
from credsight.llm.common import free_names, table
from credsight.session import checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = op6_toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    score, toxic = free_names(docs.columns, "_tox_score", "_tox")
    return op6_toxicity.classify(docs, net, docs.columns, (score, toxic)).where(F.col(toxic) == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op7_lines.dedup_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_jaccard.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_bpe.round_trip(docs, memo=MEMO)


#: pre-tokens that a worker remembers in the last stage; fewer than alone, as workers hold what other stages left
MEMO = 150_000

STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]

#: a trained network decides in the first stage, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the files of a run lie in a folder of their own."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
