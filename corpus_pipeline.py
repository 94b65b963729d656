"""The training-corpus pipeline: each stage reads what its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared checkpoint folder and rereads it as the next stage's documents.  All but
the last stage return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcraft.llm.decontaminate import remove_documents
from panelcraft.llm.near_dedup import drop_near_duplicates
from panelcraft.llm.packing import pack
from panelcraft.llm.pii import redact
from panelcraft.llm.shipping import ship_package
from panelcraft.llm.tables import table
from panelcraft.llm.toxicity import drop_toxic
from panelcraft.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of toxicity lets pass."""
    ship_package(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near duplicates."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    ship_package(spark)
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data redacted and n_chars following the text."""
    ship_package(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, ids, doc_tokens, length,
    sequence_id, offset."""
    ship_package(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Models, signatures and tokenizers are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last stage's rows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
