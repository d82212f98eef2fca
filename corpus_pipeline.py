"""A corpus pipeline: documents -> good, distinct, uncontaminated, redacted, tokenised documents.

``run`` chains the stages in one session; each takes (spark, docs, tables) and works on all rows
that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemaspark.llm import bpe, decontaminate, neardup, quality, secrets
from mnemaspark.llm.common import Stage, table
from mnemaspark.llm.queries import BYTE_BPE

#: Several stages hold models or sketches that SQL has no words for.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null and empty texts are scored like others, by the bias alone."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.80 or more), that of the smallest doc_id.

    Null and empty texts, and rows without doc_id, stay; of a repeated doc_id all rows stay or go.
    """
    return neardup.keep_one(docs, neardup.Rule(80, 100)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark items don't cover a twentieth of the words; those without words stay."""
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars is that of the new text where one was. Null texts stay null."""
    clean = secrets.redact(secrets.scan(docs, secrets.WHOLE))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the bytes decoded from them; null texts have none."""
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.bpe_ids(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage.write(docs, f"stage-{i}")
            if i:
                stage.drop(f"stage-{i - 1}")
    return docs
