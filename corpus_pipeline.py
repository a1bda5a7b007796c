"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``, and each works on all
that its predecessor kept.

Rows are judged by id and text together, so rows that share an id, or have none, pass or go each by its own text. Repeated
rows (id and text) are one document to every stage and stay or go together. Null and empty texts are rejected by the
quality rules, as they have no words. Empty tables give empty results; labels or a benchmark without rows reject nothing
beyond the base rules. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordolith.llm.common import stored, table
from ordolith.llm.decontaminate import drop_leaked
from ordolith.llm.neardup import drop_near_duplicates
from ordolith.llm.packing import BYTES_FILE, pack
from ordolith.llm.quality import keep_good
from ordolith.llm.secrets import redact_secrets
from ordolith.llm.tokenids import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; documents stay, with their new length."""
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document."""
    return pack(docs, tokenizer_path(BYTES_FILE))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

#: The forest, tokens and packing aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
