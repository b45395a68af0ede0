"""A corpus pipeline over ``documents``: what each stage decides takes effect on its result.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read
again before the next one starts. All but the last return the columns of ``documents``. Stages
handle what the operators they call handle: nulls in any column, empty and very long texts, ties,
repeated rows, empty tables and further columns, as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid, mixing, pii, simhash
from quillspark.llm.store import cut

#: A document is rejected if no language has a mean probability of so much.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised: those without a letter, and those that
    look like no language in particular, go. The lang column is left as it is."""
    w, names = langid.fitted(docs, langid.fold(F.col("doc_id")) != 1)
    out = langid.predicted(docs, w, names, keep=tuple(docs.columns))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near copies."""
    return simhash.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; n_chars follows the text."""
    out = pii.pseudonymised(docs, pii.key_of(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row for each copy that the mix takes, with its position."""
    return mixing.training_order(docs)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("pseudonymise", pseudonymise), ("mix", mix)]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
