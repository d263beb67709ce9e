"""A training corpus from raw documents, in five stages.

Each stage takes all that the one before it kept, and its decisions take effect: documents of
poor quality go, one document of each group of near duplicates stays, documents contaminated by
the benchmark go, personal data is replaced, and what is left is packed into sequences. All
stages but the last return the columns that they were given.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcile.llm import decontaminate, jaccard, packing, quality, surrogates
from reconcile.llm.queries import PII_KEY, TOKENIZER
from reconcile.llm.shipping import shipped
from reconcile.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under a Jaccard similarity of 0.75."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, benchmark)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    replaced = surrogates.pseudonymize(docs, PII_KEY, entities=None)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        size = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text"), F.col("n_chars")))
        replaced = replaced.withColumn("n_chars", size.cast(kind))
    return replaced


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", shipped(good_quality)),
    ("near_duplicates", shipped(without_near_duplicates)),
    ("decontamination", shipped(without_benchmark)),
    ("personal_data", shipped(without_personal_data)),
    ("packing", shipped(packed)),
]

# No stage's decisions can be told in SQL: a trained classifier comes first, and a tokenizer last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = os.path.join(root, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
