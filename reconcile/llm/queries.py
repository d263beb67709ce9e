"""The registered queries of this subpackage, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcile.llm import (
    collocations, decontaminate, embeddings, interpolation, jaccard, language, licenses, manifest, packing, passages,
    quality, surrogates, token_ids,
)
from reconcile.llm.batches import written
from reconcile.llm.oracles import ORACLES
from reconcile.llm.shipping import shipped
from reconcile.session import scratch_path

# A deployment passes a secret of its own; whoever has the key can tell the surrogates' originals.
PII_KEY = b"key of the registered queries"

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data, and where they stand."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs, PII_KEY)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out(F.col("doc_id"), 4, 2))
    model = language.fit(docs.filter("NOT held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under a Jaccard similarity of 0.75 of 5-word shingles."""
    return jaccard.cluster(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a document is good, for every document, and whether it stays."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    scored = quality.with_score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model, "score")
    return scored.select("doc_id", "score", (F.col("score") >= (model.threshold if model else 0.0)).alias("kept"))


def op5_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under a bigram model of six sevenths of the documents."""
    docs = _table(spark, sf_dir, "documents")
    return interpolation.score_texts(docs, language.held_out(F.col("doc_id"), 7, 2))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document, and the places of the base phrases."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word windows of the benchmark."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors of one label with a cosine of 0.98 or more."""
    return embeddings.link(_table(spark, sf_dir, "embeddings"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of all documents, read back from the files they were written to."""
    path = scratch_path(spark, "token-ids")
    token_ids.write_ids(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_ids.read_digests(spark, path)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document, and whether it verifies after some are tampered with."""
    rows = manifest.build(_table(spark, sf_dir, "documents"))
    own = F.coalesce("tampered", "leaf")
    rows = rows.withColumns({"proof_sha256": manifest.proof(F.col("path")), "folded_root": manifest.folded(own, F.col("path"))})
    verified = F.col("folded_root") == F.col("root")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified.alias("verified"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words in every language."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that stand elsewhere as well."""
    kept = passages.without_repeats(_table(spark, sf_dir, "documents"))
    return written(kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (
        op1_surrogates, op2_language, op3_jaccard, op4_quality, op5_interpolation, op6_licenses, op7_packing,
        op8_decontaminate, op9_embeddings, op10_token_ids, op11_manifest, op12_collocations, op13_passages,
    )
}

__all__ = ["ORACLES", "QUERIES"]
