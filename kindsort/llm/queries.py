"""Registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, langid, licenses, mixing, quality, reputation, resampling, secrets, simhash, tokens, topk, toxicity
from .common import fold_of, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def held_out(folds: int, fold: int) -> Column:
    """Whether a document's fold is never learned from; a row without an id is in no fold."""
    return F.coalesce(fold_of(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored = docs.withColumn("score", quality.quality(spark, F.col("text"), model))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    scored = toxicity.score_documents(docs, model, "tox")
    return scored.select(
        "doc_id",
        held_out(3, 1),
        F.col("tox.score").alias("score"),
        (F.col("tox.score") >= 0.7).cast("int").alias("predicted"),
        F.col("tox.offending").alias("offending"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, folds=4, held_out=2)
    told = docs.select("doc_id", langid.language(spark, F.col("text"), model).alias("told"))
    return told.select("doc_id", held_out(4, 2), F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("words")).checkpoint()
    mixed, m = mixing.mix(sizes, size="words")
    return mixed.select("doc_id", *(F.col(f"{m}.{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_documents(docs, TOKENIZER)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs, k=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.secrets(F.col("text")).alias("s")).select("doc_id", "s.*")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reputation.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return told.select("page_id", "host", "path", "rule", "verdict")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10_000, longest=2, seed=7)
    return told.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_top_k": op2_top_k,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_token_ids": op8_token_ids,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "op11_centroids": op11_centroids,
    "op12_url_filter": op12_url_filter,
    "op13_resampling": op13_resampling,
}

#: DuckDB SQL where it can express a query over whole tables.
ORACLE: dict[str, str] = {
    "op2_top_k": topk.oracle(),
    "op3_decontamination": decontam.oracle(),
    "op5_licenses": licenses.oracle(),
    "op7_mixing": mixing.oracle(),
    "op11_centroids": centroids.oracle(),
    "op12_url_filter": reputation.oracle(URL_RULES),
    "op13_resampling": resampling.oracle(),
}
