"""The corpus pipeline: stages over the documents table, each written and read again.

Each stage works on all documents that the one before kept.  Toxic documents go, one
document of each near-duplicate group stays, documents that hold benchmark passages
go, the rest is repeated or thinned by source weights, and the mix is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindsort.llm import decontam, mixing, simhash, tokens, toxicity
from kindsort.llm.common import fresh, prepare, table
from kindsort.session import work_path

#: A document of this probability or more is toxic.
TOXIC = 0.7
#: Words in a shingle of the near-duplicate stage.
SHINGLE = 3
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is below ``TOXIC``.

    The model is learned from all labels of the input folder.  Null and empty texts stay.
    """
    prepare(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=None)
    name = fresh(docs, "tox")
    return toxicity.score_documents(docs, model, name).where(F.col(f"{name}.score") < TOXIC).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id (rows without an id last).

    A row belongs to the group of its own text, so rows that share an id but not their
    text all stay, unless their texts are copies of others."""
    prepare(spark)
    return simhash.one_of_each(docs, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text overlaps with no benchmark item."""
    prepare(spark)
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row a repetition."""
    prepare(spark)
    mixed, name = mixing.mix(docs)
    again = F.explode(F.sequence(F.lit(1), F.col(f"{name}.repeats")))
    return mixed.where(F.col(f"{name}.repeats") > 0).withColumn(name, again).drop(name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as id files in the shared folder; a row a document, read back from them."""
    prepare(spark)
    return tokens.encode_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", encode),
]

#: The stages learn a model and hash shingles, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared work folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
