"""Corpus preparation in five stages over ``documents``: each stage works on all that the one before it kept.

toxicity drops documents scored as toxic; near_duplicates keeps the first row of each class of texts, also where rows
share an id; decontamination drops documents that
hold a benchmark passage; surrogates replaces personal data; packing cuts what is left into sequences. All but the last return
the columns of ``documents``. Null and empty texts pass all filters and are packed as their end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlantern.llm import decontaminate, order_minhash, packing, queries, surrogates, toxicity
from flowlantern.llm.graph import stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.blocks.small_batches(spark)
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "__score").where(F.col("__score") < toxicity.Settings().cut).drop("__score")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.blocks.small_batches(spark)
    return order_minhash.first_copies(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.blocks.small_batches(spark)
    found = decontaminate.flagged(docs, queries.table(spark, sf_dir, "benchmark"), "__items")
    return found.where(F.size("__items") == 0).drop("__items")


def surrogates_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.blocks.small_batches(spark)
    new = surrogates.replaced(docs, queries.surrogate_key(spark), "__n").drop("__n")
    return new.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else new


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.blocks.small_batches(spark)
    return packing.packed(docs, queries._vocabulary(), end=1)


STAGES = [("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("decontamination", benchmark_out),
          ("surrogates", surrogates_in), ("packing", packed)]
ORACLE_SQL = None  # compression, sketches, keyed draws and a tokenizer have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
