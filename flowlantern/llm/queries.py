"""Queries over the given tables, one for each operator, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlantern.llm import blocks, divergence, strassen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    blocks.small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: labels of two thirds of the ids teach, all documents are scored."""
    from flowlantern.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    settings = toxicity.Settings()
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held), settings)
    return (toxicity.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= settings.cut).cast("int").alias("predicted")))


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the smallest doc_id among its near duplicates; kept marks that one."""
    from flowlantern.llm import order_minhash

    found = order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_token_store")
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written shards."""
    from flowlantern.llm import token_store
    from flowlantern.session import scratch_path

    path = scratch_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, _vocabulary(), end=0)
    return token_store.scan(spark, path).withColumnRenamed("key", "doc_id")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document in sequences of 2048 tokens."""
    from flowlantern.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"), _vocabulary(), end=1)


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, benchmark_items (ids of items with a passage in the text), contaminated."""
    from flowlantern.llm import decontaminate

    found = decontaminate.flagged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "benchmark_items", (F.size("benchmark_items") > 0).alias("contaminated"))


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of a corpus, from the setting ``spark.flowlantern.surrogateKey``; a fixed one where it is unset."""
    return spark.conf.get("spark.flowlantern.surrogateKey", "surrogates").encode()


@query("op3_surrogates")
def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates in place of personal data, n_entities."""
    from flowlantern.llm import surrogates

    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 after removing windows of 13 words that an earlier document has."""
    from flowlantern.llm import debruijn

    return debruijn.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing strings of 100 bytes that start earlier."""
    from flowlantern.llm import suffix_dedup

    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


@query("op8_context_tree")
def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: six of seven ids teach, all documents are scored."""
    from flowlantern.llm import ctw

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return ctw.scored(table(spark, sf_dir, "documents"), rest != 2).withColumn("held_out", F.coalesce(rest == 2, F.lit(False))).drop("learn")


@query("op6_graph_search")
def op6_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten nearest of every vector whose id is divisible by 100."""
    from flowlantern.llm import graph_ann

    return graph_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text (the article of the page), n_chars."""
    from flowlantern.llm import html_extract

    return html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query("op12_source_divergence", divergence.SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each source from the others, and its most telling terms."""
    return divergence.audited(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", strassen.SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = strassen.mined(strassen.valid_rows(table(spark, sf_dir, "embeddings"), label=moved), F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
