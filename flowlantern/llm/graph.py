"""Connected components over tables of links, by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlantern.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a fresh table in the shared checkpoint folder and reads it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Each round a node takes the smallest root among its neighbours, then the root of that root, so paths halve. A hub with very many
    links only meets partial minima. Links with a null end, and from a node to itself, connect nothing.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = stored(links.union(links.select("b", "a")).distinct(), "edges")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
    while True:
        roots = stored(roots, "roots")
        seen = edges.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(seen, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        step = stored(step, "step")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if not step.where("root <> old").limit(1).count():
            return roots
        roots = step.join(up, "root").select("node", F.least("root", "above").alias("root"))
