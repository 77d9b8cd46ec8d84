"""Batch and streaming readers of packet records, and the warehouse tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlantern.sources.sinks import write_by_date

PACKET_SCHEMA = (
    "pid bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "packet_size int, payload_size int, flags string, ttl int, http_user_agent string, dns_query string, label int")


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Packet records with a fixed schema: no inference pass over the data."""
    return spark.read.format(fmt).schema(PACKET_SCHEMA).options(**options).load(path)


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None,
                   schema: T.StructType | str = PACKET_SCHEMA, **options: str) -> DataFrame:
    """A packet stream from a folder (or any connector by options) with event time column ``ts``."""
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path).withColumn("ts", F.timestamp_micros("ts_us"))


def with_handlers(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Call every handler with each micro-batch; batches are cached while several handlers read them."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for h in handlers:
                h(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


# ---- warehouse ----------------------------------------------------------------------------------
# ---- fixed values: tables and their columns -----------------------------------------------------
TABLES = {
    "alerts": "id string, ts_us bigint, priority string, status string, source_ip string, target_ip string, attack_type string, "
              "confidence double, details string, source string, correlation_id string, assigned_to string, resolved_us bigint, "
              "notes string, metadata string",
    "network_stats": "ts_us bigint, total_packets bigint, bytes_captured bigint, packets_per_second double, bytes_per_second double, "
                     "protocol_distribution string, top_source_ips string, top_destination_ips string, active_connections bigint, "
                     "capture_rate double",
    "signature_matches": "id string, signature_id string, signature_name string, severity string, category string, confidence double, "
                         "ts_us bigint, source_ip string, target_ip string, matched_pattern string, context string, description string",
    "detection_results": "id string, ts_us bigint, is_anomaly boolean, anomaly_score double, confidence double, "
                         "model_predictions string, detection_method string, metadata string",
    "system_logs": "ts_us bigint, level string, component string, message string, details string, source_ip string, "
                   "session_id string, user_id string, tags string",
    "user_sessions": "session_id string, user_id string, username string, ts_us bigint, last_activity_us bigint, ip_address string, "
                     "user_agent string, is_active boolean, permissions string",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a warehouse table, in order; missing ones null, nested ones as JSON text."""
    out = []
    for column in TABLES[table].split(", "):
        name, kind = column.split(" ")
        if name not in df.columns:
            out.append(F.lit(None).cast(kind).alias(name))
        elif isinstance(df.schema[name].dataType, (T.MapType, T.ArrayType, T.StructType)):
            out.append(F.to_json(name).alias(name))
        else:
            out.append(F.col(name).cast(kind).alias(name))
    return df.select(*out)


def append_table(df: DataFrame, root: str, table: str) -> None:
    write_by_date(conform(df, table), f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str, from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    """A warehouse table; date bounds prune partitions."""
    df = spark.read.schema(TABLES[table] + ", event_date date").parquet(f"{root}/{table}")
    if from_date:
        df = df.where(F.col("event_date") >= F.lit(from_date).cast("date"))
    return df.where(F.col("event_date") <= F.lit(to_date).cast("date")) if to_date else df
