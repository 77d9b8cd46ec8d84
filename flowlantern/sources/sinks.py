"""Exports and sinks. All write from the executors, one file set per export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_time(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def between(df: DataFrame, start_us: int | None, end_us: int | None, ts: str = "ts_us") -> DataFrame:
    """Rows in the time range, both ends included; an open end is None."""
    if start_us is not None:
        df = df.where(F.col(ts) >= start_us)
    return df.where(F.col(ts) <= end_us) if end_us is not None else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_matches(matches: DataFrame, path: str, start_us: int | None = None, end_us: int | None = None) -> None:
    write_csv(between(matches, start_us, end_us).select(
        iso_time(F.col("ts_us")).alias("timestamp"), "signature_id", "signature_name", "category", "severity",
        "confidence", "source_ip", "target_ip", "matched_pattern", "description"), path)


def detection_rows(detections: DataFrame, models: list[str]) -> DataFrame:
    """Detections with a column pair per model. ``predictions`` is a map from model to (prediction, confidence)."""
    per_model = [F.col("predictions")[m][f].alias(f"{m}_{f}") for m in models for f in ("prediction", "confidence")]
    meta = [F.col("metadata")[k].alias(f"meta_{k}") for k in ("source_ip", "target_ip")]
    return detections.select(
        iso_time(F.col("ts_us")).alias("timestamp"), "is_anomaly", "anomaly_score", "confidence", "detection_method",
        *per_model, *meta)


def export_detections(detections: DataFrame, models: list[str], path: str, start_us=None, end_us=None) -> None:
    write_csv(detection_rows(between(detections, start_us, end_us), models), path)


ALERT_COLUMNS = ["priority", "status", "source_ip", "target_ip", "attack_type", "confidence", "source"]


def alert_rows(alerts: DataFrame) -> DataFrame:
    """The 13 export columns; the ones an alert table does not carry are null."""
    opt = lambda c, t="string": F.col(c) if c in alerts.columns else F.lit(None).cast(t).alias(c)
    return alerts.select(
        F.col("alert_id").alias("id"), iso_time(F.col("ts_us")).alias("timestamp"), *ALERT_COLUMNS,
        opt("correlation_id"), opt("assigned_to"),
        iso_time(F.col("resolved_us")).alias("resolved_at") if "resolved_us" in alerts.columns else opt("resolved_at"),
        opt("notes"))


def export_alerts(alerts: DataFrame, path: str, fmt: str = "json", start_us=None, end_us=None) -> None:
    """CSV, or JSON lines with a one-row envelope (total and counts per priority) beside them.

    The envelope does not embed the alerts: that would gather the whole export in one row.
    """
    rows = between(alerts, start_us, end_us)
    if fmt == "csv":
        write_csv(alert_rows(rows), path)
        return
    if fmt != "json":
        raise ValueError(f"unknown export format {fmt}")
    alert_rows(rows).write.mode("overwrite").json(f"{path}/alerts")
    per = rows.groupBy("priority").agg(F.count("*").alias("n"))
    per.agg(F.sum("n").alias("total_alerts"),
            F.map_from_entries(F.collect_list(F.struct("priority", "n"))).alias("alerts_by_priority")
            ).write.mode("overwrite").json(f"{path}/envelope")


def alert_json(alerts: DataFrame) -> DataFrame:
    """One JSON text per alert, the line format of the alert file."""
    return alerts.select("alert_id", F.to_json(F.struct(
        F.col("ts_us").alias("timestamp"), F.col("alert_id"), *ALERT_COLUMNS)).alias("line"))


def append_alert_lines(alerts: DataFrame, path: str) -> None:
    alert_json(alerts).select(F.col("line").alias("value")).write.mode("append").text(path)


def log_csv_rows(logs: DataFrame, detail_keys: list[str]) -> DataFrame:
    """Log entries with ``details`` (a map) spread over ``detail_<key>`` columns."""
    return logs.select(
        iso_time(F.col("ts_us")).alias("timestamp"), "level", "component", "message", "source_ip",
        *[F.col("details")[k].alias(f"detail_{k}") for k in detail_keys])


def log_text_lines(logs: DataFrame) -> DataFrame:
    """The text layout: one block per entry, optional source and details lines, a blank line."""
    head = F.format_string("[%s] %s %s: %s\n", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss"),
                           F.col("level"), F.col("component"), F.col("message"))
    src = F.when(F.col("source_ip").isNotNull(), F.concat(F.lit("  Source IP: "), F.col("source_ip"), F.lit("\n")))
    det = F.when(F.size("details") > 0, F.concat(F.lit("  Details: "), F.to_json("details"), F.lit("\n")))
    return logs.select("log_id", "ts_us", F.concat(head, F.coalesce(src, F.lit("")), F.coalesce(det, F.lit(""))).alias("block"))


def export_logs(logs: DataFrame, path: str, fmt: str = "json", detail_keys: list[str] | None = None) -> None:
    """Ascending by time across the files: a range-partitioned sort, so part files are in order."""
    ordered = logs.orderBy("ts_us", "log_id")
    if fmt == "csv":
        write_csv(log_csv_rows(ordered, detail_keys or []), path)
    elif fmt == "txt":
        log_text_lines(ordered).select("block").write.mode("overwrite").text(path)
    elif fmt == "json":
        ordered.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def write_by_date(df: DataFrame, path: str, ts: str = "ts_us", mode: str = "append") -> None:
    """Warehouse layout: Parquet partitioned by date, sorted by time within files, in place of time indexes.

    Rows are range-partitioned by date and time, so one heavy day is written by as many tasks as its size needs.
    """
    dated = df.withColumn("event_date", F.to_date(F.timestamp_micros(ts)))
    dated.repartitionByRange("event_date", ts).sortWithinPartitions("event_date", ts).write.mode(
        mode).partitionBy("event_date").parquet(path)


def write_batch(batch: DataFrame, path: str, number: int) -> None:
    """A micro-batch into its own folder ``batch_id=number``: a batch that is run again after a failure replaces what it wrote before."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={number}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``write_batch`` stored."""
    return spark.read.parquet(path).drop("batch_id")
