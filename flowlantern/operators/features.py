"""Feature tables for models: fixed column sets, scaling, online statistics, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.functions import net

# ---- fixed values: feature names in model order -------------------------------------------------
FLOW_NUMERICAL = [
    "packet_count", "byte_count", "duration", "packets_per_second", "bytes_per_second", "avg_inter_arrival_time",
    "std_inter_arrival_time", "avg_packet_size", "std_packet_size", "min_packet_size", "max_packet_size",
    "src_to_dst_packets", "dst_to_src_packets", "src_to_dst_bytes", "dst_to_src_bytes", "port_scan_indicator",
    "syn_flood_ratio", "burstiness", "regularity", "src_port", "dst_port", "ttl",
]
FLOW_CATEGORICAL = ["protocol", "src_port_category", "dst_port_category"]
FLOW_BINARY = [
    "is_internal_src", "is_internal_dst", "is_well_known_port", "direction_bias", "is_long_duration",
    "has_large_packets", "has_high_packet_count",
]
FLOW_FEATURES = FLOW_NUMERICAL + FLOW_CATEGORICAL + FLOW_BINARY
WINDOW_NUMERICAL = [
    "total_packets", "total_bytes", "unique_sources", "unique_destinations", "unique_ports", "new_flows_per_second",
    "avg_flow_duration", "flow_diversity", "port_scan_score", "dos_score", "data_exfiltration_score",
    "unusual_protocol_score", "tcp_ratio", "udp_ratio", "icmp_ratio",
]
WINDOW_CATEGORICAL = ["time_category", "dominant_protocol"]
WINDOW_BINARY = [
    "is_high_traffic", "has_many_sources", "has_many_destinations", "has_port_scan", "has_dos",
    "has_data_exfiltration", "has_unusual_protocol",
]
WINDOW_FEATURES = WINDOW_NUMERICAL + WINDOW_CATEGORICAL + WINDOW_BINARY


def ml_flow_features(flows: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """The 32 flow features as doubles, with the flow id and label, and the columns ``keep``. Flows without a ttl get 0."""
    c = F.col
    derived = {
        "ttl": F.coalesce(c("ttl"), F.lit(0)) if "ttl" in flows.columns else F.lit(0),
        "protocol": net.protocol_code(c("protocol")),
        "src_port_category": net.port_category(c("src_port")), "dst_port_category": net.port_category(c("dst_port")),
        "direction_bias": c("src_to_dst_packets") > c("dst_to_src_packets"), "is_long_duration": c("duration") > 30.0,
        "has_large_packets": c("avg_packet_size") > 1000, "has_high_packet_count": c("packet_count") > 100,
    }
    return flows.select(
        c("flow_pid").alias("pid"), *[derived.get(f, c(f)).cast("double").alias(f) for f in FLOW_FEATURES], "label", *keep)


def ml_window_features(windows: DataFrame) -> DataFrame:
    """The 24 window features. Dominant protocol: the largest share, the first name on ties."""
    c = F.col
    shares = F.array(*[F.struct((-c(f"{p.lower()}_ratio")).alias("s"), F.lit(p).alias("p")) for p in ("ARP", "ICMP", "TCP", "UDP")])
    derived = {
        "time_category": net.time_of_day(c("window_us")), "dominant_protocol": net.protocol_code(F.array_min(shares)["p"]),
        "is_high_traffic": c("total_packets") > 1000, "has_many_sources": c("unique_sources") > 100,
        "has_many_destinations": c("unique_destinations") > 100, "has_port_scan": c("port_scan_score") > 0.5,
        "has_dos": c("dos_score") > 0.5, "has_data_exfiltration": c("data_exfiltration_score") > 0.5,
        "has_unusual_protocol": c("unusual_protocol_score") > 0.5,
    }
    return windows.select("window_us", *[derived.get(f, c(f)).cast("double").alias(f) for f in WINDOW_FEATURES])


# ---- scaling: fit is one aggregation to one row, transform is a projection ----------------------
def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """(centre, divisor) per column: mean and population deviation, 1 for constant columns."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def fit_minmax(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """(minimum, range) per column, range 1 for constant columns."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.min), ("x", F.max))]).first()
    return {c: (row[f"m{i}"], (row[f"x{i}"] - row[f"m{i}"]) or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((F.col(c) - params[c][0]) / params[c][1]).alias(c) if c in params else F.col(c) for c in df.columns])


# ---- statistics that merge over batches ---------------------------------------------------------
def batch_stats(df: DataFrame, cols: list[str], batch: Column) -> DataFrame:
    """Count, sum and sum of squares per (batch, feature): one wide aggregation, then a small unpivot."""
    wide = df.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("n"), *[f.alias(f"{p}_{c}") for c in cols for p, f in (("s", F.sum(c)), ("q", F.sum(F.col(c) * F.col(c))))])
    return wide.select("batch", "n", F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"s_{c}").alias("total"), F.col(f"q_{c}").alias("total_sq")) for c in cols])).alias("x")
    ).select("batch", "n", "x.*")


def merge_stats(stats: DataFrame) -> DataFrame:
    """Statistics of any number of batches, merged: mean and population deviation, never below 0."""
    g = stats.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("total_sq").alias("total_sq"))
    mean = F.col("total") / F.col("n")
    var = F.greatest(F.col("total_sq") / F.col("n") - mean * mean, F.lit(0.0))
    return g.select("feature", "n", mean.alias("mean"), F.sqrt(var).alias("sd"))


def apply_online(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """z-scores with stored statistics, else with those of the batch itself; constant columns are only centred."""
    if stats is None:
        params = fit_standard(df, cols)
    else:
        known = {r.feature: (r.mean, r.sd or 1.0) for r in stats.where(F.col("feature").isin(cols)).collect()}
        rest = [c for c in cols if c not in known]
        params = known | (fit_standard(df, rest) if rest else {})
    return scale(df, params)


# ---- selection ----------------------------------------------------------------------------------
def f_scores(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """ANOVA F per feature from per-class counts, sums and sums of squares (one pass, one row per class)."""
    per = batch_stats(df, cols, F.col(label))
    g = per.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("total").alias("t"), F.sum("total_sq").alias("q"),
        F.sum(F.col("total") * F.col("total") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("t") * F.col("t") / F.col("n")
    within = F.col("q") - F.col("b")
    score = (between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))
    return g.select("feature", F.when((F.col("k") > 1) & (within > 0), score).otherwise(0.0).alias("score"))


def mutual_information(df: DataFrame, cols: list[str], label: str = "label", bins: int = 10) -> DataFrame:
    """Mutual information (nats) between the label and each feature cut at its approximate quantiles."""
    cuts = df.stat.approxQuantile(cols, [i / bins for i in range(1, bins)], 0.001)
    binned = F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), sum(((F.col(c) > x).cast("int") for x in sorted(set(q))), F.lit(0)).alias("bin"))
        for c, q in zip(cols, cuts)])).alias("x")
    cell = df.select(F.col(label).alias("y"), binned).groupBy("x.feature", "x.bin", "y").agg(F.count("*").alias("n"))
    # at most bins x classes cells per feature from here on
    by_bin = cell.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = cell.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = cell.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = reduce(lambda a, b: a.join(*b), [(by_bin, ["feature", "bin"]), (by_y, ["feature", "y"]), (total, "feature")], cell)
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))
    return j.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score"))


def top_features(scores: DataFrame, k: int = 20) -> DataFrame:
    """The k best features; their names are what selection keeps."""
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def select_features(df: DataFrame, scores: DataFrame, k: int = 20, keep: tuple[str, ...] = ("pid", "label")) -> DataFrame:
    chosen = {r.feature for r in top_features(scores, k).collect()}
    return df.select(*[c for c in df.columns if c in keep or c in chosen])


def dataset_metadata(flows: DataFrame) -> DataFrame:
    """Samples, distinct sources, mean duration, protocol and class counts."""
    counts = lambda col: flows.groupBy(F.col(col).cast("string").alias("k")).agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).scalar()  # a handful of distinct values
    return flows.agg(
        F.count("*").alias("samples"), F.count_distinct("src_ip").alias("sources"), F.avg("duration").alias("mean_duration"),
    ).select("*", counts("protocol").alias("protocol_distribution"), counts("label").alias("class_distribution"))
