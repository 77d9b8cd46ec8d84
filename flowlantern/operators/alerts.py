"""Alerts: creation, admission (rate limit and de-duplication), correlation, actions, lists and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS, SECOND, Thresholds
from flowlantern.functions.net import ratio, round6
from flowlantern.operators.limits import SlidingLimit
from flowlantern.operators.ordered import ordered_scan
from flowlantern.operators.sessions import session_starts, slices

PRIORITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_COLUMNS = [
    "alert_id", "ts_us", "priority", "status", "source_ip", "target_ip", "attack_type", "confidence", "source", "details",
]


def priority_from_confidence(c: Column) -> Column:
    return F.when(c >= 0.9, "CRITICAL").when(c >= 0.8, "HIGH").when(c >= 0.7, "MEDIUM").otherwise("LOW")


def priority_rank(p: Column) -> Column:
    """LOW 1 to CRITICAL 4."""
    return F.when(p == "CRITICAL", 4).when(p == "HIGH", 3).when(p == "MEDIUM", 2).otherwise(1)


def _alert_id(*parts: Column | str) -> Column:
    """A deterministic id, so that retried tasks and re-runs give the same alert."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def alerts_from_matches(matches: DataFrame) -> DataFrame:
    sev = F.upper("severity")
    return matches.select(
        _alert_id(F.lit("match"), F.col("pid").cast("string"), F.col("signature_id")).alias("alert_id"), "ts_us",
        F.when(sev.isin(PRIORITIES), sev).otherwise("MEDIUM").alias("priority"), F.lit("NEW").alias("status"),
        "source_ip", "target_ip", F.lower("category").alias("attack_type"), "confidence",
        F.lit("signature_engine").alias("source"),
        F.map_concat(
            F.create_map(
                F.lit("signature_id"), F.col("signature_id"), F.lit("signature_name"), F.col("signature_name"),
                F.lit("matched_pattern"), F.col("matched_pattern"), F.lit("category"), F.col("category"),
                F.lit("description"), F.col("description")),
            F.transform_keys("context", lambda k, v: F.concat(F.lit("context."), k)),
        ).alias("details"))


def alerts_from_detections(det: DataFrame) -> DataFrame:
    return det.where("is_anomaly").select(
        _alert_id(F.lit("detection"), F.col("pid").cast("string")).alias("alert_id"), "ts_us",
        priority_from_confidence(F.col("confidence")).alias("priority"), F.lit("NEW").alias("status"),
        F.coalesce(F.col("metadata")["source_ip"], F.lit("unknown")).alias("source_ip"),
        F.col("metadata")["target_ip"].alias("target_ip"), F.lit("anomaly_detection").alias("attack_type"),
        "confidence", F.lit("ml_detection").alias("source"),
        F.create_map(F.lit("anomaly_score"), F.col("anomaly_score").cast("string"),
                     F.lit("detection_method"), F.col("detection_method"),
                     F.lit("model_predictions"), F.to_json("predictions")).alias("details"))


def manual_alerts(reports: DataFrame) -> DataFrame:
    """``reports``: report_id, ts_us, priority, source_ip, target_ip, attack_type, description."""
    return reports.select(
        _alert_id(F.lit("manual"), F.col("report_id").cast("string")).alias("alert_id"), "ts_us", "priority",
        F.lit("NEW").alias("status"), "source_ip", "target_ip", "attack_type", F.lit(1.0).alias("confidence"),
        F.lit("manual").alias("source"), F.create_map(F.lit("description"), F.col("description")).alias("details"))


# ---- admission ----------------------------------------------------------------------------------
# The rate limit counts alerts it let through, per (source, type); what it lets through is de-duplicated per (source, type,
# priority): an alert passes unless one passed less than a frame before. Both are :class:`SlidingLimit`.
def _rate_limited(rows: DataFrame, th: Thresholds) -> DataFrame:
    keyed = rows.withColumn("admission_key", F.concat_ws("|", "source_ip", "attack_type"))
    rule = SlidingLimit(th.rate_limit, th.rate_window_us, "admission_key", "rate_limited")
    return ordered_scan(keyed, rule, ["ts_us", "alert_id"]).drop("admission_key")


def _deduplicated(rows: DataFrame, th: Thresholds) -> DataFrame:
    keyed = rows.withColumn("admission_key", F.concat_ws("|", "source_ip", "attack_type", F.coalesce("priority", F.lit("\0"))))
    rule = SlidingLimit(1, th.dedup_window_us - 1, "admission_key", "duplicate")  # passes again after exactly a frame
    return ordered_scan(keyed, rule, ["ts_us", "alert_id"]).drop("admission_key")


def admission(alerts: DataFrame, th: Thresholds = DEFAULTS, rate_limit: bool = True, dedup: bool = True) -> DataFrame:
    """All alerts with the flags ``rate_limited`` and ``duplicate``; admitted alerts have neither."""
    no = F.lit(False)
    if not dedup:
        return (_rate_limited(alerts, th) if rate_limit else alerts.withColumn("rate_limited", no)).withColumn("duplicate", no)
    if not rate_limit:
        return _deduplicated(alerts, th).withColumn("rate_limited", no)
    limited = _rate_limited(alerts, th)
    names = [*alerts.columns, "rate_limited", "duplicate"]
    # the second scan reads only what the first let through: at most ``rate_limit`` alerts of a key in a frame
    return _deduplicated(limited.where(~F.col("rate_limited")), th).select(*names).union(
        limited.where("rate_limited").withColumn("duplicate", no).select(*names))


def admitted(alerts: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    passed = _rate_limited(alerts, th).where(~F.col("rate_limited")).drop("rate_limited")
    return _deduplicated(passed, th).where(~F.col("duplicate")).drop("duplicate")


# ---- correlation --------------------------------------------------------------------------------
# The similarity test (mean of source, type and target hits and of 1 - dt/300, at least 0.8) is met exactly when all
# three match and dt <= 240 s; without a target (which scores half), when dt <= 90 s. So groups are idle sessions
# of (source, type, target).
_KEY = ["source_ip", "attack_type", "target_key"]


def _correlation_slices(alerts: DataFrame, th: Thresholds) -> DataFrame:
    gap = _gap(th)
    rows = alerts.where(F.col("attack_type").isin(*th.correlated_types)).withColumn(
        "target_key", F.coalesce("target_ip", F.lit("")))
    sl = slices(rows, _KEY, gap, [F.count("*").alias("n"), F.max(priority_rank(F.col("priority"))).alias("severity")])
    return session_starts(sl, _KEY, gap).withColumn(
        "correlation_id", _alert_id(F.lit("group"), *_KEY, F.col("session_us").cast("string")))


def _gap(th: Thresholds) -> Column:
    return F.when(F.col("target_key") == "", th.correlation_gap_no_target_us).otherwise(th.correlation_gap_us)


def correlation_groups(alerts: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """One row per group. The member ids are a table of their own (:func:`correlation_members`), not a list."""
    return _correlation_slices(alerts, th).groupBy("correlation_id", *_KEY).agg(
        F.min("slice_first").alias("first_seen_us"), F.max("slice_last").alias("last_seen_us"),
        F.sum("n").alias("alert_count"), F.max("severity").alias("severity_score"),
    ).select(
        "correlation_id", "source_ip", "attack_type", F.nullif("target_key", F.lit("")).alias("target_ip"),
        "first_seen_us", "last_seen_us", "alert_count", "severity_score",
        F.concat(F.lit("Correlated "), "attack_type", F.lit(" activity")).alias("description"),
        F.lit(1.0).alias("correlation_confidence"))


def correlation_members(alerts: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Every alert with the id of its group, null for types that do not correlate."""
    groups = _correlation_slices(alerts, th).select(*_KEY, "slice", "correlation_id")
    rows = alerts.withColumn("target_key", F.coalesce("target_ip", F.lit("")))
    rows = rows.withColumn("slice", F.floor(F.col("ts_us") / _gap(th)).cast("bigint"))
    return rows.join(groups, [*_KEY, "slice"], "left").drop("target_key", "slice")


def top_correlations(groups: DataFrame, limit: int = 50) -> DataFrame:
    return groups.orderBy(F.desc("severity_score"), F.desc("alert_count"), "first_seen_us", "correlation_id").limit(limit)


# ---- actions, lists, statistics -----------------------------------------------------------------
def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Fold an action log (alert_id, action ACKNOWLEDGE/RESOLVE, actor, notes, at_us) into the alerts."""
    act = F.col("action")
    latest = actions.groupBy("alert_id").agg(
        F.max_by(act, "at_us").alias("last_action"),
        F.max_by(F.when(act == "ACKNOWLEDGE", F.col("actor")), F.when(act == "ACKNOWLEDGE", F.col("at_us"))).alias("assigned_to"),
        F.max_by(F.when(act == "RESOLVE", F.col("notes")), F.when(act == "RESOLVE", F.col("at_us"))).alias("notes"),
        F.max(F.when(act == "RESOLVE", F.col("at_us"))).alias("resolved_us"))
    new_status = F.when(F.col("last_action") == "RESOLVE", "RESOLVED").when(
        F.col("last_action") == "ACKNOWLEDGE", "ACKNOWLEDGED")
    base = alerts.drop("assigned_to", "notes", "resolved_us")
    return base.join(latest, "alert_id", "left").withColumn("status", F.coalesce(new_status, F.col("status"))).drop("last_action")


def list_alerts(alerts: DataFrame, status=None, priority=None, attack_type=None, source_ip=None, alert_id=None,
                since_us: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Filters first, then newest first, then the page."""
    for col, v in (("status", status), ("priority", priority), ("attack_type", attack_type), ("source_ip", source_ip),
                   ("alert_id", alert_id)):
        if v is not None:
            alerts = alerts.where(F.col(col) == v)
    if since_us is not None:
        alerts = alerts.where(F.col("ts_us") >= since_us)
    return alerts.orderBy(F.desc("ts_us"), F.desc("alert_id")).offset(offset).limit(limit)


def is_active() -> Column:
    return F.col("status") != "RESOLVED"


def active_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """Unresolved alerts with their place in the list: most severe first, newest first."""
    out = alerts.where(is_active()).orderBy(F.desc(priority_rank(F.col("priority"))), F.desc("ts_us"), F.desc("alert_id"))
    return out.limit(limit) if limit else out


RANGES_US = {"24h": 86_400 * SECOND, "7d": 7 * 86_400 * SECOND, "30d": 30 * 86_400 * SECOND}


def alerts_in_range(alerts: DataFrame, window_us: int, as_of: int | None = None) -> DataFrame:
    now = F.lit(as_of) if as_of is not None else alerts.agg(F.max("ts_us")).scalar()
    return alerts.where(F.col("ts_us") >= now - window_us)


def alert_stats(alerts: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals, alerts of the last hour, mean time to resolution, number of groups: one row."""
    a = alerts.withColumn("as_of", alerts.agg(F.max("ts_us")).scalar())
    done = F.col("status") == "RESOLVED"
    return a.agg(
        F.count("*").alias("total_alerts"), F.count_if(~done).alias("active_alerts"),
        F.count_if(done).alias("resolved_alerts"),
        F.count_if(F.col("as_of") - F.col("ts_us") <= 3600 * SECOND).alias("alerts_per_hour"),
        round6(F.coalesce(F.avg(F.when(done, (F.col("resolved_us") - F.col("ts_us")) / SECOND)), F.lit(0.0)))
        .alias("average_resolution_time"),
    ).withColumn("correlation_groups", groups.agg(F.count("*")).scalar())


def alert_breakdown(alerts: DataFrame, k: int = 10) -> DataFrame:
    """Counts by priority, type and source, and the top k source addresses, from one pass."""
    dims = [("priority", "priority"), ("attack_type", "attack_type"), ("source", "source"), ("source_ip", "source_ip")]
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in dims])).alias("x")
    g = alerts.select(x).groupBy("x.dimension", "x.value").agg(F.count("*").alias("alerts"))
    top = g.where(F.col("dimension") == "source_ip").orderBy(F.desc("alerts"), "value").limit(k)
    return g.where(F.col("dimension") != "source_ip").unionByName(top)


def retain(alerts: DataFrame, as_of: Column, th: Thresholds = DEFAULTS) -> DataFrame:
    """Drops resolved alerts older than the retention time."""
    return alerts.where(~((F.col("status") == "RESOLVED") & (F.col("ts_us") < as_of - th.retention_us)))


def retain_groups(groups: DataFrame, as_of: Column, th: Thresholds = DEFAULTS) -> DataFrame:
    return groups.where(F.col("last_seen_us") >= as_of - th.retention_us)


CHART_TYPES = ["port_scan", "dos", "brute_force", "anomaly_detection"]


def attack_chart(alerts: DataFrame) -> DataFrame:
    """Count of each charted type and its share of the largest count, in percent."""
    counts = alerts.agg(*[F.count_if(F.col("attack_type") == t).alias(t) for t in CHART_TYPES])
    top = F.greatest(*CHART_TYPES, F.lit(1))
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(t).alias("attack_type"), F.col(t).alias("alerts"), round6(ratio(F.col(t) * 100.0, top)).alias("percent"))
        for t in CHART_TYPES])).alias("x")).select("x.*")
