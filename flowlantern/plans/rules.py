"""Signature rules: single rules, the rule set, reports and exports of matches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from flowlantern.functions.net import round6
from flowlantern.operators import rules as op
from flowlantern.plans.base import query
from flowlantern.session import scratch_path, stored
from flowlantern.sources import fixture as fx, sinks

STATELESS_COLUMNS = ["pid", "ts_us", "source_ip", "target_ip", "signature_id", "severity", "category", "confidence", "matched_pattern"]


def _stateless(*ids):
    def run(spark, d):
        rules = [op.default_rule(i) for i in ids]
        return op.stateless_matches(fx.packets(spark, d), rules).select(*STATELESS_COLUMNS)
    return run


# (rule, severity, category, confidence, pattern text, condition)
_SIMPLE = [
    ("port_scan_xmas", "HIGH", "PORT_SCAN", 0.9, "XMAS Port Scan Detection",
     "list_sort(list_distinct(string_split(flags, ''))) = ['F', 'P', 'U']"),
    ("port_scan_null", "HIGH", "PORT_SCAN", 0.9, "NULL Port Scan Detection", "protocol = 'TCP' AND flags = ''"),
    ("icmp_tunneling", "MEDIUM", "TUNNELING", 0.9, "ICMP Tunneling", "protocol = 'ICMP' AND payload_size > 64"),
    ("suspicious_port_usage", "LOW", "SUSPICIOUS", 0.9, "Suspicious Port Usage",
     "dst_port IN (1337, 31337, 4444, 5555, 6667, 12345)"),
]
_REGEX = [
    ("suspicious_user_agent", "LOW", "SUSPICIOUS", 0.8, ".*(sqlmap|nmap|nikto|burp|metasploit).*",
     "protocol = 'TCP' AND dst_port IN (80, 443, 8080, 8443) AND regexp_matches(http_user_agent, 'sqlmap|nmap|nikto|burp|metasploit', 'i')"),
    ("c2_dns_query", "HIGH", "MALWARE", 0.8, "^[a-f0-9]{32,}\\..*",
     "protocol = 'UDP' AND dst_port = 53 AND regexp_matches(dns_query, '^[a-f0-9]{32,}\\.', 'i')"),
]


def _sql(rows):
    return "\nUNION ALL ".join(
        f"SELECT pid, ts_us, src_ip AS source_ip, dst_ip AS target_ip, '{i}' AS signature_id, '{sev}' AS severity, "
        f"'{cat}' AS category, CAST({conf} AS DOUBLE) AS confidence, '{pat}' AS matched_pattern FROM packets WHERE {cond}"
        for i, sev, cat, conf, pat, cond in rows)


for _row in _SIMPLE + _REGEX:
    query(_row[0], _sql([_row]), ("packets",))(_stateless(_row[0]))
query("simple_matcher", _sql(_SIMPLE), ("packets",))(_stateless(*[r[0] for r in _SIMPLE]))


@query("regex_matcher", f"SELECT * EXCLUDE (matched_pattern, ts_us, severity, category), CASE signature_id WHEN 'c2_dns_query' THEN dns_query ELSE http_user_agent END AS matched_text FROM ({_sql(_REGEX)}) JOIN (SELECT pid, dns_query, http_user_agent FROM packets) t USING (pid)".replace("SELECT * EXCLUDE", "SELECT * EXCLUDE").replace("(matched_pattern, ts_us, severity, category)", "(matched_pattern, ts_us, severity, category, dns_query, http_user_agent)"), ("packets",))
def regex_matcher(spark, d):
    rules = [op.default_rule("suspicious_user_agent"), op.default_rule("c2_dns_query")]
    return op.stateless_matches(fx.packets(spark, d), rules).select(
        "pid", "source_ip", "target_ip", "signature_id", "confidence", F.col("context")["matched_text"].alias("matched_text"))


# ---- behavioural rules: plain trailing frames in the oracle, slices in Spark --------------------
SYN = "protocol = 'TCP' AND contains(flags, 'S') AND NOT contains(flags, 'A')"
_BEHAVIOURAL = {
    # rule: (severity, category, tracked, key, distinct value, seconds, threshold, measure, text)
    "port_scan_basic": ("MEDIUM", "PORT_SCAN", "coalesce(dst_port <> 0, FALSE)", "src_ip, dst_ip", "dst_port", 60, 10, "d",
                        "'Port scan: ' || d || ' ports in 60.0s'"),
    "port_scan_aggressive": ("HIGH", "PORT_SCAN", "coalesce(dst_port <> 0, FALSE)", "src_ip, dst_ip", "dst_port", 30, 50, "d",
                             "'Port scan: ' || d || ' ports in 30.0s'"),
    "syn_flood": ("HIGH", "DOS", SYN, "dst_ip", "src_ip", 10, 100, "n", "'SYN flood: ' || n || ' SYN packets in 10.0s'"),
    "udp_flood": ("HIGH", "DOS", "protocol = 'UDP'", "dst_ip", None, 10, 1000, "n", "'UDP flood: ' || n || ' UDP packets in 10.0s'"),
    "icmp_flood": ("MEDIUM", "DOS", "protocol = 'ICMP'", "dst_ip", None, 10, 500, "n", "'ICMP flood: ' || n || ' ICMP packets in 10.0s'"),
    "dns_amplification": ("HIGH", "DNS_AMPLIFICATION", "protocol = 'UDP' AND coalesce(dst_port = 53, FALSE)", "src_ip", "dst_ip", 60, 50, "n",
                          "'DNS amplification: ' || n || ' queries in 60.0s'"),
    "ssh_brute_force": ("MEDIUM", "BRUTE_FORCE", "protocol = 'TCP' AND dst_port = 22", "dst_ip, dst_port", None, 300, 5, "n",
                        "'Brute force: ' || n || ' attempts in 300.0s'"),
    "rdp_brute_force": ("MEDIUM", "BRUTE_FORCE", "protocol = 'TCP' AND dst_port = 3389", "dst_ip, dst_port", None, 300, 5, "n",
                        "'Brute force: ' || n || ' attempts in 300.0s'"),
}


def behavioural_sql(rule: str, threshold: int | None = None) -> str:
    sev, cat, tracked, key, value, sec, thr, measure, text = _BEHAVIOURAL[rule]
    thr = threshold or thr
    dist = f"count(DISTINCT {value}) FILTER (tr) OVER w" if value else "0"
    only = "WHERE tr" if cat == "BRUTE_FORCE" else ""
    return f"""
SELECT pid, ts_us, src_ip AS source_ip, dst_ip AS target_ip, '{rule}' AS signature_id, '{sev}' AS severity, '{cat}' AS category,
  least({measure} / {2 * thr}, 1) AS confidence, {text} AS matched_pattern, n AS frame_count, CAST(d AS BIGINT) AS frame_distinct
FROM (SELECT *, count(*) FILTER (tr) OVER w AS n, {dist} AS d FROM (SELECT *, {tracked} AS tr FROM packets) {only}
  WINDOW w AS (PARTITION BY {key} ORDER BY ts_us RANGE BETWEEN {sec}000000 PRECEDING AND CURRENT ROW))
WHERE {measure} >= {thr}"""


def _rounded(sql: str, *extra: str) -> str:
    cols = ", ".join([*STATELESS_COLUMNS, *extra])
    return f"SELECT {cols} FROM ({sql})".replace(
        "confidence,", "floor(CAST(confidence AS DOUBLE) * 1e6 + 0.5) / 1e6 AS confidence,", 1)


def _behavioural(rule: op.Rule):
    def run(spark, d):
        m = op.behavioural_matches(fx.packets(spark, d), [rule])
        return m.select(*STATELESS_COLUMNS, "frame_count", "frame_distinct").withColumn("confidence", round6(F.col("confidence")))
    return run


for _id in _BEHAVIOURAL:
    query(_id, _rounded(behavioural_sql(_id), "frame_count", "frame_distinct"), ("packets",))(_behavioural(op.default_rule(_id)))
for _id, _thr in (("udp_flood", 100), ("icmp_flood", 3)):
    query(f"{_id}_scaled", _rounded(behavioural_sql(_id, _thr), "frame_count", "frame_distinct"), ("packets",))(
        _behavioural(op.default_rule(_id, threshold=_thr)))

ALL_SQL = ", m AS (" + "\nUNION ALL ".join(
    [_sql(_SIMPLE + _REGEX)] + [f"SELECT {', '.join(STATELESS_COLUMNS)} FROM ({behavioural_sql(i)})" for i in _BEHAVIOURAL]) + ")"


def matches(spark, d):
    return op.all_matches(fx.packets(spark, d))


@query("signature_matches", ALL_SQL + _rounded("SELECT * FROM m"), ("packets",))
def signature_matches(spark, d):
    return matches(spark, d).select(*STATELESS_COLUMNS).withColumn("confidence", round6(F.col("confidence")))


@query("match_stats", ALL_SQL + """
, g AS (
  SELECT 'category' AS dimension, category AS value, count(*) AS matches FROM m GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*) FROM m GROUP BY 2
  UNION ALL (SELECT 'source_ip', source_ip, count(*) AS c FROM m GROUP BY 2 ORDER BY c DESC, source_ip LIMIT 10)
  UNION ALL (SELECT 'target_ip', target_ip, count(*) AS c FROM m GROUP BY 2 ORDER BY c DESC, target_ip LIMIT 10)
  UNION ALL SELECT 'total', 'all', count(*) FROM m)
SELECT g.*, CASE WHEN dimension = 'total' THEN (SELECT max(ts_us) FROM m) END AS last_match_us,
  CASE WHEN dimension = 'total' THEN floor(matches * 60.0::DOUBLE / (SELECT (max(ts_us) - min(ts_us)) / 1e6 FROM m) * 1e6 + 0.5) / 1e6 END AS per_minute
FROM g
""", ("packets",))
def match_stats(spark, d):
    return op.match_stats(matches(spark, d))


@query("recent_matches", ALL_SQL + """
SELECT pid, ts_us, signature_id, source_ip FROM (SELECT * FROM m ORDER BY ts_us DESC, pid DESC, signature_id LIMIT 200) WHERE severity = 'HIGH'
""", ("packets",))
def recent_matches(spark, d):
    return op.recent_matches(matches(spark, d), 200, severity="HIGH").select("pid", "ts_us", "signature_id", "source_ip")


CUSTOM_RULES = {"signatures": [
    {"id": "proxy_ports", "name": "Proxy Ports", "description": "TCP to proxy ports", "category": "CUSTOM", "severity": "HIGH",
     "pattern": "", "pattern_type": "simple", "conditions": {"protocol": "tcp", "dst_port": [443, 8443]}, "enabled": True},
    {"id": "port_scan_xmas", "name": "XMAS with URG", "description": "replaces the default", "category": "PORT_SCAN",
     "severity": "CRITICAL", "pattern": "", "pattern_type": "simple", "conditions": {"tcp_flags": ["F"]}, "enabled": True},
    {"id": "icmp_tunneling", "name": "off", "description": "disabled", "category": "TUNNELING", "severity": "LOW",
     "pattern": "", "pattern_type": "simple", "conditions": {"protocol": "ICMP"}, "enabled": False},
    {"id": "broken", "name": "bad pattern", "description": "", "category": "CUSTOM", "severity": "LOW", "pattern": "([a-z",
     "pattern_type": "regex", "conditions": {"dns_query": True}, "enabled": True},
    {"id": "odd_type", "name": "unknown type", "description": "", "category": "CUSTOM", "severity": "LOW", "pattern": "",
     "pattern_type": "other", "conditions": {}, "enabled": True},
]}


@query("load_rules", "SELECT signature_id, severity, count(*) AS matches FROM (" + _sql([
    ("proxy_ports", "HIGH", "CUSTOM", 0.9, "", "protocol = 'TCP' AND dst_port IN (443, 8443)"),
    ("port_scan_xmas", "CRITICAL", "PORT_SCAN", 0.9, "", "flags = 'F'"), _SIMPLE[1], _SIMPLE[3], *_REGEX,
]) + ") GROUP BY 1, 2", ("packets",))
def load_rules(spark, d):
    """A rules file over the defaults, applied to all packets."""
    path = scratch_path(spark, "rules")
    spark.createDataFrame([(json.dumps(CUSTOM_RULES),)], "value string").coalesce(1).write.text(path)
    rules = op.compile_rules(op.load_rules(spark, path))
    return op.stateless_matches(fx.packets(spark, d), rules).groupBy("signature_id", "severity").agg(
        F.count("*").alias("matches"))


@query("export_matches", ALL_SQL + """
, b AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM m)
SELECT strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, signature_id, category, severity,
  CAST(floor(CAST(confidence AS DOUBLE) * 1e6 + 0.5) / 1e6 AS VARCHAR) AS confidence, source_ip, target_ip, matched_pattern
FROM m, b WHERE ts_us >= lo + 600000000 AND ts_us <= hi - 600000000
""", ("packets",))
def export_matches(spark, d):
    """Written as CSV and read back."""
    m = stored(matches(spark, d).withColumn("confidence", round6(F.col("confidence"))), "matches")
    lo, hi = m.agg(F.min("ts_us"), F.max("ts_us")).first()
    path = scratch_path(spark, "matches-csv")
    sinks.export_matches(m, path, lo + 600_000_000, hi - 600_000_000)
    return spark.read.option("header", True).csv(path).select(
        "timestamp", "signature_id", "category", "severity", "confidence", "source_ip", "target_ip", "matched_pattern")
