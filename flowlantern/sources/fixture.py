"""Packet, log, alert, vote and delivery tables derived from the ``events`` table.

One SQL text per view serves both engines: the placeholders hold the few spots where the dialects differ.
The views are narrow projections (no shuffle), so every query on them scales with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlantern.session import scratch_path
from flowlantern.sources.readers import read_packets

_SPARK = {
    "K": "CAST(get_json_object(props, '$.k') AS INT)",
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "D0_DIV_1000": "d0 div 1000",
    "D_DIV_600S": "(d div 600000000)",
    "STR": "STRING",
    # evaluated once per row behind a generator: filters above cannot copy the class expression into themselves
    "C": "(SELECT x.* FROM c LATERAL VIEW inline(array(struct(pid, u, k, d, blk, cls))) x AS pid, u, k, d, blk, cls)",
    "PID_DIV_6": "(pid div 6)",
    "A_DIV_1000": "((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) div 1000)",
}
_DUCKDB = {
    "K": "CAST(json_extract(props, '$.k') AS INT)",
    "US": "epoch_us(ts)",
    "D0_DIV_1000": "d0 // 1000",
    "D_DIV_600S": "(d // 600000000)",
    "STR": "VARCHAR",
    "C": "c",
    "PID_DIV_6": "(pid // 6)",
    "A_DIV_1000": "((epoch_us(ts) - 1704067200000000) // 1000)",
}

PACKETS = """
WITH r AS (
  SELECT event_id AS pid, user_id AS u, {K} AS k, {US} - 1704067200000000 AS d0 FROM events
), b AS (
  SELECT pid, u, k, {D0_DIV_1000} AS d FROM r                      -- 30 days squeezed 1000x -> 2592 s
), c AS (
  SELECT *, {D_DIV_600S} * 600000000 AS blk,
    CASE WHEN k < 6 THEN 'scan' WHEN k < 14 THEN 'syn' WHEN k < 22 THEN 'udpf' WHEN k < 26 THEN 'dns'
         WHEN k < 29 THEN 'ssh' WHEN k < 31 THEN 'rdp' WHEN k < 34 THEN 'tunnel' WHEN k = 34 THEN 'xmas'
         WHEN k = 35 THEN 'null' WHEN k = 36 THEN 'fin' WHEN k = 37 THEN 'badport' WHEN k = 38 THEN 'c2'
         WHEN k = 39 THEN 'ua' WHEN k = 40 THEN 'arp' WHEN pid % 10 < 7 THEN 'web'
         WHEN pid % 10 < 9 THEN 'ntp' ELSE 'ping' END AS cls
  FROM b
), e AS (
  SELECT pid, k, cls,
    1704067200000000 + CASE cls
      WHEN 'syn'  THEN blk +             (pid * 37 % 5000)  * 1000
      WHEN 'udpf' THEN blk +  60000000 + (pid * 37 % 5000)  * 1000
      WHEN 'scan' THEN blk + 120000000 + (pid * 37 % 20000) * 1000
      WHEN 'dns'  THEN blk + 180000000 + (pid * 37 % 20000) * 1000
      ELSE d END AS ts_us,
    CASE WHEN cls = 'scan' THEN '203.0.113.7'
         WHEN cls IN ('ssh', 'rdp') THEN concat('198.51.100.', CAST(u % 4 AS {STR}))
         WHEN cls IN ('syn', 'udpf') THEN concat('198.51.100.', CAST(u % 200 AS {STR}))
         WHEN cls = 'dns' THEN '10.0.1.9'
         ELSE concat('10.0.', CAST(u % 4 AS {STR}), '.', CAST(u % 250 AS {STR})) END AS a_ip,
    CASE WHEN cls = 'scan' THEN '10.0.0.5' WHEN cls = 'syn' THEN '10.0.0.80' WHEN cls = 'udpf' THEN '10.0.0.53'
         WHEN cls IN ('ssh', 'rdp') THEN '10.0.0.22' WHEN cls IN ('dns', 'c2') THEN '8.8.8.8'
         ELSE concat('93.184.0.', CAST(u % 7 AS {STR})) END AS b_ip,
    CASE WHEN cls IN ('tunnel', 'arp', 'ping') THEN NULL WHEN cls IN ('web', 'ntp') THEN 40000 + u % 2000
         ELSE 1024 + pid * 13 % 50000 END AS a_port,
    CASE WHEN cls IN ('tunnel', 'arp', 'ping') THEN NULL WHEN cls = 'scan' THEN 1 + pid * 7 % 2000
         WHEN cls IN ('syn', 'ua') THEN 80 WHEN cls = 'udpf' THEN 9000 WHEN cls IN ('dns', 'c2') THEN 53
         WHEN cls = 'ssh' THEN 22 WHEN cls = 'rdp' THEN 3389 WHEN cls = 'badport' THEN 4444
         WHEN cls = 'ntp' THEN 123 ELSE 443 END AS b_port,
    cls IN ('web', 'ntp', 'ping') AND pid % 3 = 0 AS is_reply
  FROM {C}
)
SELECT pid, cls, ts_us,
  CASE WHEN is_reply THEN b_ip ELSE a_ip END AS src_ip,
  CASE WHEN is_reply THEN a_ip ELSE b_ip END AS dst_ip,
  CAST(CASE WHEN is_reply THEN b_port ELSE a_port END AS INT) AS src_port,
  CAST(CASE WHEN is_reply THEN a_port ELSE b_port END AS INT) AS dst_port,
  CASE WHEN cls IN ('udpf', 'dns', 'c2', 'ntp') THEN 'UDP' WHEN cls IN ('tunnel', 'ping') THEN 'ICMP'
       WHEN cls = 'arp' THEN 'ARP' ELSE 'TCP' END AS protocol,
  CAST(60 + pid * 31 % 1400 AS INT) AS packet_size,
  CAST(CASE WHEN cls = 'arp' THEN 0 WHEN cls = 'ping' THEN 56 ELSE 40 + pid * 31 % 1400 END AS INT) AS payload_size,
  CASE WHEN cls IN ('scan', 'syn', 'ssh', 'rdp') THEN 'S' WHEN cls = 'xmas' THEN 'FPU' WHEN cls = 'fin' THEN 'F'
       WHEN cls IN ('badport', 'ua') THEN 'PA' WHEN cls <> 'web' THEN '' WHEN pid % 10 = 0 THEN 'S'
       WHEN pid % 10 = 1 THEN 'SA' WHEN pid % 10 = 2 THEN 'FA' WHEN pid % 10 = 3 THEN 'RA' ELSE 'PA' END AS flags,
  CAST(32 + pid % 96 AS INT) AS ttl,
  CASE WHEN cls = 'ua' THEN 'sqlmap/1.7' WHEN cls = 'web' THEN 'Mozilla/5.0' END AS http_user_agent,
  CASE WHEN cls = 'c2' THEN concat(md5(CAST(pid AS {STR})), '.bad.example')
       WHEN cls = 'dns' THEN concat('host', CAST(pid % 50 AS {STR}), '.example') END AS dns_query,
  CASE WHEN k < 41 THEN 1 ELSE 0 END AS label
FROM e
"""

LOGS_FX = """
SELECT event_id AS log_id, {US} AS ts_us,
  CASE WHEN event_id % 20 = 0 THEN 'CRITICAL' WHEN event_id % 20 < 4 THEN 'ERROR' WHEN event_id % 20 < 7 THEN 'WARNING'
       WHEN event_id % 20 < 18 THEN 'INFO' ELSE 'DEBUG' END AS level,
  CASE event_id % 5 WHEN 0 THEN 'network_monitor' WHEN 1 THEN 'ml_detection' WHEN 2 THEN 'alert_system'
       WHEN 3 THEN 'web_interface' ELSE 'config' END AS component,
  concat(event_type, ' by user ', CAST(user_id AS {STR})) AS message, props AS details,
  CASE WHEN event_id % 3 > 0 THEN concat('10.0.0.', CAST(user_id % 50 AS {STR})) END AS source_ip
FROM events
"""

ALERTS_FX = """
SELECT event_id AS alert_id, 1704067200000000 + {A_DIV_1000} AS ts_us,
  concat('10.0.0.', CAST(user_id % 5 AS {STR})) AS source_ip,
  CASE WHEN event_id % 13 > 0 THEN concat('10.9.0.', CAST(user_id % 2 AS {STR})) END AS target_ip,
  CASE event_id % 5 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'dos' WHEN 2 THEN 'brute_force'
       WHEN 3 THEN 'anomaly_detection' ELSE 'suspicious' END AS attack_type,
  CASE WHEN event_id * 7 % 100 < 10 THEN 'CRITICAL' WHEN event_id * 7 % 100 < 30 THEN 'HIGH'
       WHEN event_id * 7 % 100 < 60 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CAST(event_id * 7 % 100 AS DOUBLE) / 100 AS confidence,
  CASE event_id % 3 WHEN 0 THEN 'ml_detection' WHEN 1 THEN 'signature_engine' ELSE 'manual' END AS source,
  CASE WHEN event_id % 10 < 5 THEN 'NEW' WHEN event_id % 10 < 7 THEN 'ACKNOWLEDGED' WHEN event_id % 10 = 7 THEN 'INVESTIGATING'
       WHEN event_id % 10 = 8 THEN 'RESOLVED' ELSE 'FALSE_POSITIVE' END AS status,
  CASE WHEN event_id % 10 = 8 THEN 1704067200000000 + {A_DIV_1000} + (event_id % 900) * 1000000 END AS resolved_us
FROM events
"""

VOTES_FX = """
SELECT pid, label, 'random_forest' AS model, CASE WHEN pid % 11 = 0 THEN 1 - label ELSE label END AS vote FROM packets
UNION ALL SELECT pid, label, 'isolation_forest', CASE WHEN pid % 7 = 0 THEN 1 - label ELSE label END FROM packets
UNION ALL SELECT pid, label, 'one_class_svm', CASE WHEN pid % 5 = 0 THEN 1 - label ELSE label END FROM packets
"""

DELIVERIES_FX = """
SELECT alert_id, channel, CASE WHEN (alert_id * 31 + rank) % 17 = 0 THEN FALSE ELSE TRUE END AS success,
  (alert_id + rank) % 4 AS retry_count, ts_us + rank * 1000 AS ts_us
FROM alerts_fx CROSS JOIN (SELECT 'syslog' AS channel, 1 AS rank UNION ALL SELECT 'console', 2 UNION ALL SELECT 'file', 3) ch
"""

HEADERS_FX = """
SELECT *,
  CASE WHEN protocol = 'ICMP' THEN CASE pid % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 8 WHEN 4 THEN 11 ELSE 99 END END AS icmp_type,
  CASE WHEN protocol = 'ICMP' THEN CAST({PID_DIV_6} % 8 AS INT) END AS icmp_code,
  CASE WHEN protocol = 'UDP' AND dst_port = 53 THEN CAST(pid % 6 AS INT) END AS dns_rcode,
  CASE WHEN protocol = 'TCP' THEN pid * 1009 % 4294967296 END AS tcp_seq,
  CASE WHEN protocol = 'TCP' THEN 1024 + pid % 64000 END AS tcp_window,
  CASE WHEN protocol = 'TCP' THEN pid % 5 END AS tcp_options,
  CASE WHEN protocol = 'UDP' THEN 8 + payload_size END AS udp_length,
  CASE WHEN protocol = 'UDP' THEN pid * 7 % 65536 END AS udp_checksum
FROM packets
"""


_VIEWS = {
    "headers_fx": HEADERS_FX,
    "packets": PACKETS, "logs_fx": LOGS_FX, "alerts_fx": ALERTS_FX, "votes_fx": VOTES_FX,
    "deliveries_fx": DELIVERIES_FX,
}
_NEEDS = {"votes_fx": ["packets"], "deliveries_fx": ["alerts_fx"], "headers_fx": ["packets"]}


def _render(name: str, dialect: dict[str, str]) -> str:
    sql = _VIEWS[name]
    for k, v in dialect.items():
        sql = sql.replace("{" + k + "}", v)
    return sql.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    sql = _render(name, _SPARK)
    args = {"events": table(spark, sf_dir, "events")} if name not in _NEEDS else {}
    for need in _NEEDS.get(name, []):
        args[need] = packets(spark, sf_dir) if need == "packets" else view(spark, sf_dir, need)
    used = {k: v for k, v in args.items() if f"FROM {k}" in sql}
    for k in used:
        sql = sql.replace(f"FROM {k}", "FROM {" + k + "}")
    return spark.sql(sql, **used)


_INGESTED: dict[tuple[str, str], str] = {}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet table: decoded once per session and input, stored by time range, then read like any table.

    Filters and column choices of the queries reach this scan; on the view itself they would stop at the decoding.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        rows = view(spark, sf_dir, "packets").drop("cls")
        parts = max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "events").rdd.getNumPartitions())
        path = scratch_path(spark, "packets")
        rows.repartitionByRange(parts, "ts_us", "pid").sortWithinPartitions("ts_us", "pid").write.parquet(path)
        _INGESTED[key] = path
    return read_packets(spark, _INGESTED[key])


def duckdb_with(*names: str) -> str:
    """CTE definitions of the given views (and of those they need) for an oracle query."""
    ordered: list[str] = []
    for n in names:
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in ordered:
                ordered.append(dep)
    return ",\n".join(f"{n} AS (\n{_render(n, _DUCKDB)}\n)" for n in ordered)
