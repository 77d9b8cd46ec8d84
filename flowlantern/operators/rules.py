"""Detection rules: definitions as data, stateless matching in one scan, behavioural rules over trailing frames."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlantern.config import SECOND
from flowlantern.functions import net
from flowlantern.session import BROADCAST_ROWS, stored


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    category: str
    severity: str
    pattern_type: str  # simple, regex, behavioral
    pattern: str = ""
    conditions: dict = field(default_factory=dict)
    time_window: float | None = None
    threshold: int | None = None
    enabled: bool = True


# ---- fixed values: the default rules ------------------------------------------------------------
DEFAULT_RULES = [
    Rule("port_scan_basic", "Basic Port Scan Detection", "Detects basic port scanning activity", "PORT_SCAN",
         "MEDIUM", "behavioral", conditions={"min_unique_ports": 10, "same_target": True}, time_window=60, threshold=10),
    Rule("port_scan_aggressive", "Aggressive Port Scan Detection",
         "Detects aggressive port scanning with many ports", "PORT_SCAN", "HIGH", "behavioral",
         conditions={"min_unique_ports": 50, "same_target": True}, time_window=30, threshold=50),
    Rule("port_scan_xmas", "XMAS Port Scan Detection", "Detects XMAS port scan (FIN, PSH, URG flags)", "PORT_SCAN",
         "HIGH", "simple", conditions={"tcp_flags": ["F", "P", "U"], "no_ack_flag": True}),
    Rule("port_scan_null", "NULL Port Scan Detection", "Detects NULL port scan (no TCP flags)", "PORT_SCAN", "HIGH",
         "simple", conditions={"tcp_flags": [], "protocol": "TCP"}),
    Rule("syn_flood", "SYN Flood Attack", "Detects SYN flood attacks", "DOS", "HIGH", "behavioral",
         conditions={"tcp_syn_only": True, "same_target": True}, time_window=10, threshold=100),
    Rule("udp_flood", "UDP Flood Attack", "Detects UDP flood attacks", "DOS", "HIGH", "behavioral",
         conditions={"protocol": "UDP", "same_target": True}, time_window=10, threshold=1000),
    Rule("icmp_flood", "ICMP Flood Attack", "Detects ICMP flood attacks", "DOS", "MEDIUM", "behavioral",
         conditions={"protocol": "ICMP", "same_target": True}, time_window=10, threshold=500),
    Rule("dns_amplification", "DNS Amplification Attack", "Detects DNS amplification attacks", "DNS_AMPLIFICATION",
         "HIGH", "behavioral", conditions={"protocol": "UDP", "dst_port": 53, "same_source": True}, time_window=60,
         threshold=50),
    Rule("ssh_brute_force", "SSH Brute Force Attack", "Detects SSH brute force attempts", "BRUTE_FORCE", "MEDIUM",
         "behavioral", conditions={"dst_port": 22, "protocol": "TCP", "same_target": True}, time_window=300,
         threshold=5),
    Rule("rdp_brute_force", "RDP Brute Force Attack", "Detects RDP brute force attempts", "BRUTE_FORCE", "MEDIUM",
         "behavioral", conditions={"dst_port": 3389, "protocol": "TCP", "same_target": True}, time_window=300,
         threshold=5),
    Rule("icmp_tunneling", "ICMP Tunneling", "Detects potential ICMP tunneling", "TUNNELING", "MEDIUM", "simple",
         conditions={"protocol": "ICMP", "large_payload": True, "payload_size_min": 64}),
    Rule("suspicious_user_agent", "Suspicious User Agent", "Detects suspicious HTTP user agents", "SUSPICIOUS", "LOW",
         "regex", pattern=".*(sqlmap|nmap|nikto|burp|metasploit).*",
         conditions={"protocol": "TCP", "dst_port": [80, 443, 8080, 8443], "http_user_agent": True}),
    Rule("c2_dns_query", "Command and Control DNS Query", "Detects potential C2 communication via DNS", "MALWARE",
         "HIGH", "regex", pattern=r"^[a-f0-9]{32,}\..*",
         conditions={"protocol": "UDP", "dst_port": 53, "dns_query": True}),
    Rule("suspicious_port_usage", "Suspicious Port Usage", "Detects traffic on suspicious ports", "SUSPICIOUS", "LOW",
         "simple", conditions={"dst_port": [1337, 31337, 4444, 5555, 6667, 12345]}),
]

RULES_DDL = (
    "id string, name string, description string, category string, severity string, pattern string, "
    "pattern_type string, conditions string, time_window double, threshold int, enabled boolean"
)
RULES_FILE_DDL = f"signatures array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in RULES_DDL.split(','))}>>"


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    import json

    rows = [{**asdict(r), "conditions": json.dumps(r.conditions), "threshold": r.threshold,
             "time_window": None if r.time_window is None else float(r.time_window)} for r in rules]
    return spark.createDataFrame(rows, RULES_DDL)


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Default rules overlaid by the ``signatures`` of a JSON file; the file wins on equal ids."""
    defaults = rules_frame(spark, DEFAULT_RULES)
    if path is None:
        return defaults
    own = spark.read.schema(RULES_FILE_DDL).json(path, multiLine=True).select(F.inline("signatures"))
    own = own.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    return defaults.join(F.broadcast(own.select("id")), "id", "left_anti").unionByName(own)


def compile_rules(frame: DataFrame) -> list[Rule]:
    """Rules usable by the matchers: enabled, of a known type, with a valid pattern. The rule list is driver-sized."""
    import json

    out = []
    for r in frame.where("enabled AND pattern_type IN ('simple', 'regex', 'behavioral')").collect():
        d = r.asDict()
        d["conditions"] = json.loads(d["conditions"] or "{}")
        d["pattern"] = d["pattern"] or ""
        if d["pattern_type"] == "regex":
            try:  # by the engine that will run it
                frame.sparkSession._jvm.java.util.regex.Pattern.compile(d["pattern"])
            except Exception:
                continue
        out.append(Rule(**d))
    return out


def default_rule(rule_id: str, **changes) -> Rule:
    return replace(next(r for r in DEFAULT_RULES if r.id == rule_id), **changes)


# ---- stateless rules ----------------------------------------------------------------------------
def _listed(value) -> list:
    return value if isinstance(value, list) else [value]


def _gate(c: dict) -> Column:
    """Protocol and port conditions common to all rule types."""
    tests = []
    if "protocol" in c:
        tests.append(F.upper("protocol").isin([p.upper() for p in _listed(c["protocol"])]))
    for side in ("src_port", "dst_port"):
        if side in c:
            tests.append(F.col(side).isin(_listed(c[side])))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def simple_condition(rule: Rule) -> Column:
    c, cond = rule.conditions, _gate(rule.conditions)
    if "tcp_flags" in c:
        cond = cond & net.flags_are(F.col("flags"), "".join(c["tcp_flags"]))
    if c.get("no_ack_flag"):
        cond = cond & ~net.has_flag(F.col("flags"), "A")
    if "payload_size_min" in c:
        cond = cond & (F.col("payload_size") >= c["payload_size_min"])
    if c.get("large_payload"):
        cond = cond & (F.col("payload_size") > 64)
    if "http_user_agent" in c:
        cond = cond & (F.coalesce("http_user_agent", F.lit("")) != "")
    return F.coalesce(cond, F.lit(False))


TEXT_FIELDS = ("http_user_agent", "dns_query", "http_uri")


def _regex_fields(rule: Rule, columns: list[str]) -> list[str]:
    return [f for f in TEXT_FIELDS if rule.conditions.get(f) and f in columns] + (
        ["payload"] if "payload" in columns else [])


def regex_condition(rule: Rule, columns: list[str]) -> Column:
    """Case-insensitive search in each text field by itself, so that anchors work."""
    hit = reduce(lambda a, f: a | F.coalesce(F.col(f).rlike("(?i)" + rule.pattern), F.lit(False)),
                 _regex_fields(rule, columns), F.lit(False))
    return F.coalesce(_gate(rule.conditions) & hit, F.lit(False))


def _matched_text(rule: Rule, columns: list[str]) -> Column:
    pat = "(?i)" + rule.pattern
    texts = [F.when(F.col(f).rlike(pat), F.regexp_extract(f, pat, 0)) for f in _regex_fields(rule, columns)]
    return F.coalesce(*texts, F.lit(""))


MATCH_COLUMNS = [
    "pid", "ts_us", "source_ip", "target_ip", "signature_id", "signature_name", "category", "severity", "confidence",
    "matched_pattern", "description", "context",
]


def _text_map(**cols: Column) -> Column:
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))])


def stateless_matches(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All simple and regex rules in one scan: one row per (packet, rule that fires)."""
    columns, hits = df.columns, []
    for r in rules:
        if r.pattern_type == "simple":
            cond, conf, pat = simple_condition(r), 0.9, F.lit(r.name)
            text = F.lit("")
        elif r.pattern_type == "regex" and _regex_fields(r, columns):
            cond, conf, pat = regex_condition(r, columns), 0.8, F.lit(r.pattern)
            text = _matched_text(r, columns)
        else:
            continue
        hits.append(F.when(cond, F.struct(
            F.lit(r.id).alias("signature_id"), F.lit(r.name).alias("signature_name"),
            F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            F.lit(conf).alias("confidence"), pat.alias("matched_pattern"),
            F.lit(r.description).alias("description"), text.alias("matched_text"),
        )))
    if not hits:
        raise ValueError("no stateless rules given")
    rows = df.select(
        "pid", "ts_us", F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("target_ip"),
        "protocol", "src_port", "dst_port", "packet_size", "flags",
        F.explode(F.array_compact(F.array(*hits))).alias("m"),
    )
    context = _text_map(
        protocol=F.col("protocol"), src_port=F.col("src_port"), dst_port=F.col("dst_port"),
        packet_size=F.col("packet_size"), flags=F.col("flags"), matched_text=F.col("m.matched_text"),
    )
    return rows.withColumn("context", context).select(
        *[F.col(f"m.{c}").alias(c) if c not in ("pid", "ts_us", "source_ip", "target_ip", "context") else F.col(c)
          for c in MATCH_COLUMNS])


# ---- behavioural rules --------------------------------------------------------------------------
# A behavioural rule counts the tracked packets of a key (or their distinct values) in the trailing frame of W
# seconds, W included, and fires on every packet of the key while the count is at least the threshold.
#
# Floods are hot keys by definition, so a key is never one task. Time is cut into slices of at most 10 s:
#   1. pieces: tracked packets per (rule, key, value, slice), aggregated with map-side combine;
#   2. slices whose count could reach the threshold at all (sum over the slices a frame can touch) are kept;
#   3. within those, the count is a running sum of +1 / -1 changes per microsecond, started from the amount still
#      alive at the slice start. A slice holds at most two changes per microsecond however many packets it has,
#      and each packet is looked at once (a sliding frame would recompute the sum for every row).
# Distinct values use the pieces alone: a value is alive from its first sighting in a slice until W after its last
# one, or until its next piece begins.
MAX_SLICE_US = 10 * SECOND


@dataclass(frozen=True)
class _Spec:
    rule: Rule
    touches: Column     # packets the rule is evaluated on
    tracked: Column     # packets that count
    key: Column
    value: Column       # value whose distinct number is reported, null if none
    by_distinct: bool   # threshold applies to the distinct values
    window_us: int
    slice_us: int
    threshold: int


def _spec(rule: Rule) -> _Spec:
    c = rule.conditions
    window = int((rule.time_window or 60.0) * SECOND)
    threshold = rule.threshold or 10
    parts = -(-window // MAX_SLICE_US)
    slice_us = window // parts if window % parts == 0 else window
    none = F.lit(None).cast("string")
    # A rule's frame belongs to the target, the source, or both: same_target / same_source in its conditions.
    if rule.category == "PORT_SCAN":
        key = F.concat_ws(">", "src_ip", "dst_ip") if c.get("same_target") else F.col("src_ip")
        seen = F.coalesce(F.col("dst_port") != 0, F.lit(False))
        return _Spec(rule, F.lit(True), seen, key, F.col("dst_port").cast("string"), True, window, slice_us,
                     c.get("min_unique_ports", threshold))
    tracked, key, value, touches = _gate(c), F.col("dst_ip"), none, F.lit(True)
    if c.get("tcp_syn_only"):
        syn = (F.upper("protocol") == "TCP") & net.has_flag(F.col("flags"), "S") & ~net.has_flag(F.col("flags"), "A")
        tracked, value = tracked & syn, F.col("src_ip")
    if c.get("same_source"):
        key, value = F.col("src_ip"), F.col("dst_ip")
    if rule.category == "BRUTE_FORCE":
        key, touches = F.concat_ws(":", "dst_ip", "dst_port"), tracked
    return _Spec(rule, touches, F.coalesce(tracked, F.lit(False)), key, value, False, window, slice_us, threshold)


def _touch_rows(df: DataFrame, specs: list[_Spec], tracked_only: bool, extra: list[str]) -> DataFrame:
    """One row per (packet, rule it touches), with the rule's key and frame."""
    entries = []
    for s in specs:
        cond = s.touches & s.tracked if tracked_only else s.touches
        entries.append(F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(s.rule.id).alias("rule"), s.key.alias("key"), s.value.alias("value"), s.tracked.alias("tracked"),
            F.lit(s.window_us).cast("bigint").alias("w"), F.lit(s.slice_us).cast("bigint").alias("g"))))
    return df.select("ts_us", *extra, F.explode(F.array_compact(F.array(*entries))).alias("_hit")).select(
        "ts_us", *extra, "_hit.*")


def _slice_of(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return ((at - F.pmod(at, F.col("g"))) / F.col("g")).cast("bigint")


def hot_slices(pieces: DataFrame, specs: list[_Spec]) -> DataFrame:
    """Slices in which the count can reach the threshold, with the amount alive at their start (``base``)."""
    totals = pieces.groupBy("rule", "key", "w", "g", "slice").agg(
        F.sum("n").alias("n"), F.count("value").alias("d"))
    limit = F.create_map(*[F.lit(x) for s in specs for x in (s.rule.id, s.threshold)])[F.col("rule")]
    distinct = F.col("rule").isin([s.rule.id for s in specs if s.by_distinct])
    back = (F.col("w") / F.col("g")).cast("bigint")
    # most slices are far from any threshold: only those with enough within one frame on both sides are added up frame by frame.
    # Slices are scaled so that one literal bound is a frame for every rule.
    scale = math.lcm(*[s.window_us // s.slice_us for s in specs])
    around = Window.partitionBy("rule", "key").orderBy("_at").rangeBetween(-scale, scale)
    totals = totals.withColumn("_at", F.col("slice") * F.call_function("div", F.lit(scale).cast("bigint"), back)).withColumn(
        "_around", F.sum(F.when(distinct, F.col("d")).otherwise(F.col("n"))).over(around)).where(F.col("_around") >= limit)
    reach = totals.select(
        "rule", "key", "w", "g", "n", "d",
        F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), back),
                              lambda j: F.struct((F.col("slice") + j).alias("slice"), (j == 0).alias("own")))).alias("_s"),
    ).select("rule", "key", "w", "g", "n", "d", "_s.*")
    return reach.groupBy("rule", "key", "w", "g", "slice").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"),
        F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("base"),
    ).where(F.when(distinct, F.col("d")).otherwise(F.col("n")) >= limit).select(
        "rule", "key", "slice", "w", "g", "base")


BLOCKS = 64  # time blocks of a slice; a block of a 10 s slice holds at most 156,250 microseconds


def _near_slices(hot: DataFrame, valued: list[str]) -> DataFrame:
    """Slices whose packets matter to hot ones: hot themselves (``own``), those whose packets leave the frame in a hot slice (``out``),
    and, for rules that report distinct values, those in between."""
    back = (F.col("w") / F.col("g")).cast("bigint")
    offset = F.when(F.col("rule").isin(valued), F.sequence(F.lit(0).cast("bigint"), back)).otherwise(F.array(F.lit(0).cast("bigint"), back))
    return hot.select("rule", "key", "w", "g", "slice", F.explode(offset).alias("j")).groupBy(
        "rule", "key", (F.col("slice") - F.col("j")).alias("slice")).agg(
        F.bool_or(F.col("j") == 0).alias("own"), F.bool_or(F.col("j") == back).alias("out"))


def _count_steps(rows: DataFrame) -> DataFrame:
    """Changes of the packet count: +n at t and -n just after t + W, one row per (rule, key, microsecond) combined before the shuffle.
    Every packet of the key is an evaluation point."""
    at = F.col("ts_us") + F.col("w") + 1
    later = F.col("slice") + (F.col("w") / F.col("g")).cast("bigint")
    change = lambda at, slice_, dn, point: F.struct(at.alias("at"), slice_.alias("slice"), dn.alias("dn"), F.lit(point).alias("point"))
    per_us = rows.where("own or out").groupBy("rule", "key", "w", "g", "slice", "own", "out", "ts_us").agg(
        F.count_if("tracked").alias("n"))
    return per_us.select("rule", "key", "g", F.explode(F.array_compact(F.array(
        F.when(F.col("own"), change(F.col("ts_us"), F.col("slice"), F.col("n"), 1)),
        # an expiry exactly on a slice start is already missing from that slice's base
        F.when(F.col("out") & (F.col("n") > 0) & (F.pmod(at, "g") != 0), change(at, later, -F.col("n"), 0)),
    ))).alias("_chg")).select("rule", "key", "g", "_chg.*", F.lit(0).cast("bigint").alias("dd"))


def _value_steps(rows: DataFrame, hot: DataFrame, valued: list[str]) -> DataFrame:
    """Changes of the distinct count: from the first and last sighting of a value in each slice."""
    k3 = ["rule", "key", "slice"]
    pieces = rows.where(F.col("rule").isin(valued) & F.col("tracked") & F.col("value").isNotNull()).groupBy(
        "rule", "key", "w", "g", "value", "slice").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    by_value = Window.partitionBy("rule", "key", "value").orderBy("slice")
    alive = pieces.withColumn(
        "end", F.least(F.col("last") + F.col("w"), F.coalesce(F.lead("first").over(by_value) - 1, F.lit(2**62))))
    one, minus = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")
    begins = F.array(F.struct(F.col("first").alias("at"), F.col("slice").alias("slice"), one.alias("dd")))
    later = F.transform(
        F.filter(F.sequence(F.col("slice"), _slice_of("end")), lambda s: s > F.col("slice")),
        lambda s: F.struct((s * F.col("g")).alias("at"), s.alias("slice"), one.alias("dd")))
    gone = F.col("end") + 1
    ends = F.when(F.pmod(gone, F.col("g")) != 0, F.array(
        F.struct(gone.alias("at"), _slice_of(gone).alias("slice"), minus.alias("dd"))))
    values = alive.select("rule", "key", "g", F.explode(F.concat(
        begins, later, F.coalesce(ends, F.array().cast("array<struct<at:bigint,slice:bigint,dd:bigint>>")))).alias("_chg"))
    return values.select("rule", "key", "g", "_chg.*", F.lit(0).cast("bigint").alias("dn"), F.lit(0).alias("point")).join(
        hot.select(*k3), k3, "left_semi")


def running_counts(steps: DataFrame) -> DataFrame:
    """``n`` and ``d`` after each step, per (rule, key, slice), by two-level prefix sums: totals of the time blocks of a slice are added up
    in order, and each block is summed for itself, so one slice of a victim is up to ``BLOCKS`` tasks."""
    k4 = ["rule", "key", "slice", "block"]
    length = F.greatest(F.call_function("div", F.col("g"), F.lit(BLOCKS)), F.lit(1))
    # read once for each level
    steps = stored(steps.withColumn("block", F.call_function("div", F.col("at") - F.col("slice") * F.col("g"), length)).drop("g"), "steps")
    before = Window.partitionBy("rule", "key", "slice").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy(*k4).agg(F.sum("dn").alias("dn"), F.sum("dd").alias("dd"))
    totals = totals.select(*k4, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("dn", "dd")])
    inside = Window.partitionBy(*k4).orderBy("at")  # with all changes of the same microsecond
    within = steps.withColumn("n", F.sum("dn").over(inside)).withColumn("d", F.sum("dd").over(inside)).where(F.col("point") == 1)
    return within.join(totals, k4).select(
        "rule", "key", "slice", "at", (F.col("n") + F.col("dn0")).alias("n"), (F.col("d") + F.col("dd0")).alias("d"))


def frame_counts(df: DataFrame, specs: list[_Spec]) -> tuple[DataFrame, DataFrame]:
    """(times at which a rule's frame reaches its threshold with count and distinct count, packets of hot slices).

    Packets are read twice: once for totals per slice, which show where a threshold can be reached, once for the packets near there.
    """
    k3 = ["rule", "key", "slice"]
    valued = [s.rule.id for s in specs if s.by_distinct or s.rule.conditions.get("tcp_syn_only")
              or s.rule.conditions.get("same_source")]
    pieces = _touch_rows(df, specs, True, []).withColumn("slice", _slice_of("ts_us")).groupBy(
        "rule", "key", "w", "g", "value", "slice").agg(F.count("*").alias("n"))
    hot = stored(hot_slices(pieces, specs), "hot")
    most = BROADCAST_ROWS // (1 + max(s.window_us // s.slice_us for s in specs))  # near slices of a hot one
    small = hot.limit(most + 1).count() <= most
    hot, near = (F.broadcast(x) if small else x for x in (hot, _near_slices(hot, valued)))
    rows = _touch_rows(df, specs, False, ["pid", "src_ip", "dst_ip", "dst_port"]).withColumn("slice", _slice_of("ts_us"))
    rows = stored(rows.join(near, k3).where("own or tracked"), "near_packets")
    base = hot.select("rule", "key", "g", "slice", (F.col("slice") * F.col("g")).alias("at"), F.col("base").alias("dn"),
                      F.lit(0).cast("bigint").alias("dd"), F.lit(0).alias("point"))
    steps = _count_steps(rows).unionByName(base).unionByName(_value_steps(rows, hot, valued))
    limit = F.create_map(*[F.lit(x) for s in specs for x in (s.rule.id, s.threshold)])
    distinct = F.col("rule").isin([s.rule.id for s in specs if s.by_distinct])
    fired = running_counts(steps).where(F.when(distinct, F.col("d")).otherwise(F.col("n")) >= limit[F.col("rule")])
    # several packets of one microsecond are one point
    return fired.select("rule", "key", F.col("at").alias("ts_us"), "n", "d"), rows.where("own").drop("own", "out", "slice")


def _texts(s: _Spec) -> tuple[Column, Column]:
    """Matched-pattern text and context map of a behavioural match."""
    w = f"{s.window_us / SECOND}"
    n, d = F.col("n").cast("string"), F.col("d").cast("string")
    c = s.rule.conditions
    if s.by_distinct:
        text = F.concat(F.lit("Port scan: "), d, F.lit(f" ports in {w}s"))
        ctx = _text_map(unique_ports=d, total_scans=n, time_window=F.lit(w))
    elif c.get("tcp_syn_only"):
        text = F.concat(F.lit("SYN flood: "), n, F.lit(f" SYN packets in {w}s"))
        ctx = _text_map(syn_packets=n, unique_sources=d, time_window=F.lit(w))
    elif c.get("same_source"):
        text = F.concat(F.lit("DNS amplification: "), n, F.lit(f" queries in {w}s"))
        ctx = _text_map(dns_queries=n, unique_targets=d, time_window=F.lit(w))
    elif s.rule.category == "BRUTE_FORCE":
        text = F.concat(F.lit("Brute force: "), n, F.lit(f" attempts in {w}s"))
        ctx = _text_map(attempts=n, service_port=F.col("dst_port"), time_window=F.lit(w))
    else:
        p = str(c.get("protocol", "packet"))
        text = F.concat(F.lit(f"{p} flood: "), n, F.lit(f" {p} packets in {w}s"))
        ctx = _text_map(**{f"{p.lower()}_packets": n}, time_window=F.lit(w))
    return text, ctx


def behavioural_matches(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All behavioural rules together; one row per (packet, rule whose frame is at or over the threshold)."""
    specs = [_spec(r) for r in rules if r.pattern_type == "behavioral"]
    fired, rows = frame_counts(df, specs)
    rows = rows.join(fired, ["rule", "key", "ts_us"])
    pick = lambda f: F.coalesce(*[F.when(F.col("rule") == s.rule.id, f(s)) for s in specs])
    measure = pick(lambda s: F.col("d") if s.by_distinct else F.col("n"))
    limit = pick(lambda s: F.lit(s.rule.threshold or 10))
    return rows.select(
        "pid", "ts_us", F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("target_ip"),
        F.col("rule").alias("signature_id"), pick(lambda s: F.lit(s.rule.name)).alias("signature_name"),
        pick(lambda s: F.lit(s.rule.category)).alias("category"),
        pick(lambda s: F.lit(s.rule.severity)).alias("severity"),
        F.least(measure / (limit * 2), F.lit(1.0)).alias("confidence"),
        pick(lambda s: _texts(s)[0]).alias("matched_pattern"),
        pick(lambda s: F.lit(s.rule.description)).alias("description"),
        pick(lambda s: _texts(s)[1]).alias("context"),
        F.col("n").alias("frame_count"), F.col("d").alias("frame_distinct"),
    )


def all_matches(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Matches of every enabled rule."""
    rules = DEFAULT_RULES if rules is None else rules
    parts = []
    if any(r.pattern_type in ("simple", "regex") for r in rules):
        parts.append(stateless_matches(df, rules))
    if any(r.pattern_type == "behavioral" for r in rules):
        parts.append(behavioural_matches(df, rules).select(*MATCH_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


# ---- reports ------------------------------------------------------------------------------------
def match_stats(matches: DataFrame, k: int = 10) -> DataFrame:
    """Counts per category, severity, source and target (top k of the last two) and the overall total, as
    (dimension, value, matches) rows; the total row also carries the last match time and matches per minute."""
    dims = F.explode(F.array(*[
        F.struct(F.lit(dim).alias("dimension"), F.col(c).alias("value"))
        for dim, c in (("category", "category"), ("severity", "severity"), ("source_ip", "source_ip"),
                       ("target_ip", "target_ip"), ("total", "all"))])).alias("x")
    g = matches.withColumn("all", F.lit("all")).select("ts_us", dims).groupBy("x.dimension", "x.value").agg(
        F.count("*").alias("matches"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    g = stored(g, "match_counts")  # the matches are computed once for all dimensions
    top = lambda dim: g.where(F.col("dimension") == dim).orderBy(F.desc("matches"), "value").limit(k)
    rows = g.where(~F.col("dimension").isin("source_ip", "target_ip")).unionByName(top("source_ip")).unionByName(top("target_ip"))
    span = (F.col("hi") - F.col("lo")) / SECOND
    total = F.col("dimension") == "total"
    return rows.select(
        "dimension", "value", "matches", F.when(total, F.col("hi")).alias("last_match_us"),
        F.when(total, net.round6(net.ratio(F.col("matches") * 60.0, span))).alias("per_minute"),
    )


def recent_matches(matches: DataFrame, n: int = 100, category: str | None = None, severity: str | None = None) -> DataFrame:
    """The last ``n`` matches; category and severity filter what is left."""
    out = matches.orderBy(F.desc("ts_us"), F.desc("pid"), "signature_id").limit(n)
    if category:
        out = out.where(F.col("category") == category)
    return out.where(F.col("severity") == severity) if severity else out
