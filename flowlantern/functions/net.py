"""Column expressions over packet fields. ``flags`` is a string of TCP flag letters, '' when none."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlantern.config import DEFAULTS

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
# Colon-separated groups with at most one '::'; embedded dotted quads are not used by the inputs.
IPV6 = r"^(?=.*:)(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$"

# ---- fixed values: service names by port --------------------------------------------------------
TCP_SERVICES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3",
    143: "IMAP", 443: "HTTPS", 993: "IMAPS", 995: "POP3S", 3306: "MYSQL", 3389: "RDP", 5432: "POSTGRESQL",
    6379: "REDIS", 27017: "MONGODB",
}
UDP_SERVICES = {
    53: "DNS", 67: "DHCP-SERVER", 68: "DHCP-CLIENT", 123: "NTP", 161: "SNMP", 500: "IPSEC-IKE",
    514: "SYSLOG", 4500: "IPSEC-NAT-T",
}
# ---- fixed values: ICMP type and destination-unreachable code names -----------------------------
ICMP_TYPES = {
    0: "Echo Reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request",
    11: "Time Exceeded", 12: "Parameter Problem", 13: "Timestamp Request", 14: "Timestamp Reply",
    15: "Information Request", 16: "Information Reply",
}
ICMP_UNREACHABLE_CODES = {
    0: "Network Unreachable", 1: "Host Unreachable", 2: "Protocol Unreachable", 3: "Port Unreachable",
    4: "Fragmentation Needed", 5: "Source Route Failed",
}


def lookup(table: dict, key: Column) -> Column:
    """Literal map lookup; null for unknown keys. For the small fixed tables above."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*entries), key)


def cidr_pattern(cidr: str) -> str:
    """Regular expression for the dotted quads of an IPv4 block."""
    block = ipaddress.ip_network(cidr)
    parts = [int(x) for x in str(block.network_address).split(".")]
    full, rest = divmod(block.prefixlen, 8)
    octets = [str(x) for x in parts[:full]]
    if rest:
        octets.append("(?:" + "|".join(str(x) for x in range(parts[full], parts[full] + 2 ** (8 - rest))) + ")")
    octets += [OCTET] * (4 - len(octets))
    return r"\.".join(octets)


def is_valid_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4) | ip.rlike(IPV6), F.lit(False))


def is_internal_ip(ip: Column, cidrs: tuple[str, ...] = DEFAULTS.internal_cidrs) -> Column:
    """True if the address lies in any of the given IPv4 blocks; anything unparsable is external."""
    # one compiled pattern per task: far less generated code than splitting and comparing octets
    return F.coalesce(ip.rlike("^(?:" + "|".join(cidr_pattern(c) for c in cidrs) + ")$"), F.lit(False))


def is_well_known_port(port: Column) -> Column:
    return F.coalesce(port.between(1, 1023), F.lit(False))


def port_or_zero(port: Column) -> Column:
    return F.coalesce(port, F.lit(0))


def port_category(port: Column) -> Column:
    """0 none, 1 well known, 2 registered, 3 dynamic."""
    return F.when(port == 0, 0).when(port <= 1023, 1).when(port <= 49151, 2).otherwise(3)


def protocol_code(protocol: Column) -> Column:
    p = F.upper(protocol)
    return F.when(p == "TCP", 0).when(p == "UDP", 1).when(p == "ICMP", 2).otherwise(3)


def time_of_day(ts_us: Column) -> Column:
    """0 morning, 1 afternoon, 2 evening, 3 night, by the hour in the session time zone."""
    h = F.hour(F.timestamp_micros(ts_us))
    return F.when(h.between(6, 11), 0).when(h.between(12, 17), 1).when(h >= 18, 2).otherwise(3)


def has_flag(flags: Column, letter: str) -> Column:
    return F.instr(flags, letter) > 0


def flags_are(flags: Column, letters: str) -> Column:
    """The set of flags equals ``letters`` (order and repeats do not matter)."""
    if not letters:
        return flags == ""
    same = F.translate(flags, letters, "") == ""
    for x in letters:
        same = same & has_flag(flags, x)
    return same


def flags_array(flags: Column) -> Column:
    return F.when(flags == "", F.array().cast("array<string>")).otherwise(F.split(flags, ""))


def tcp_state(flags: Column) -> Column:
    s, a, f, r = (has_flag(flags, x) for x in "SAFR")
    return (
        F.when(s & ~a, "SYN_SENT").when(s & a, "SYN_RECEIVED").when(f & a, "CLOSED")
        .when(r, "RESET").when(a, "ESTABLISHED").otherwise("UNKNOWN")
    )


def tcp_scan_type(flags: Column) -> Column:
    """FIN, NULL, XMAS or null. XMAS here is a subset test without ACK, unlike the exact-set rule."""
    xmas = has_flag(flags, "F") & has_flag(flags, "P") & has_flag(flags, "U") & ~has_flag(flags, "A")
    return F.when(flags_are(flags, "F"), "FIN").when(flags == "", "NULL").when(xmas, "XMAS")


def service_name(protocol: Column, port: Column) -> Column:
    known = F.when(protocol == "TCP", lookup(TCP_SERVICES, port)).otherwise(lookup(UDP_SERVICES, port))
    return F.coalesce(known, F.concat(F.lit("UNKNOWN-"), port.cast("string")))


def icmp_description(icmp_type: Column, icmp_code: Column) -> Column:
    kind = F.coalesce(lookup(ICMP_TYPES, icmp_type), F.concat(F.lit("Type "), icmp_type.cast("string")))
    code = F.coalesce(
        lookup(ICMP_UNREACHABLE_CODES, icmp_code), F.concat(F.lit("Code "), icmp_code.cast("string"))
    )
    return F.when(icmp_type == 3, F.concat(kind, F.lit(" - "), code)).otherwise(kind)


def connection_key() -> tuple[Column, Column]:
    """Direction-free end points: the smaller (ip, port) first, addresses compared as strings."""
    a = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    b = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return F.least(a, b), F.greatest(a, b)


def flow_key() -> Column:
    """``src:sport-dst:dport-proto`` with missing ports as 0."""
    return F.format_string(
        "%s:%d-%s:%d-%s", F.col("src_ip"), port_or_zero(F.col("src_port")),
        F.col("dst_ip"), port_or_zero(F.col("dst_port")), F.col("protocol"),
    )


def is_forward() -> Column:
    """(src_ip, src_port) sorts at or before (dst_ip, dst_port)."""
    return F.struct(F.col("src_ip"), port_or_zero(F.col("src_port"))) <= F.struct(
        F.col("dst_ip"), port_or_zero(F.col("dst_port"))
    )


def security_flags(dns_rcode: Column) -> Column:
    """Array of findings for one packet. ``dns_rcode`` is null for packets without a DNS layer."""
    scan = tcp_scan_type(F.col("flags"))
    return F.array_compact(
        F.array(
            F.when((F.upper("protocol") == "TCP") & scan.isNotNull(), F.concat(F.lit("TCP_SCAN_"), scan)),
            F.when(F.col("dst_port") > 1024, F.lit("HIGH_PORT")),
            F.when((F.upper("protocol") == "ICMP") & (F.col("payload_size") > 64), F.lit("ICMP_TUNNEL")),
            F.when((F.upper("protocol") == "UDP") & ~dns_rcode.isin(0, 3), F.lit("DNS_ANOMALY")),
        )
    )


def round6(c: Column) -> Column:
    """Round to 6 places by floor(x * 1e6 + 0.5), which every IEEE engine evaluates alike, ties included."""
    return F.floor(c.cast("double") * 1e6 + 0.5) / 1e6


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 or null."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
