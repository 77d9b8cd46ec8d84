"""Thresholds used by the operators. One frozen record, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000  # all time arithmetic is in microseconds


@dataclass(frozen=True)
class Thresholds:
    # connections and flows
    connection_idle_us: int = 300 * SECOND
    flow_idle_us: int = 60 * SECOND
    flow_active_us: int = 60 * SECOND
    flow_max_packets: int = 1000
    # traffic windows
    window_us: int = 10 * SECOND
    scan_ports_min: int = 10
    scan_ports_full: float = 50.0
    dos_rate_min: float = 1000.0
    dos_rate_full: float = 10000.0
    exfil_bytes_min: int = 10 * 1024 * 1024
    exfil_bytes_full: float = 100.0 * 1024 * 1024
    icmp_share_max: float = 0.1
    # address plan
    internal_cidrs: tuple[str, ...] = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")
    # alerts
    rate_limit: int = 10
    rate_window_us: int = 60 * SECOND
    dedup_window_us: int = 60 * SECOND
    correlation_gap_us: int = 240 * SECOND
    correlation_gap_no_target_us: int = 90 * SECOND
    correlated_types: tuple[str, ...] = ("port_scan", "dos", "brute_force", "anomaly_detection")
    retention_us: int = 30 * 86400 * SECOND
    # ensemble
    weighted_threshold: float = 0.7
    ema_alpha: float = 0.1


DEFAULTS = Thresholds()

# Scaled limits for small fixtures, so that every score has rows that fire.
SCALED = Thresholds(dos_rate_min=5.0, dos_rate_full=50.0, exfil_bytes_min=20_000, exfil_bytes_full=200_000.0)
