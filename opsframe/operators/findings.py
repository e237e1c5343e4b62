"""Log finding rules: filter by tag, group, threshold, one row per group.

All rules share one pass: an event yields one small row per rule it belongs to,
rows are combined per (rule, keys, time bin) and then per (rule, keys). The bin
in the first level spreads even a single group that holds most events.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import digest_id, pick, severity_rank
from opsframe.operators.windows import THRESHOLDS, floor_to_bin, weight

# Communities every scanner tries.
INSECURE_COMMUNITIES = ["private", "public"]
COLUMNS = [
    "finding_id", "rule_id", "title", "severity", "category", "device", "interface", "vlan",
    "confidence", "event_count", "first_seen", "last_seen", "tags", "details",
]


def has(*tags: str) -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))


def _words(*ws: str) -> Column:
    return F.array(*[F.lit(w) for w in ws])


def _details(**kv: Column) -> Column:
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("None"))


@dataclass(frozen=True)
class Rule:
    """One rule: which events, which keys, and the columns of its rows."""

    rule_id: str
    tags: Sequence[str]
    keys: Sequence[str | None]  # hostname default, second and third key
    minutes: int
    category: str
    title: Callable[[], Column]
    severity: Callable[[dict], Column]
    out_tags: Callable[[], Column]
    confidence: Callable[[dict], Column] = lambda t: F.lit("medium")
    details: Callable[[], Column] = lambda: F.lit(None).cast("map<string,string>")
    keep: Callable[[dict], Column] = lambda t: F.lit(True)
    interface: str | None = None
    vlan: str | None = None
    named_host: bool = True
    extra: Callable[[], Column] = field(default=lambda: F.lit(True))


RULES = [
    Rule(
        "SYS-PORT-FLAP", ["port_flap"], ["entities.interface_id"], 60, "interface",
        title=lambda: F.concat(F.lit("Frequent port flapping observed on "), F.col("k2")),
        severity=lambda t: F.when(F.col("peak") >= t["port_flaps_per_hour_high"], "high").otherwise("medium"),
        confidence=lambda t: F.when(F.col("peak") >= t["port_flaps_per_hour_high"], "high").otherwise("medium"),
        keep=lambda t: F.col("peak") >= t["port_flaps_per_hour_warning"],
        out_tags=lambda: _words("port_flap", "link_state"),
        details=lambda: _details(peak_flaps_per_hour=F.col("peak")),
        interface="k2", named_host=False,
        extra=lambda: F.coalesce(F.col("entities.interface_id"), F.lit("")) != "",
    ),
    Rule(
        "SYS-MAC-FLAP", ["mac_flap"], ["entities.mac_address", "entities.vlan_id"], 60, "loop",
        title=lambda: F.concat(F.lit("MAC flapping / possible L2 loop for "), _said("k2"), F.lit(" in VLAN "), _said("k3")),
        severity=lambda t: pick([
            ((F.col("moves") >= t["mac_moves_high"]) & (F.col("reports") > 1), "critical"),
            (F.col("moves") >= t["mac_moves_high"], "high"),
        ], "medium"),
        confidence=lambda t: F.lit("high"),
        keep=lambda t: F.col("moves") >= t["mac_moves_warning"],
        out_tags=lambda: _words("mac_flap", "loop_risk"),
        details=lambda: _details(max_moves=F.col("moves"), reports=F.col("reports")),
        interface="last.iface", vlan="k3", named_host=False,
    ),
    Rule(
        "SYS-SNMP-AUTHFAIL", ["snmp_auth_failed", "snmp_user_auth_failed"], [], 5, "security",
        title=lambda: F.concat(F.lit("SNMP authorization failures on "), F.col("device"), F.lit(" (possible recon)")),
        severity=lambda t: pick([
            (F.col("peak") >= t["snmp_auth_fail_high_per_5min"], "high"),
            ((F.col("peak") >= t["snmp_auth_fail_warning_per_5min"]) | (F.size(_insecure()) > 0), "medium"),
        ], "low"),
        out_tags=lambda: _words("snmp_auth_failed", "recon_possible"),
        details=lambda: _details(
            peak_per_5min=F.col("peak"), communities=F.array_join("communities", ";"), insecure_communities=F.array_join(_insecure(), ";")
        ),
    ),
    Rule(
        "SYS-ARP-FAST", ["arp_instability"], ["entities.ip_address"], 60, "security",
        title=lambda: F.concat(F.lit("Rapid ARP/MAC change for host "), _said("k2")),
        severity=lambda t: F.when(F.col("event_count") >= 5, "high").otherwise("medium"),
        out_tags=lambda: _words("arp_instability", "duplicate_ip_possible"),
        details=lambda: _details(ip_address=F.col("k2")), named_host=False,
    ),
    Rule(
        "SYS-POE-FAULT", ["poe_fault"], ["entities.interface_id"], 60, "poe",
        title=lambda: F.concat(F.lit("PoE abnormal/short observed on "), _said("k2")),
        severity=lambda t: F.lit("high"), confidence=lambda t: F.lit("high"),
        out_tags=lambda: F.when(F.col("short"), _words("poe_fault", "short_detected")).otherwise(_words("poe_fault")),
        details=lambda: _details(short_detected=F.col("short")), interface="k2", named_host=False,
    ),
    Rule(
        "SYS-ERPS-CHURN", ["erps_churn"], ["entities.erps_ring"], 60, "topology",
        title=lambda: F.concat(F.lit("ERPS ring "), _said("k2"), F.lit(" protection churn / topology instability")),
        severity=lambda t: F.when(F.col("peak") >= 2 * t["erps_events_warning_per_hour"], "high").otherwise("medium"),
        keep=lambda t: F.col("peak") >= t["erps_events_warning_per_hour"],
        out_tags=lambda: _words("erps_churn", "topology_instability"),
        details=lambda: _details(ring=F.col("k2"), peak_per_hour=F.col("peak")), named_host=False,
    ),
    Rule(
        "SYS-TELNET", ["insecure_telnet"], [], 60, "security",
        title=lambda: F.concat(F.lit("Insecure telnet management observed on "), F.col("device")),
        severity=lambda t: F.lit("medium"), confidence=lambda t: F.lit("high"),
        out_tags=lambda: _words("management_access", "insecure_telnet"),
    ),
    Rule(
        "SYS-DEVICE", ["reboot", "power_fault", "fan_fault", "clock_change"], [], 60, "device",
        title=lambda: F.concat(F.lit("Device health / stability events on "), F.col("device")),
        severity=lambda t: F.when(F.col("faults") > 0, "high").otherwise("medium"),
        out_tags=lambda: _words("device_health"),
        details=lambda: _details(reboot_events=F.col("reboots"), fault_events=F.col("faults")),
    ),
]


def _insecure() -> Column:
    return F.array_intersect("communities", _words(*INSECURE_COMMUNITIES))


#: What a group of events is merged to, as (name, per event, over events, over bins); all are sums, extremes or sets.
def _measures() -> list[tuple[str, Column, Callable, Callable]]:
    added = lambda c: F.sum(c)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    auth = has("snmp_auth_failed", "snmp_user_auth_failed")
    return [
        ("n", weight(), added, added),
        ("reports", F.lit(1).cast("long"), added, added),
        ("first_seen", F.col("timestamp"), F.min, F.min),
        ("last_seen", F.col("timestamp"), F.max, F.max),
        ("moves", F.coalesce(F.col("entities.flap_count"), F.lit(0)), F.max, F.max),
        ("last", F.struct("source", "ord", F.col("entities.interface_id").alias("iface")), F.max, F.max),
        ("short", has("short_detected"), F.max, F.max),
        ("reboots", has("reboot").cast("long"), added, added),
        ("faults", has("power_fault", "fan_fault").cast("long"), added, added),
        ("communities", F.when(auth & (F.coalesce(F.col("entities.community"), F.lit("")) != ""), F.col("entities.community")), F.collect_set, joined),
    ]


GROUP = ["rule_id", "device", "k2", "k3"]
MEASURES = ["n", "reports", "first_seen", "last_seen", "moves", "last", "short", "reboots", "faults", "communities"]


def rule_hits(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per event and rule it belongs to: group keys, bin minutes and the event's measures."""
    text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    hits = []
    for r in rules:
        k2, k3 = (list(r.keys) + [None, None])[:2]
        host = F.coalesce(F.col("hostname"), F.lit("unknown")) if r.named_host else F.col("hostname")
        hits.append(F.when(has(*r.tags) & r.extra(), F.struct(
            F.lit(r.rule_id).alias("rule_id"), host.alias("device"), text(k2).alias("k2"), text(k3).alias("k3"), F.lit(r.minutes).alias("minutes")
        )))
    every = sorted({t for r in rules for t in r.tags})
    d = events.where(has(*every)).select(F.explode(F.array_compact(F.array(*hits))).alias("h"), "ts", *[e.alias(n) for n, e, _, _ in _measures()])
    return d.select("ts", "h.*", *MEASURES)


def bin_hits(hits: DataFrame, *bin_columns: Column | str) -> DataFrame:
    """Hits merged per group and time bin."""
    return hits.groupBy(*GROUP, *bin_columns).agg(*[over(n).alias(n) for n, _, over, _ in _measures()])


def merge_bins(bins: DataFrame) -> DataFrame:
    """One row per (rule, device, k2, k3); ``peak`` is the largest count of a bin with a time (``_bin``)."""
    return bins.groupBy(*GROUP).agg(
        F.sum("n").alias("event_count"), F.coalesce(F.max(F.when(F.col("_bin").isNotNull(), F.col("n"))), F.lit(0)).alias("peak"),
        *[over(n).alias(n) for n, _, _, over in _measures() if n != "n"])


def grouped_events(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per (rule, device, k2, k3) with counts, time range, peak and rule extras, from one scan of the events."""
    hits = rule_hits(events, rules).withColumn("_bin", floor_to_bin(F.col("ts"), F.col("minutes")))
    return merge_bins(bin_hits(hits, "_bin"))


def log_findings(events: DataFrame, t: dict = THRESHOLDS, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """All rules; ``severity_rank`` gives the sort order (rank, rule, device)."""
    return finding_rows(grouped_events(events, rules), t, rules)


def finding_rows(g: DataFrame, t: dict = THRESHOLDS, rules: Sequence[Rule] = tuple(RULES), also: Sequence[str] = ()) -> DataFrame:
    """Findings of merged groups that pass their rule's threshold; columns ``also`` are carried along."""
    is_rule = {r.rule_id: F.col("rule_id") == r.rule_id for r in rules}
    by_rule = lambda f: pick([(is_rule[r.rule_id], f(r)) for r in rules])
    null = F.lit(None).cast("string")
    rows = g.where(by_rule(lambda r: r.keep(t))).select(
        by_rule(lambda r: digest_id("SYSF", 10, "rule_id", "device", *["k2", "k3"][: len(r.keys)])).alias("finding_id"),
        "rule_id",
        by_rule(lambda r: r.title()).alias("title"),
        by_rule(lambda r: r.severity(t)).alias("severity"),
        by_rule(lambda r: F.lit(r.category)).alias("category"),
        "device",
        by_rule(lambda r: F.col(r.interface) if r.interface else null).alias("interface"),
        by_rule(lambda r: F.col(r.vlan) if r.vlan else null).alias("vlan"),
        by_rule(lambda r: r.confidence(t)).alias("confidence"),
        "event_count", "first_seen", "last_seen",
        by_rule(lambda r: r.out_tags()).alias("tags"),
        by_rule(lambda r: r.details()).alias("details"), *also,
    )
    return rows.withColumn("severity_rank", severity_rank("severity"))


def _only(rule_id: str) -> Sequence[Rule]:
    return [r for r in RULES if r.rule_id == rule_id]


def find_port_flap(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-PORT-FLAP"))


def find_mac_flap(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-MAC-FLAP"))


def find_auth_failures(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-SNMP-AUTHFAIL"))


def find_arp_change(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-ARP-FAST"))


def find_poe_fault(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-POE-FAULT"))


def find_ring_churn(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-ERPS-CHURN"))


def find_cleartext_mgmt(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-TELNET"))


def find_device_health(events: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    return log_findings(events, t, _only("SYS-DEVICE"))


def count_dimensions(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value, n) over several columns: combine first, then expand the small result."""
    fine = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return fine.select("n", F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.sum("n").alias("n"))


def summarize_findings(findings: DataFrame) -> DataFrame:
    return count_dimensions(findings, ["severity", "category", "rule_id"])
