"""Time-bucket aggregation of parsed log events."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import pick
from opsframe.operators.logs import iso_text

# Severity columns (emergency and alert have none) and weak-label thresholds.
SEVERITY_COLUMNS = ["error", "warning", "notice", "critical", "info", "debug", "unknown"]
THRESHOLDS = {
    "port_flaps_per_hour_warning": 3,
    "port_flaps_per_hour_high": 6,
    "mac_moves_warning": 20,
    "mac_moves_high": 100,
    "snmp_auth_fail_warning_per_5min": 5,
    "snmp_auth_fail_high_per_5min": 20,
    "erps_events_warning_per_hour": 3,
    "poe_fault_high": True,
    "device_instability_events": 1,
}
KEYS = ["window_minutes", "scope", "hostname", "interface_id", "window_start"]


def floor_to_bin(ts: Column, minutes: int | Column) -> Column:
    """Bin start; bins restart at local midnight, unlike ``window()``."""
    minutes = F.lit(minutes)
    day = F.date_trunc("day", ts)
    of_day = F.hour(ts) * 60 + F.minute(ts)
    return day + F.make_interval(mins=(F.floor(of_day / minutes) * minutes).cast("int"))


def bin_bounds(df: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    start = floor_to_bin(F.col(ts), minutes)
    return df.withColumn("window_start", start).withColumn("window_end", start + F.make_interval(mins=F.lit(minutes)))


def eligible(events: DataFrame, drop_unreliable: bool = True) -> DataFrame:
    ok = (F.col("parse_status") != "failed") & F.col("ts").isNotNull()
    return events.where(ok & ~F.col("clock_unreliable") if drop_unreliable else ok)


def weight() -> Column:
    return F.greatest(F.lit(1).cast("long"), F.col("duplicate_count"))


def tag_counters() -> dict[str, Column]:
    """Weighted per-event contributions to the window counters."""
    w = weight()
    has = lambda *ts: F.arrays_overlap("tags", F.array(*[F.lit(t) for t in ts]))
    mnem = F.coalesce(F.col("mnemonic"), F.lit(""))
    is_link = has("link_state") | mnem.startswith("LINEPROTO") | mnem.startswith("INTERFACE")
    down = is_link & (F.lower(mnem).contains("down") | has("link_down"))
    up = is_link & ~down & (F.lower(mnem).contains("up") | has("link_up"))
    when = lambda c, v=w: F.when(c, v).otherwise(F.lit(0))
    return {
        "total_events": F.lit(1).cast("long"),
        "weighted_event_count": w,
        "lineproto_up_count": when(up),
        "lineproto_down_count": when(down),
        "mac_flap_count": when(has("mac_flap")),
        "mac_move_total": when(has("mac_flap"), F.coalesce(F.col("entities.flap_count"), F.lit(0))),
        "erps_event_count": when(has("erps_churn")),
        "poe_fault_count": when(has("poe_fault")),
        "poe_power_churn_count": when(has("poe_power_churn")),
        "snmp_auth_fail_count": when(has("snmp_auth_failed", "snmp_user_auth_failed")),
        "arp_mac_change_count": when(has("arp_instability")),
        "reboot_or_clock_event_count": when(has("reboot", "clock_change")),
        "power_fault_count": when(has("power_fault")),
        "fan_fault_count": when(has("fan_fault")),
        **severity_counts(),
    }


def severity_counts() -> dict[str, Column]:
    return {f"severity_{s}": F.when(F.col("severity_label") == s, weight()).otherwise(F.lit(0)) for s in SEVERITY_COLUMNS}


def scoped(fine: DataFrame) -> DataFrame:
    """Every row for its host, and again for its interface when it names one."""
    scopes = F.array_compact(F.array(
        F.struct(F.lit("host").alias("scope"), F.lit("").alias("interface_id")),
        F.when(F.coalesce(F.col("iface"), F.lit("")) != "", F.struct(F.lit("interface").alias("scope"), F.col("iface").alias("interface_id"))),
    ))
    return fine.withColumn("_s", F.explode(scopes)).select("*", "_s.scope", "_s.interface_id").drop("_s", "iface")


def _binned(events: DataFrame, sizes: Sequence[int], drop_unreliable: bool) -> DataFrame:
    e = eligible(events, drop_unreliable).select(
        "*", F.coalesce(F.col("hostname"), F.lit("unknown")).alias("host"), F.col("entities.interface_id").alias("iface")
    )
    if len(sizes) == 1:
        e = e.withColumn("window_minutes", F.lit(sizes[0]))
    else:
        e = e.withColumn("window_minutes", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return e.withColumn("window_start", floor_to_bin(F.col("ts"), F.col("window_minutes"))).drop("hostname").withColumnRenamed("host", "hostname")


FINE = ["window_minutes", "hostname", "iface", "window_start"]


def failed_from() -> Column:
    """Source address of an authentication failure."""
    return F.when(F.arrays_overlap("tags", F.array(F.lit("snmp_auth_failed"), F.lit("snmp_user_auth_failed"))), F.col("entities.ip_address"))


def _fine(events: DataFrame, sizes: Sequence[int], drop_unreliable: bool, by: Sequence[Column], counters: dict[str, Column]) -> DataFrame:
    """Counters per (size, host, interface, bin) and ``by``: the one scan and first shuffle of the events."""
    b = _binned(events, sizes, drop_unreliable).select(*FINE, *by, *[e.alias(n) for n, e in counters.items()])
    keys = [c for c in b.columns if c not in counters]
    return b.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counters])


def window_counters(events: DataFrame, sizes: Sequence[int], drop_unreliable: bool = True) -> DataFrame:
    """Two-scope counters: events are combined per (host, interface, bin) before the scopes are expanded."""
    counters = tag_counters()
    return scoped(_fine(events, sizes, drop_unreliable, [], counters)).groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in counters])


def distinct_sources(events: DataFrame, sizes: Sequence[int], drop_unreliable: bool = True) -> DataFrame:
    """Distinct source addresses of authentication failures per window."""
    b = _fine(events.where(failed_from().isNotNull()), sizes, drop_unreliable, [failed_from().alias("ip")], {"w": weight()})
    return scoped(b).select(*KEYS, "ip").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("unique_snmp_source_ips"))


def counts_json(codes: Column, key: str) -> Column:
    """Sorted-key JSON text of the summed weights of ``codes`` (facility, mnemonic, w); entries without the key are left out."""
    named = F.filter(codes, lambda s: F.coalesce(s[key], F.lit("")) != "")
    names = F.array_sort(F.array_distinct(F.transform(named, lambda s: s[key])))
    total = lambda k: F.aggregate(F.filter(named, lambda s: s[key] == k), F.lit(0).cast("long"), lambda a, s: a + s["w"])
    text = F.array_join(F.transform(names, lambda k: F.concat(F.lit('"'), k, F.lit('": '), total(k).cast("string"))), ", ")
    return F.concat(F.lit("{"), text, F.lit("}"))


CODE = ("facility", "mnemonic", "w")


def count_maps(events: DataFrame, sizes: Sequence[int], drop_unreliable: bool = True) -> DataFrame:
    """Facility and mnemonic counts per window as JSON text; windows without any code are left out."""
    fine = scoped(_fine(events, sizes, drop_unreliable, [F.col("facility"), F.col("mnemonic")], {"w": weight()}))
    codes = fine.groupBy(*KEYS, "facility", "mnemonic").agg(F.sum("w").alias("w")).groupBy(*KEYS).agg(F.collect_list(F.struct(*CODE)).alias("codes"))
    return codes.select(*KEYS, *[F.nullif(counts_json(F.col("codes"), k), F.lit("{}")).alias(f"{k}_counts") for k in ("facility", "mnemonic")]).where(
        "facility_counts is not null or mnemonic_counts is not null")


def window_rows(fine: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Windows of both scopes from counters per (bin, host, interface, facility, mnemonic, address).

    The rows of a window meet in one shuffle; they are then merged per address, so that addresses are counted and not
    collected, and per code.
    """
    by_code = scoped(fine).repartition(*KEYS).groupBy(*KEYS, "ip", "facility", "mnemonic").agg(*[F.sum(n).alias(n) for n in counters])
    by_address = by_code.withColumn("w", F.col("weighted_event_count")).groupBy(*KEYS, "ip").agg(
        *[F.sum(n).alias(n) for n in counters], F.collect_list(F.struct(*CODE)).alias("codes"))
    return by_address.groupBy(*KEYS).agg(
        *[F.sum(n).alias(n) for n in counters], F.count("ip").alias("unique_snmp_source_ips"), F.flatten(F.collect_list("codes")).alias("codes"))


def weak_labels(rows: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Rates, levels and boolean labels derived from window counters."""
    t = {**THRESHOLDS, **(thresholds or {})}
    size = F.col("window_minutes")
    flaps = F.col("port_flap_count") * (60.0 / size)
    auth = F.col("snmp_auth_fail_count") * (5.0 / size)
    ring = F.col("erps_event_count") * (60.0 / size)
    unstable = F.col("reboot_or_clock_event_count") + F.col("power_fault_count") + F.col("fan_fault_count")

    def level(v: Column, warning: str, high: str) -> Column:
        return pick([(v >= t[high], "high"), (v >= t[warning], "warning")], "none")

    return (
        rows.withColumn("degradation_level", level(flaps, "port_flaps_per_hour_warning", "port_flaps_per_hour_high"))
        .withColumn("degradation_label", F.col("degradation_level") != "none")
        .withColumn("port_flaps_per_hour", F.round(flaps, 3))
        .withColumn("loop_risk_level", level(F.col("mac_move_total"), "mac_moves_warning", "mac_moves_high"))
        .withColumn("loop_risk_label", F.col("loop_risk_level") != "none")
        .withColumn("snmp_attack_level", level(auth, "snmp_auth_fail_warning_per_5min", "snmp_auth_fail_high_per_5min"))
        .withColumn("snmp_attack_weak_label", F.col("snmp_attack_level") != "none")
        .withColumn("snmp_auth_fail_per_5min", F.round(auth, 3))
        .withColumn("device_instability_label", unstable >= t["device_instability_events"])
        .withColumn("poe_fault_label", (F.col("poe_fault_count") > 0) & F.lit(bool(t["poe_fault_high"])))
        .withColumn("erps_churn_label", ring >= t["erps_events_warning_per_hour"])
    )


def window_features(
    events: DataFrame, sizes: int | Sequence[int] = 5, drop_unreliable: bool = True, thresholds: dict | None = None,
    maps: bool = True, zone: str = "Asia/Kolkata",
) -> DataFrame:
    """Full feature and label rows for one or more bin sizes."""
    sizes = [sizes] if isinstance(sizes, int) else list(sizes)
    counters = tag_counters()
    by = [F.col("facility"), F.col("mnemonic"), failed_from().alias("ip")] if maps else [failed_from().alias("ip"), *[F.lit(None).cast("string").alias(c) for c in ("facility", "mnemonic")]]
    rows = window_rows(_fine(events, sizes, drop_unreliable, by, counters), list(counters))
    rows = rows.select(*KEYS, *counters, "unique_snmp_source_ips", *([counts_json(F.col("codes"), k).alias(f"{k}_counts") for k in ("facility", "mnemonic")] if maps else []))
    rows = rows.withColumn("port_flap_count", F.col("lineproto_up_count") + F.col("lineproto_down_count"))
    rows = rows.withColumn("window_end", F.col("window_start") + F.make_interval(mins=F.col("window_minutes")))
    for c in ("window_start", "window_end"):
        rows = rows.withColumn(f"{c}_iso", iso_text(F.col(c), zone))
    return weak_labels(rows, thresholds)


LABELS = ["degradation_label", "loop_risk_label", "snmp_attack_weak_label", "device_instability_label", "poe_fault_label", "erps_churn_label"]
TOTALS = ["total_events", "weighted_event_count", "port_flap_count", "mac_flap_count", "mac_move_total", "erps_event_count", "poe_fault_count", "snmp_auth_fail_count", "arp_mac_change_count"]


def summarize_windows(rows: DataFrame) -> DataFrame:
    """One row: windows, hosts, scopes, range, totals and label positives."""
    return rows.agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_distinct("hostname").alias("host_count"),
        F.count_if(F.col("scope") == "host").alias("host_windows"),
        F.count_if(F.col("scope") == "interface").alias("interface_windows"),
        F.min("window_start_iso").alias("first_window"),
        F.max("window_start_iso").alias("last_window"),
        *[F.sum(c).alias(f"sum_{c}") for c in TOTALS],
        *[F.count_if(c).alias(f"pos_{c}") for c in LABELS],
    )


def peak_per_bin(df: DataFrame, keys: Sequence[str], minutes: int, w: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Largest weighted count in any bin per key; events without a time do not count."""
    w = weight() if w is None else w
    bins = df.withColumn("_bin", floor_to_bin(F.col("ts"), minutes)).groupBy(*keys, "_bin").agg(F.sum(w).alias("_n"), *extra)
    return bins.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_bin").isNotNull(), F.col("_n"))), F.lit(0)).alias("peak"))
