"""Interface telemetry: canonical schema, checks, coverage, bounds and time splits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.quantiles import exact_quantiles
from opsframe.functions.scalars import lookup, num, pick
from opsframe.operators import series as sr

# Canonical columns, status words, benign label words.
CORE = ["timestamp", "device_id", "interface_id"]
COUNTERS = ["ifInOctets", "ifOutOctets", "ifInErrors", "ifOutErrors", "ifInDiscards", "ifOutDiscards"]
GAUGES = ["cpu_usage", "memory_usage", "latency_ms", "packet_loss", "jitter_ms", "bandwidth_utilization"]
STATUS = ["ifOperStatus", "ifAdminStatus"]
OPTIONAL = [*COUNTERS, *STATUS, *GAUGES, "label", "anomaly_type", "fault_type"]
STATUS_CODES = {
    "up": 1.0, "down": 2.0, "operational": 1.0, "active": 1.0, "inactive": 2.0,
    "enabled": 1.0, "disabled": 2.0, "true": 1.0, "false": 2.0,
}
BENIGN = ["normal", "benign", "0", "none", "healthy", "ok", ""]
# Raw names per canonical column, and extra names per dataset type.
ALIASES = {
    "timestamp": ["time", "ts", "datetime", "date_time", "record_time", "timestamp_utc", "collection_time", "epoch"],
    "device_id": ["device", "node", "node_id", "host", "hostname", "switch", "router", "agent", "agent_ip", "src_device", "source_ip"],
    "interface_id": ["interface", "ifindex", "if_name", "ifname", "port", "link", "iface", "if_descr", "ifdescr"],
    "ifInOctets": ["in_octets", "inoctets", "bytes_in", "rx_bytes", "ifhcinoctets", "octets_in"],
    "ifOutOctets": ["out_octets", "outoctets", "bytes_out", "tx_bytes", "ifhcoutoctets", "octets_out"],
    "ifInErrors": ["in_errors", "inerrors", "rx_errors", "errors_in"],
    "ifOutErrors": ["out_errors", "outerrors", "tx_errors", "errors_out"],
    "ifInDiscards": ["in_discards", "indiscards", "rx_discards", "discards_in", "in_drops"],
    "ifOutDiscards": ["out_discards", "outdiscards", "tx_discards", "discards_out", "out_drops"],
    "ifOperStatus": ["oper_status", "operstatus", "link_status", "if_oper_status", "operational_status"],
    "ifAdminStatus": ["admin_status", "adminstatus", "if_admin_status"],
    "cpu_usage": ["cpu", "cpu_util", "cpu_percent", "cpu_load", "sysload", "cpu_utilization"],
    "memory_usage": ["mem_usage", "memory", "mem", "mem_percent", "ram_usage", "memory_utilization"],
    "latency_ms": ["latency", "delay", "delay_ms", "rtt", "rtt_ms"],
    "packet_loss": ["pkt_loss", "loss", "packet_loss_pct", "loss_rate", "packetloss"],
    "jitter_ms": ["jitter", "jitter_msec"],
    "bandwidth_utilization": ["bandwidth", "bw_util", "utilization", "link_utilization", "bw_utilization"],
    "label": ["anomaly", "is_anomaly", "target", "class", "y", "attack"],
    "anomaly_type": ["anomalytype", "anomaly_class"],
    "fault_type": ["faulttype", "fault", "fault_label", "attack_type", "attack_cat"],
}
TYPE_ALIASES = {
    "snmp_mib_2016": {
        "ifInOctets": ["ifhcinoctets", "ifinucastpkts"],
        "ifOutOctets": ["ifhcoutoctets", "ifoutucastpkts"],
        "label": ["class"],
    },
    "lcore_d": {
        "device_id": ["node_name", "core_node"],
        "interface_id": ["link", "link_id", "edge"],
        "fault_type": ["fault_state", "failure_type"],
    },
}
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd"]


@dataclass(frozen=True)
class TelemetrySchema:
    """Column roles of a telemetry table."""

    ts: str = "timestamp"
    device: str = "device_id"
    interface: str = "interface_id"
    label: str | None = "label"
    required: Sequence[str] = tuple(CORE)
    counters: Sequence[str] = tuple(COUNTERS)
    gauges: Sequence[str] = tuple(GAUGES)
    status: Sequence[str] = tuple(STATUS)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def series(self) -> list[str]:
        return [self.device, self.interface]

    def present(self, df: DataFrame, cols: Sequence[str]) -> list[str]:
        return [c for c in cols if c in df.columns]


def token(name: str) -> str:
    return re.sub("[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def map_columns(columns: Sequence[str], dataset_type: str = "canonical_csv", aliases: Mapping[str, Sequence[str]] = {}) -> tuple[dict[str, str], list[str]]:
    """Canonical name to raw column, and the raw columns left over; a driver-side name map only."""
    index = {token(c): c for c in [*CORE, *OPTIONAL]}
    for layer in (ALIASES, TYPE_ALIASES.get(dataset_type, {}), aliases):
        index.update({token(a): c for c, names in layer.items() for a in names})
    mapped: dict[str, str] = {}
    left = []
    for raw in columns:
        target = index.get(token(raw))
        if target and target not in mapped:
            mapped[target] = raw
        else:
            left.append(raw)
    return mapped, left


def parse_ts(c: Column, fmt: str | None = None) -> Column:
    """Timestamp or null; ``fmt`` makes the parse strict."""
    text = c.cast("string")
    formats = [fmt] if fmt else TIME_FORMATS
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def coerce_status(c: Column) -> Column:
    return F.coalesce(num(c.cast("string")), lookup(F.lower(F.trim(c.cast("string"))), STATUS_CODES))


def map_label(df: DataFrame, column: str, label_map: Mapping[str, int] | None = None) -> Column:
    """0/1 label expression; without a map, one small aggregate decides if the column is numeric."""
    text = F.trim(F.col(f"`{column}`").cast("string"))
    if label_map:
        return lookup(text, {str(k): int(v) for k, v in label_map.items()})
    numeric = df.agg(F.bool_and(num(text).isNotNull() & ~F.isnan(num(text)))).first()[0]
    if numeric:
        return num(text).cast("int")
    return (~F.coalesce(F.lower(text), F.lit("nan")).isin(*BENIGN)).cast("int")


def to_canonical(
    df: DataFrame, dataset_type: str = "canonical_csv", aliases: Mapping[str, Sequence[str]] = {}, device: str | None = None,
    interface: str | None = None, label_map: Mapping[str, int] | None = None, fmt: str | None = None, keep_unknown: bool = False,
) -> DataFrame:
    """Raw telemetry to the canonical table."""
    mapped, left = map_columns(df.columns, dataset_type, aliases)
    if "timestamp" not in mapped:
        raise ValueError("no timestamp column found; add an alias for it")
    raw = lambda c: F.col(f"`{mapped[c]}`")
    out = [parse_ts(raw("timestamp"), fmt).alias("timestamp")]
    for name, default in (("device_id", device or "device_0"), ("interface_id", interface or "interface_0")):
        out.append((raw(name).cast("string") if name in mapped else F.lit(default)).alias(name))
    for name in OPTIONAL:
        if name not in mapped:
            continue
        if name in COUNTERS or name in GAUGES:
            e = num(raw(name).cast("string"))
        elif name in STATUS:
            e = coerce_status(raw(name))
        elif name == "label":
            e = map_label(df, mapped[name], label_map)
        else:
            e = raw(name)
        out.append(e.alias(name))
    if keep_unknown:
        taken = {*CORE, *[c for c in OPTIONAL if c in mapped]}
        out += [F.col(f"`{c}`").alias(f"raw_{c}" if c in taken else c) for c in left]
    return df.select(*out)


def probe_columns(df: DataFrame, dataset_type: str = "canonical_csv") -> DataFrame:
    """Role of every raw column, from one aggregate over the table."""
    mapped, _ = map_columns(df.columns, dataset_type)
    known = {raw: canonical for canonical, raw in mapped.items()}
    stats = []
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`").cast("string")
        stats += [F.count_if(num(text).isNotNull()).alias(f"n{i}"), F.count_if(parse_ts(text).isNotNull()).alias(f"t{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *stats)
    parts = []
    for i, c in enumerate(df.columns):
        canonical = known.get(c)
        is_time = F.lit(canonical == "timestamp") | ((F.col(f"n{i}") == 0) & (F.col("rows") > 0) & (F.col(f"t{i}") / F.col("rows") > 0.9))
        role = pick([(is_time, "timestamp"), (F.lit(canonical in ("label", "anomaly_type", "fault_type")), "label"), (F.col(f"n{i}") > 0, "metric")], "other")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(canonical).cast("string").alias("canonical"), role.alias("role")))
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def clip_bounds(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values below/above the bound move to the bound; null stays null."""
    out = {}
    for c, (lo, hi) in bounds.items():
        e = F.col(c)
        clipped = F.when(e < lo, F.lit(lo)) if lo is not None else F.when(F.lit(False), e)
        if hi is not None:
            clipped = clipped.when(e > hi, F.lit(hi))
        out[c] = clipped.otherwise(e).cast(df.schema[c].dataType)
    return df.withColumns(out)


def series_coverage(df: DataFrame, schema: TelemetrySchema = TelemetrySchema()) -> DataFrame:
    """Devices, interfaces summed over devices, and rows per series."""
    per = df.groupBy(*schema.series).agg(F.count(F.lit(1)).alias("n"))
    per_device = per.groupBy(schema.device).agg(F.count(schema.interface).alias("k"), F.sum("n").alias("s"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("c"))
    return per_device.agg(
        F.count(F.lit(1)).alias("n_devices"), F.sum("k").alias("n_interfaces"), F.sum("c").alias("n_series"),
        F.min("lo").alias("rows_min"), F.max("hi").alias("rows_max"), (F.sum("s") / F.sum("c")).alias("rows_mean"),
    )


def check_telemetry(df: DataFrame, schema: TelemetrySchema) -> DataFrame:
    """Issue rows (severity, check_name, column, n). Missing columns end the checks."""
    spark = df.sparkSession
    shape = "severity string, check_name string, column string, n long"
    missing = [c for c in schema.required if c not in df.columns]
    if missing:
        return spark.createDataFrame([("error", "required_columns", c, 1) for c in missing], shape)
    numeric = schema.present(df, [*schema.counters, *schema.gauges])
    text = lambda c: F.col(c).cast("string")
    val = {c: num(text(c)) for c in {*numeric, *schema.present(df, schema.bounds)}}
    checks: list[tuple[str, str, str, Column]] = [("error", "timestamp", schema.ts, F.count_if(parse_ts(F.col(schema.ts)).isNull()))]
    checks += [("error", "numeric", c, F.count_if(F.col(c).isNotNull() & val[c].isNull())) for c in numeric]
    checks += [("warning", "missing_values", c, F.count_if(F.col(c).isNull())) for c in schema.required]
    checks += [("error", "negative_values", c, F.count_if(val[c] < 0)) for c in numeric]
    checks += [("warning", "bounds", c, F.count_if((val[c] < lo) | (val[c] > hi))) for c, (lo, hi) in schema.bounds.items() if c in df.columns]
    row = df.agg(*[e.alias(f"k{i}") for i, (_, _, _, e) in enumerate(checks)])
    issues = row.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("severity"), F.lit(k).alias("check_name"), F.lit(c).alias("column"), F.col(f"k{i}").alias("n")) for i, (s, k, c, _) in enumerate(checks)
    ])).alias("p")).select("p.*")
    copies = df.groupBy(schema.ts, *schema.series).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    issues = issues.unionByName(copies.select(F.lit("warning").alias("severity"), F.lit("duplicates").alias("check_name"), F.lit(schema.ts).alias("column"), "n"))
    counters = schema.present(df, schema.counters)
    if counters:
        work = df.select(*schema.series, parse_ts(F.col(schema.ts)).alias("_t"), *[val[c].alias(c) for c in counters])
        valid = work.where(F.col("_t").isNotNull())
        h = sr.with_history(valid, 1, schema.series, ["_t", *counters])
        w = sr.chunk_window(schema.series, ["_t", *counters])
        drops = sr.drop_history(h.withColumns({f"_d{i}": F.col(c) < F.lag(c).over(w) for i, c in enumerate(counters)}))
        # like the other checks, order is only judged when every time parses
        agg = drops.agg(*[F.count_if(f"_d{i}").alias(f"_d{i}") for i in range(len(counters))])
        bad = df.agg(F.count_if(parse_ts(F.col(schema.ts)).isNull()).alias("bad"))
        rows = agg.join(F.broadcast(bad)).where("bad = 0").select(F.explode(F.array(*[
            F.struct(F.lit("warning").alias("severity"), F.lit("counter_monotonicity").alias("check_name"), F.lit(c).alias("column"), F.col(f"_d{i}").alias("n")) for i, c in enumerate(counters)
        ])).alias("p")).select("p.*")
        issues = issues.unionByName(rows)
    return issues.where("n > 0")


def split_by_time(df: DataFrame, ts: str, fractions: Mapping[str, float] | None = None) -> DataFrame:
    """``split`` by global time quantiles; ties stay in the earlier split."""
    f = fractions or {"train": 0.7, "validation": 0.15, "test": 0.15}
    total = sum(f.values())
    q1 = f["train"] / total
    q2 = q1 + f["validation"] / total
    d = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    cuts = exact_quantiles(d, ["_us"], [q1, q2])["_us"]
    if cuts[0] is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    us = F.col("_us")
    return d.withColumn("split", pick([(us <= cuts[0], "train"), (us <= cuts[1], "validation")], "test")).drop("_us")
