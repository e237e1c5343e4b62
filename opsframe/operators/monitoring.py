"""Unified event table, running monitoring state and operations rollups."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.ranking import global_rank
from opsframe.functions.scalars import SEVERITY_RANK, digest_id, lookup, opt, pick, severity_rank
from opsframe.operators.findings import count_dimensions
from opsframe.operators.signals import ratio_severity

# Log finding rule to activity category; label event bounds.
LOG_CATEGORY = {
    "SYS-SNMP-AUTHFAIL": "snmp_auth", "SYS-PORT-FLAP": "port_instability", "SYS-MAC-FLAP": "loop_redundancy", "SYS-ERPS-CHURN": "loop_redundancy",
    "SYS-ARP-FAST": "duplicate_ip", "SYS-POE-FAULT": "poe", "SYS-TELNET": "management_access", "SYS-DEVICE": "device_health",
}
EVENT = [
    "event_id", "event_type", "source_engine", "severity", "title", "entity_type", "entity_id", "timestamp", "device_id", "interface_id", "vlan_id",
    "incident_id", "log_category", "has_log_evidence", "ord",
]


def _event(df: DataFrame, event_type: Column | str, engine: str, ident: Column, **cols: Column) -> DataFrame:
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    id_title = cols.pop("id_title", cols["title"])
    base = {
        "event_type": kind, "source_engine": F.lit(engine), "event_id": digest_id("EVT", 10, kind, F.lit(engine), ident, id_title, F.lit("")),
        **{c: F.lit(None).cast("string") for c in ("timestamp", "device_id", "interface_id", "vlan_id", "incident_id", "log_category")},
        "has_log_evidence": F.lit(False), "ord": F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long"), **cols,
    }
    return df.select(*[base[c].alias(c) for c in EVENT])


def _at(d: DataFrame) -> Column:
    return opt("timestamp") if "timestamp" in d.columns else F.lit(None).cast("string")


def incident_events(d: DataFrame) -> DataFrame:
    log = F.coalesce(F.col("syslog_signals") > 0, F.lit(False)) if "syslog_signals" in d.columns else F.lit(False)
    return _event(d, "correlation_incident", "correlation", F.col("incident_id"), severity=F.col("severity"), title=F.col("title"), entity_type=F.lit("incident"),
                  entity_id=F.col("incident_id"), timestamp=_at(d), device_id=opt("device"), incident_id=F.col("incident_id"), has_log_evidence=log)


def _port_entity() -> dict[str, Column]:
    dev, iface = opt("device"), opt("interface")
    return {"entity_type": F.when(iface.isNotNull(), "interface").otherwise("device"), "entity_id": F.coalesce(iface, dev, F.lit("unknown")), "device_id": dev, "interface_id": iface}


def finding_events(d: DataFrame) -> DataFrame:
    return _event(d, "config_finding", "engine_c", F.col("finding_id"), severity=F.col("severity"), title=F.col("title"), timestamp=_at(d), vlan_id=opt("vlan"), **_port_entity())


def warning_events(d: DataFrame) -> DataFrame:
    sev = F.when(F.col("severity") == "warning", "medium").otherwise(F.col("severity"))
    return _event(d, "topology_warning", "engine_c", F.col("warning_id"), severity=sev, title=F.col("message"), timestamp=_at(d), **{**_port_entity(), "entity_type": F.lit("interface")})


def plan_events(d: DataFrame) -> DataFrame:
    return _event(d, "remediation_plan", "engine_c", F.col("action_id"), severity=F.col("risk_level"), title=F.concat(F.lit("Dry-run plan: "), F.col("title")), id_title=F.col("title"), timestamp=_at(d), **_port_entity())


def health_events(d: DataFrame) -> DataFrame:
    """Anomaly events of datasets whose anomaly rate is above zero."""
    return _event(d.where("anomaly_rate > 0"), "health_anomaly", "engine_b", F.col("dataset"), severity=ratio_severity(F.col("anomaly_rate")), id_title=F.col("experiment_id"),
                  title=F.concat(F.lit("Network-health anomalies ("), F.col("dataset"), F.lit(")")), entity_type=F.lit("dataset"), entity_id=F.col("dataset"))


def model_events(d: DataFrame) -> DataFrame:
    return _event(d, "cyber_alert", "engine_a", F.col("dataset"), severity=F.lit("info"), id_title=F.col("experiment_id"),
                  title=F.concat(F.lit("Intrusion model active ("), F.col("dataset"), F.lit(")")), entity_type=F.lit("dataset"), entity_id=F.col("dataset"))


def log_finding_events(d: DataFrame) -> DataFrame:
    kind = pick([(F.col("category") == "security", "cyber_alert"), (F.col("category").isin("loop", "topology"), "topology_warning")], "config_finding")
    return _event(d, kind, "syslog", F.col("finding_id"), severity=F.col("severity"), title=F.col("title"), timestamp=opt("last_seen"), vlan_id=opt("vlan"),
                  log_category=lookup("rule_id", LOG_CATEGORY, "other"), **_port_entity())


def label_events(positives: DataFrame) -> DataFrame:
    """(run_id, label, windows) rows to one anomaly event per firing label."""
    n = F.col("windows")
    return _event(positives.where(n > 0), "health_anomaly", "syslog", F.col("run_id"), severity=pick([(n >= 20, "high"), (n >= 5, "medium")], "low"),
                  title=F.concat(F.lit("Syslog weak label: "), F.col("label")), id_title=F.col("label"), entity_type=F.lit("dataset"), entity_id=F.col("run_id"), log_category=F.lit("health_anomaly"))


MAKERS = {
    "incidents": incident_events, "findings": finding_events, "warnings": warning_events, "plans": plan_events,
    "health": health_events, "models": model_events, "log_findings": log_finding_events, "labels": label_events,
}


def to_stream_events(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One event table over every given source; works on static and streaming inputs."""
    out = None
    for name, d in tables.items():
        e = MAKERS[name](d)
        out = e if out is None else out.unionByName(e)
    return out


def order_events(df: DataFrame, max_events: int | None = None, position: str = "ord") -> DataFrame:
    """Total order: time, missing times last, then original position; ``seq`` from 0, cut to ``max_events``."""
    keyed = df.withColumns({"_late": F.col("timestamp").isNull().cast("int"), "_t": F.coalesce("timestamp", F.lit(""))})
    if max_events is not None:
        keyed = keyed.orderBy("_late", "_t", position).limit(max_events)
    ranked = global_rank(keyed, ["_late", "_t", position], out="seq")
    return ranked.withColumn("seq", F.col("seq") - 1).drop("_late", "_t")


def monitoring_counts(df: DataFrame) -> DataFrame:
    return count_dimensions(df, ["event_type", "severity", "source_engine"])


def active_incidents(df: DataFrame, order: str = "ord") -> DataFrame:
    """Last event per incident."""
    d = df.where("event_type = 'correlation_incident' and incident_id is not null")
    return d.groupBy("incident_id").agg(F.max_by(F.struct("severity", "title", "device_id"), order).alias("i")).select("incident_id", "i.*").withColumn("severity_rank", severity_rank(F.lower("severity")))


def monitoring_state(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row of totals."""
    base = df.agg(F.count(F.lit(1)).alias("total_events"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    dev = df.where("device_id is not null").select("device_id").distinct().agg(F.count(F.lit(1)).alias("active_devices"))
    inc = active_incidents(df, order).agg(F.count(F.lit(1)).alias("active_incidents"), F.count_if(F.lower("severity").isin("critical", "high")).alias("critical_incidents"))
    return base.join(F.broadcast(dev)).join(F.broadcast(inc))  # one row each


def log_state(df: DataFrame, top: int = 8) -> DataFrame:
    """(metric, n) rows: top activity categories, derived counters, clock status."""
    logs = df.where("source_engine = 'syslog'")
    cats = logs.groupBy(F.coalesce("log_category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    best = cats.orderBy(F.desc("n"), "category").limit(top).select(F.concat(F.lit("category_"), F.col("category")).alias("metric"), "n")
    c = lambda *names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("n"))), F.lit(0))
    derived = {"auth_activity": c("snmp_auth", "management_access"), "port_instability": c("port_instability"), "loop_candidates": c("loop_redundancy"), "duplicate_ip": c("duplicate_ip"), "poe_faults": c("poe")}
    row = cats.agg(*[e.alias(k) for k, e in derived.items()])
    flat = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in derived])).alias("p")).select("p.*")
    kinds = F.col("event_type").isin("config_finding", "topology_warning", "cyber_alert")
    clock = F.lower("title").contains("clock") & ((F.col("log_category") == "clock_integrity") | (F.col("event_type") == "safety_status"))
    tot = logs.agg(F.count(F.lit(1)).alias("log_events"), F.count_if(kinds).alias("log_findings"), F.count_if(clock).alias("clock_degraded"))
    ev = df.where("event_type = 'correlation_incident'").agg(F.count_if("has_log_evidence").alias("incidents_with_log_evidence"))
    names = ["log_events", "log_findings", "clock_degraded", "incidents_with_log_evidence"]
    totals = tot.join(F.broadcast(ev)).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in names])).alias("p")).select("p.*")
    return best.unionByName(flat).unionByName(totals)


def recent(df: DataFrame, n: int = 20, seq: str = "seq") -> DataFrame:
    return df.orderBy(F.desc(seq)).limit(n)


# ------------------------------------------------------------------- rollups
def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame) -> DataFrame:
    """Distinct severities in rank order and distinct rules in name order, with a position."""
    sev = df.select(F.lit("severity").alias("kind"), F.col("severity").alias("value"), F.format_string("%02d", severity_rank("severity", SEVERITY_RANK)).alias("k")).distinct()
    rules = df.select(F.lit("rule_id").alias("kind"), F.col("rule_id").alias("value"), F.col("rule_id").alias("k")).distinct()
    w = Window.partitionBy("kind").orderBy("k", "value")  # vocabulary-sized
    return sev.unionByName(rules).withColumn("position", F.row_number().over(w)).drop("k")


def network_status(critical: Column, findings: Column, anomalous: Column) -> Column:
    return pick([(critical > 0, "attention"), ((findings > 0) | anomalous, "monitor")], "stable")


def overview(incidents: DataFrame, findings: DataFrame, actions: DataFrame, models: DataFrame, health: DataFrame) -> DataFrame:
    """One overview row from scalar aggregates (one row each) and the overall status."""
    i = incidents.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.lower("severity").isin("high", "critical")).alias("high_critical"))
    f = findings.agg(F.count(F.lit(1)).alias("findings"))
    a = actions.agg(F.count_if(F.col("status") == "planned").alias("planned_actions"))
    m = models.agg(F.count(F.lit(1)).alias("production_models"))
    h = health.agg(F.max_by("dataset", F.struct(F.coalesce("anomaly_rate", F.lit(0.0)), "dataset")).alias("headline_dataset"), F.max("anomaly_rate").alias("anomaly_rate"))
    out = i
    for one in (f, a, m, h):
        out = out.join(F.broadcast(one))
    shown = F.coalesce(F.round(F.col("anomaly_rate") * 100, 1) > 0, F.lit(False))
    return out.withColumn("status", network_status(F.col("high_critical"), F.col("findings"), shown))


def executive_summary(incidents: DataFrame, limits: Mapping[str, int] | None = None, order: str = "ord") -> DataFrame:
    """First-seen devices, causes and actions of the focus incidents (critical/high, else all).

    ``incidents``: severity, devices array, cause, actions array and an ordinal. Output rows are (kind, value, position).
    """
    limits = limits or {"device": 12, "cause": 5, "action": 6}
    severe = F.lower("severity").isin("critical", "high")
    any_ = incidents.agg(F.coalesce(F.bool_or(severe), F.lit(False)).alias("_any"))
    focus = incidents.join(F.broadcast(any_)).where(severe | ~F.col("_any"))
    cell = lambda kind, i, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.cast("int").alias("i"))
    items = F.concat(
        F.transform(F.coalesce("devices", F.array().cast("array<string>")), lambda v, i: cell("device", i, v)), F.array(cell("cause", F.lit(0), F.col("cause"))),
        F.transform(F.coalesce("actions", F.array().cast("array<string>")), lambda v, i: cell("action", i, v)))
    first = focus.select(order, F.explode(items).alias("p")).where("coalesce(p.value, '') <> ''").groupBy("p.kind", "p.value").agg(F.min(F.struct(F.col(order), F.col("p.i"))).alias("at"))
    w = Window.partitionBy("kind").orderBy("at", "value")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= lookup("kind", limits)).select("kind", "value", "position")


def list_runs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs newest first (missing time last, then id descending) with a latest flag."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))
    if by:
        return df.withColumn("position", F.row_number().over(w)).withColumn("latest", F.col("position") == 1)
    top = df.agg(F.max(F.struct(F.col("created_at"), F.col("run_id"))).alias("_m"))
    return df.join(F.broadcast(top)).withColumn("latest", F.struct(F.col("created_at"), F.col("run_id")).eqNullSafe(F.col("_m"))).drop("_m").orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))


def incident_rows(df: DataFrame) -> DataFrame:
    """Display rows: joined lists, dashes for missing."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return df.select("incident_id", "severity", F.round("confidence", 2).alias("confidence"), "title", dash(F.array_join("engines", ", ")).alias("engines"), dash(F.array_join("devices", ", ")).alias("devices"))


def latest_health(df: DataFrame) -> DataFrame:
    """Newest run per dataset with its anomaly rate; ``headline`` marks the highest rate."""
    cols = [c for c in df.columns if c != "dataset"]
    d = df.groupBy("dataset").agg(F.max_by(F.struct(*cols), "experiment_id").alias("m")).select("dataset", "m.*")
    d = d.withColumn("anomaly_rate", F.coalesce(F.try_divide(F.col("n_anomalous").cast("double"), F.col("n_samples")), F.lit(0.0)))
    top = d.agg(F.min(F.struct(-F.col("anomaly_rate"), "dataset")).alias("_t"))
    return d.join(F.broadcast(top)).withColumn("headline", F.col("dataset") == F.col("_t.dataset")).drop("_t")


def production_models(production: DataFrame, best: DataFrame, metrics: DataFrame) -> DataFrame:
    out = production.join(best.select("dataset", F.col("value").alias("test_f1")), "dataset", "left")
    return out.join(metrics.select("dataset", "model_type", "experiment_id", "roc_auc"), ["dataset", "model_type", "experiment_id"], "left")


