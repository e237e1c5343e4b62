"""Signals: one common row shape for findings, warnings, health metrics, models and log evidence."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scalars import digest_id, grab, lookup, opt, pick
from opsframe.operators.logs import MAC

# Engines, source types, evidence bands and confidences.
ENGINE_A, ENGINE_B, ENGINE_C, SYSLOG = "engine_a", "engine_b", "engine_c", "syslog"
SOURCE_TYPES = {
    "SYS-SNMP-AUTHFAIL": "SYSLOG_SNMP_AUTH_ACTIVITY",
    "SYS-PORT-FLAP": "SYSLOG_PORT_FLAP",
    "SYS-MAC-FLAP": "SYSLOG_MAC_FLAP",
    "SYS-ARP-FAST": "SYSLOG_DUPLICATE_IP",
    "SYS-ERPS-CHURN": "SYSLOG_ERPS_CHURN",
    "SYS-POE-FAULT": "SYSLOG_POE_FAULT",
    "SYS-TELNET": "SYSLOG_MANAGEMENT_ACCESS",
    "SYS-DEVICE": "SYSLOG_HA_STATE_CHANGE",
}
BANDS = {
    "SYSLOG_SNMP_AUTH_ACTIVITY": "high",
    "SYSLOG_DUPLICATE_IP": "high",
    "SYSLOG_POE_FAULT": "high",
    "SYSLOG_PORT_FLAP": "high",
    "SYSLOG_ERPS_CHURN": "high",
    "SYSLOG_HA_STATE_CHANGE": "high",
    "SYSLOG_MAC_FLAP": "medium",
    "SYSLOG_MANAGEMENT_ACCESS": "medium",
    "SYSLOG_GENERIC_WARNING": "low",
    "SYSLOG_CLOCK_UNRELIABLE": "low",
}
AGGREGATE_TYPES = ["SYSLOG_SNMP_AUTH_ACTIVITY", "SYSLOG_HA_STATE_CHANGE", "SYSLOG_GENERIC_WARNING", "SYSLOG_CLOCK_UNRELIABLE"]
BAND_CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
FINDING_CONFIDENCE = {"high": 0.9, "medium": 0.75, "low": 0.55}
WARNING_SEVERITY = {"critical": "critical", "warning": "medium", "info": "info"}
CARD_SEVERITY = {"critical": "high", "warning": "medium"}
WARNING_CONFIDENCE, CARD_CONFIDENCE, AGGREGATE_CONFIDENCE = 0.6, 0.5, 0.6
CLOCK_FACTOR, ENTITY_FACTOR = 0.6, 0.85
# Long interface names and short forms; a prefix of a long name counts, first match wins.
IFACE_PREFIXES = [
    ("tengigabitethernet", "te"), ("tengige", "te"), ("tengig", "te"),
    ("gigabitethernet", "gi"), ("gigabit", "gi"), ("gige", "gi"), ("gig", "gi"),
    ("fastethernet", "fa"), ("ethernet", "eth"), ("tunnel", "tu"),
    ("port-channel", "po"), ("portchannel", "po"),
]
# Attack families per labelled dataset.
ATTACK_FAMILIES = {
    "unsw_nb15": ["dos", "exploits", "reconnaissance", "fuzzers", "generic", "backdoor", "analysis", "shellcode", "worms"],
    "nsl_kdd": ["dos", "probe", "r2l", "u2r"],
    "cicids2017": ["dos", "ddos", "portscan", "bruteforce", "web_attack", "botnet", "infiltration"],
}

COLUMNS = {
    "run_id": "string", "signal_id": "string", "engine": "string", "source_artifact": "string", "source_type": "string",
    "category": "string", "severity": "string", "confidence": "double", "confidence_label": "string", "title": "string",
    "raw_reference": "string", "device": "string", "interface": "string", "vlan": "string", "mac": "string", "src_ip": "string",
    "event_count": "long", "aggregate": "boolean", "clock_unreliable": "boolean", "entity_confident": "boolean", "tags": "array<string>",
}


def _words(*ws: Column | str) -> Column:
    return F.array(*[F.lit(w) if isinstance(w, str) else w for w in ws])


def signal_id(engine: str, src: Column, category: Column, device: Column, interface: Column, title: Column) -> Column:
    return digest_id("SIG", 10, F.lit(engine), src, category, device, interface, title)


def _signals(df: DataFrame, engine: str, key: Column, **cols: Column) -> DataFrame:
    """Fill the common shape; ``key`` is the category part of the id."""
    none = F.lit(None)
    base = {
        "event_count": F.lit(1), "aggregate": F.lit(False), "clock_unreliable": F.lit(False), "entity_confident": F.lit(True),
        **{k: none for k in ("source_type", "confidence_label", "raw_reference", "device", "interface", "vlan", "mac", "src_ip")}, **cols,
    }
    base["engine"] = F.lit(engine)
    base["signal_id"] = signal_id(engine, base["source_artifact"], key, base["device"].cast("string"), base["interface"].cast("string"), base["title"])
    return df.select(*[base.get(c, F.col(c)).cast(t).alias(c) for c, t in COLUMNS.items()])


def config_signals(findings: DataFrame | None = None, warnings: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """Policy findings, topology warnings and unhealthy device cards; ``run_id`` is the snapshot."""
    out = []
    path = lambda name: F.concat(F.lit("network_config/"), F.col("run_id"), F.lit(f"/{name}"))
    if findings is not None:
        out.append(_signals(
            findings, ENGINE_C, F.col("category"), source_artifact=path("findings.json"), category=F.coalesce("category", F.lit("config")),
            severity=F.coalesce("severity", F.lit("info")), title=F.coalesce("title", "rule_id"),
            confidence=F.coalesce(lookup(F.coalesce("confidence", F.lit("medium")), FINDING_CONFIDENCE), F.lit(0.7)),
            raw_reference=F.col("finding_id"), device=opt("device"), interface=opt("interface"), vlan=opt("vlan"),
            tags=F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("rule_id")),
        ))
    if warnings is not None:
        category = F.coalesce("category", F.lit("topology"))
        out.append(_signals(
            warnings, ENGINE_C, F.concat(F.lit("topology:"), category), source_artifact=path("topology.json"), category=F.lit("topology"),
            severity=F.coalesce(lookup("severity", WARNING_SEVERITY), F.lit("info")), title=F.coalesce("message", F.lit("topology warning")),
            confidence=F.lit(WARNING_CONFIDENCE), raw_reference=F.col("warning_id"), device=opt("device"), interface=opt("interface"),
            tags=_words("topology", category),
        ))
    if cards is not None:
        status = F.lower("status")
        out.append(_signals(
            cards.where(status.isin(*CARD_SEVERITY)), ENGINE_C, F.lit("device_health"), source_artifact=path("dashboard/device_health_cards.json"),
            category=F.lit("device_health"), severity=lookup(status, CARD_SEVERITY), confidence=F.lit(CARD_CONFIDENCE),
            title=F.concat(F.lit("Device health "), status, F.lit(": "), F.coalesce(opt("device"), F.lit("None"))),
            raw_reference=F.coalesce(opt("device"), F.lit("")), device=opt("device"), aggregate=F.lit(True), tags=_words(F.lit("device_health"), status),
        ))
    return _union(out)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ratio_severity(ratio: Column, high: float = 0.2, medium: float = 0.05) -> Column:
    return pick([(ratio >= high, "high"), (ratio >= medium, "medium"), (ratio > 0, "low")], "info")


def health_signals(metrics: DataFrame) -> DataFrame:
    """One aggregate signal per (run, dataset) from its newest experiment (largest id)."""
    newest = metrics.groupBy("run_id", "dataset").agg(F.max_by(F.struct("experiment_id", "model_name", "n_samples", "n_anomalous"), "experiment_id").alias("m"))
    d = newest.select("run_id", "dataset", "m.*")
    ratio = F.coalesce(F.try_divide(F.col("n_anomalous").cast("double"), F.col("n_samples")), F.lit(0.0))
    src = F.concat_ws("/", F.lit("network_health/experiments"), "dataset", F.coalesce("model_name", F.lit("model")), "experiment_id", F.lit("metrics.json"))
    return _signals(
        d, ENGINE_B, F.lit("network_health"), source_artifact=src, category=F.lit("network_health"), severity=ratio_severity(ratio),
        confidence=F.lit(AGGREGATE_CONFIDENCE), title=F.concat(F.lit("Network-health anomalies (aggregate, "), F.col("dataset"), F.lit(")")),
        raw_reference=F.col("experiment_id"), aggregate=F.lit(True), tags=_words("anomaly", "degradation", "aggregate"),
    )


def intrusion_signals(runs: DataFrame, promoted: DataFrame, best: DataFrame, families: Mapping[str, Sequence[str]] = ATTACK_FAMILIES) -> DataFrame:
    """One aggregate signal per (run, dataset): promoted experiment, else best, else newest that exists."""
    key = ["run_id", "dataset"]
    newest = runs.groupBy(*key).agg(F.max_by(F.struct("experiment_id", "model_type"), "experiment_id").alias("n"))
    p = promoted.select(*key, F.col("experiment_id").alias("p_id"))
    b = best.select(*key, F.col("experiment_id").alias("b_id"))
    chosen = newest.join(p, key, "left").join(b, key, "left").withColumn("want", F.coalesce("p_id", "b_id"))
    found = runs.select(*key, F.col("experiment_id").alias("want"), F.col("model_type").alias("found_type"))
    d = chosen.join(found, [*key, "want"], "left").select(
        *key, F.when(F.col("found_type").isNotNull(), F.col("want")).otherwise(F.col("n.experiment_id")).alias("experiment_id"),
        F.coalesce("found_type", "n.model_type").alias("model_type"))
    fam = pick([(F.col("dataset") == k, _words(*v)) for k, v in families.items()], F.array().cast("array<string>"))
    src = F.concat_ws("/", F.lit("experiments"), "dataset", "model_type", "experiment_id", F.lit("metrics.json"))
    return _signals(
        d, ENGINE_A, F.lit("intrusion"), source_artifact=src, category=F.lit("intrusion"), severity=F.lit("medium"), confidence=F.lit(AGGREGATE_CONFIDENCE),
        title=F.concat(F.lit("Intrusion-detection coverage (aggregate, "), F.col("dataset"), F.lit(")")), raw_reference=F.col("experiment_id"),
        aggregate=F.lit(True), tags=F.concat(_words("attack", "aggregate"), fam),
    )


def signal_confidence(source_type: Column, clock_bad: Column, entity_sure: Column) -> dict[str, Column]:
    """``confidence``, ``band`` and ``notes`` from evidence quality."""
    band = F.coalesce(lookup(source_type, BANDS), F.lit("medium"))
    value = F.coalesce(lookup(band, BAND_CONFIDENCE), F.lit(0.7))
    value = value * F.when(clock_bad, CLOCK_FACTOR).otherwise(1.0) * F.when(entity_sure, 1.0).otherwise(ENTITY_FACTOR)
    lowered = F.when(clock_bad, F.lit("low")).otherwise(band)
    return {
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)),
        "band": F.when(~entity_sure & (lowered == "high"), "medium").otherwise(lowered),
        "notes": F.array_compact(F.array(F.when(clock_bad, "timestamps unreliable"), F.when(~entity_sure, "device/interface identity incomplete"))),
    }


def canonical_iface(c: Column) -> Column:
    """Short lower-case interface name for matching across sources; odd shapes stay lower-cased."""
    text = F.trim(c)
    shape = r"^\s*([a-zA-Z][a-zA-Z\-]*?)\s*([\d/\.:]+)\s*$"
    prefix, number = F.lower(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)
    short = pick([((prefix == s) | F.startswith(F.lit(long), prefix), s) for long, s in IFACE_PREFIXES])
    out = F.when(text.rlike(shape), F.concat(F.coalesce(short, prefix), number)).otherwise(F.replace(F.lower(text), F.lit(" "), F.lit("")))
    return F.when(text != "", out)


def match_entities(dev_a: Column, if_a: Column, dev_b: Column, if_b: Column) -> Column:
    """exact / normalized / uncertain / none for a pair of entities; never merges on similar names."""
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    same_dev = F.coalesce(low(dev_a) == low(dev_b), F.lit(False))
    both = low(if_a).isNotNull() & low(if_b).isNotNull()
    same_if = F.coalesce(low(if_a) == low(if_b), F.lit(False))
    return pick([
        (~same_dev & same_if, "uncertain"), (~same_dev, "none"), (~both | same_if, "exact"),
        (canonical_iface(if_a) == canonical_iface(if_b), "normalized"),
    ], "uncertain")


def log_signals(findings: DataFrame) -> DataFrame:
    """Signals of log findings; ``run_id`` is the ingestion run."""
    tagged = F.arrays_overlap(F.transform("tags", F.lower), _words("insecure_telnet", "management_access"))
    kind = F.coalesce(lookup("rule_id", SOURCE_TYPES), F.when(tagged, "SYSLOG_MANAGEMENT_ACCESS").otherwise("SYSLOG_GENERIC_WARNING"))
    d = findings.withColumn("_st", kind)
    st = F.col("_st")
    aggregate = st.isin(*AGGREGATE_TYPES)
    sure = opt("device").isNotNull() & (aggregate | opt("interface").isNotNull())
    conf = signal_confidence(st, F.lit(False), sure)
    return _signals(
        d, SYSLOG, st, source_artifact=F.concat(F.lit("syslog_ingestion/"), F.col("run_id"), F.lit("/engine_c/syslog_findings.json")),
        source_type=st, category=F.col("category"), severity=F.coalesce("severity", F.lit("info")), confidence=conf["confidence"], confidence_label=conf["band"],
        title=F.coalesce("title", "rule_id"), raw_reference=F.col("finding_id"), device=opt("device"), interface=opt("interface"), vlan=opt("vlan"),
        mac=F.coalesce(opt(F.col("details")["mac"]), grab("title", MAC)), src_ip=opt(F.col("details")["ip_address"]),
        event_count=F.greatest(F.lit(1), F.coalesce("event_count", F.lit(1))), entity_confident=sure, aggregate=aggregate,
        tags=F.concat("tags", F.array(st, F.lit("syslog"))),
    )


def clock_signal(events: DataFrame) -> DataFrame:
    """One low signal per run with any unreliable clock, on the first host by name."""
    bad = events.groupBy("run_id").agg(F.count_if("clock_unreliable").alias("n"), F.min("hostname").alias("host")).where("n > 0")
    conf = signal_confidence(F.lit("SYSLOG_CLOCK_UNRELIABLE"), F.lit(True), F.lit(True))
    return _signals(
        bad, SYSLOG, F.lit("SYSLOG_CLOCK_UNRELIABLE"), source_artifact=F.concat(F.lit("syslog_ingestion/"), F.col("run_id"), F.lit("/parser_summary.json")),
        source_type=F.lit("SYSLOG_CLOCK_UNRELIABLE"), category=F.lit("clock"), severity=F.lit("low"), confidence=conf["confidence"], confidence_label=conf["band"],
        title=F.lit("Unreliable device clock(s) observed in syslog"), raw_reference=F.col("n").cast("string"), device=F.col("host"), event_count=F.col("n"),
        clock_unreliable=F.lit(True), entity_confident=F.col("host").isNotNull(), aggregate=F.lit(True),
        tags=_words("clock_unreliable", "SYSLOG_CLOCK_UNRELIABLE", "syslog"),
    )


def generic_signals(events: DataFrame, cap: int = 25, severity: str = "info") -> DataFrame:
    """Unclassified events grouped by (host, code): the top ``cap`` of each run by weighted count."""
    host = F.coalesce(opt("hostname"), F.lit("unknown"))
    code = F.coalesce("code", "facility", F.lit("GENERIC"))
    g = events.where("parse_status = 'generic'").groupBy("run_id", host.alias("host"), code.alias("code")).agg(F.sum(F.greatest(F.lit(1), "duplicate_count")).alias("n"))
    w = Window.partitionBy("run_id").orderBy(F.desc("n"), "host", "code")
    top = g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    conf = signal_confidence(F.lit("SYSLOG_GENERIC_WARNING"), F.lit(False), F.lit(True))
    out = _signals(
        top, SYSLOG, F.lit("SYSLOG_GENERIC_WARNING"), source_artifact=F.concat(F.lit("syslog_ingestion/"), F.col("run_id"), F.lit("/parsed_events.json")),
        source_type=F.lit("SYSLOG_GENERIC_WARNING"), category=F.lit("generic"), severity=F.lit(severity), confidence=conf["confidence"], confidence_label=conf["band"],
        title=F.concat(F.lit("Unclassified syslog activity: "), F.col("code"), F.lit(" on "), F.col("host")), raw_reference=F.col("code"), device=F.col("host"),
        interface=F.col("code"), event_count=F.col("n"), entity_confident=F.lit(False), aggregate=F.lit(True), tags=_words("generic", "SYSLOG_GENERIC_WARNING", "syslog"),
    )
    return out.withColumn("interface", F.lit(None).cast("string"))  # the code is part of the id only
