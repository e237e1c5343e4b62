"""Vendor event parsing, normalisation, routing and redaction."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.functions.scalars import EVENT_SEVERITY_RANK, lookup, num, once, opt, pick, severity_rank, strip

# key=value grammar, header grammar, trap grammar.
KV = r'(\w[\w.\-]*)=(?:"([^"]*)"|(\S+))'
KV_HEADER = r"^(?:<\d+>)?\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*|[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})?\s*(\S+)?\s*"
TRAP_LINE = r"^\s*(\S+)\s+(\d{1,3}(?:\.\d{1,3}){3})\s+(\w+)\s*(.*)$"
# Firewall subtype to category.
SUBTYPE_CATEGORY = {
    "denied": "firewall", "allowed": "firewall", "firewall": "firewall", "ips": "ips", "idp": "ips", "antivirus": "antivirus", "virus": "antivirus",
    "web filter": "web_filter", "webfilter": "web_filter", "sandstorm": "sandbox", "sandbox": "sandbox", "atp": "ips", "authentication": "authentication",
}
# Trap name to category, subcategory, severity.
TRAPS = {
    "linkdown": ("interface", "port_down", "medium"),
    "linkup": ("interface", "port_up", "info"),
    "coldstart": ("system", "restart", "medium"),
    "warmstart": ("system", "restart", "low"),
    "authenticationfailure": ("security", "auth_failure", "medium"),
    "hmtemperature": ("environment", "temperature", "high"),
    "hmpowersupply": ("power", "power_supply", "high"),
    "hmsignalcontact": ("environment", "signal_contact", "high"),
    "hmpoefault": ("power", "poe_fault", "high"),
    "topologychange": ("topology", "stp_change", "medium"),
    "risingalarm": ("environment", "rmon_alarm", "high"),
}
# Alert type prefix to category, first match wins.
ALERT_CATEGORY = [
    ("Event::Endpoint::Threat", "antivirus"), ("Event::Endpoint", "endpoint"), ("Event::Firewall", "firewall"), ("Event::IPS", "ips"),
    ("Event::Web", "web_filter"), ("Event::Sandbox", "sandbox"), ("Event::Authentication", "authentication"),
]
# Severity words and the five levels they stand for.
SEVERITY_WORDS = {
    "critical": "critical", "crit": "critical", "emergency": "critical", "alert": "critical", "severe": "critical",
    "high": "high", "error": "high", "err": "high", "major": "high",
    "medium": "medium", "warning": "medium", "warn": "medium", "minor": "medium", "moderate": "medium",
    "low": "low", "notice": "low", "info": "info", "informational": "info", "debug": "info", "none": "info",
}
# Source to target engine.
ENGINE_TARGETS = ["cyber", "network_health", "network_config"]
ROUTES = {
    "sophos": "cyber", "sophos_api": "cyber", "sophos_syslog": "cyber",
    "hirschmann_snmp": "network_health", "hirschmann_traps": "network_health", "hirschmann_config": "network_config",
}
THRESHOLDS = {"in_errors_high": 100.0, "in_discards_high": 100.0, "utilization_high": 90.0, "temperature_high_c": 70.0, "temperature_critical_c": 80.0}
# Secret key words and secret patterns inside text.
MASK = "***REDACTED***"
SECRET_WORDS = [
    "password", "passwd", "secret", "client_secret", "token", "api_key", "apikey", "authorization", "auth_header", "community",
    "snmp_community", "private_key", "privkey", "credential", "session_key", "bearer",
]
SECRET_PATTERNS = [
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._\-]+", True),
    (r"(?i)\b(authorization\s*[:=]\s*)\S+", True),
    (r"(?i)\bcommunity\s*[:=]?\s+\S+", False),
    (r"(?i)\b(password\s*[:=]\s*)\S+", True),
    (r"(?i)\b(client_secret\s*[:=]\s*)\S+", True),
    (r"(?i)\b(token\s*[:=]\s*)\S+", True),
    (r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", False),
]
RECORD = [
    "source_vendor", "source_product", "source_type", "source_key", "source_name", "timestamp", "category", "subcategory", "severity", "message",
    "device_ip", "hostname", "device_id", "raw_ref", "correlation_keys", "fields",
]


def with_kv(df: DataFrame, c: Column, out: str = "f") -> DataFrame:
    """Lower-cased key=value pairs of a text as a map column; the last of repeated keys wins.

    The three regex passes are made once per row; everything after works on their arrays.
    """
    part = lambda i: F.regexp_extract_all(c, F.lit(KV), F.lit(i))
    d = once(df, _k=F.transform(part(1), F.lower), _q=part(2), _b=part(3))
    value = F.zip_with("_q", "_b", lambda q, b: F.when(b != "", b).otherwise(q))
    pairs = F.zip_with("_k", value, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice("_k", i + 2, F.greatest(F.size("_k"), F.lit(1))), p["key"]))
    unique = F.size(F.array_distinct("_k")) == F.size("_k")
    return once(d, **{out: F.map_from_entries(F.when(unique, pairs).otherwise(last))}).drop("_k", "_q", "_b")


def _field(*names: str) -> Column:
    """First non-empty field of the map column ``f``."""
    return F.coalesce(*[F.nullif(F.element_at("f", n), F.lit("")) for n in names])


def _drop_nulls(**kv: Column) -> Column:
    m = F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def _record(df: DataFrame, vendor: str, product: str, source_type: str, key: str, **cols: Column) -> DataFrame:
    base = {
        "source_vendor": F.lit(vendor), "source_product": F.lit(product), "source_type": F.lit(source_type), "source_key": F.lit(key),
        **{c: F.lit(None).cast("string") for c in ("device_ip", "hostname", "device_id", "raw_ref", "subcategory")}, **cols,
    }
    keep = [c for c in ("ord",) if c in df.columns]
    return df.select(*keep, *[base[c].alias(c) for c in RECORD])


def parse_kv_syslog(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Firewall key=value lines: (records, whole lines without any field). Blank lines are neither."""
    text = strip(F.col("line"))
    d = once(lines, _text=text).where("_text <> ''")
    d = once(d, _ts=F.nullif(F.regexp_extract("_text", KV_HEADER, 1), F.lit("")), _payload=F.regexp_replace("_text", KV_HEADER, ""))
    d = with_kv(d, F.col("_payload"))
    bad = d.where("size(f) = 0").select(*[c for c in ("ord",) if c in lines.columns], F.lit("no fields").alias("error"), F.col("_text").alias("line"))
    subtype = [lookup(F.lower(F.trim(F.element_at("f", k))), SUBTYPE_CATEGORY) for k in ("log_subtype", "log_type", "log_component")]
    src, dst = _field("src_ip", "source_ip", "srcip"), _field("dst_ip", "dest_ip", "dstip")
    made = F.concat(F.lit("Firewall "), F.coalesce(_field("log_subtype", "log_type"), F.lit("event")), F.lit(": "), F.coalesce(_field("src_ip"), F.lit("?")), F.lit(" -> "), F.coalesce(_field("dst_ip"), F.lit("?")))
    out = _record(
        d.where("size(f) > 0"), "sophos", "sophos_firewall", "syslog", "sophos_syslog", source_name=F.coalesce(_field("device_name", "device"), F.lit("sophos_firewall")),
        timestamp=F.coalesce(F.col("_ts"), _field("date", "timestamp")), category=F.coalesce(*subtype, F.lit("firewall")), subcategory=F.element_at("f", "log_subtype"),
        severity=_field("severity", "priority", "log_priority"), message=F.coalesce(_field("message", "log_message"), made), device_ip=F.element_at("f", "device_ip"),
        hostname=_field("device_name", "device"), raw_ref=_field("log_id", "fw_rule_id"),
        correlation_keys=_drop_nulls(src_ip=src, dst_ip=dst, protocol=_field("protocol", "proto")), fields=F.col("f"))
    return out, bad


def parse_traps(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trap lines: (records, whole lines that are no trap); comments and blanks are neither."""
    d = lines.withColumn("_text", strip(F.col("line"))).where("_text <> '' and not startswith(_text, '#')")
    ok = F.col("_text").rlike(TRAP_LINE)
    bad = d.where(~ok).select(*[c for c in ("ord",) if c in lines.columns], F.lit("no trap").alias("error"), F.col("_text").alias("line"))
    part = lambda i: F.regexp_extract("_text", TRAP_LINE, i)
    d = with_kv(once(d.where(ok), _ts=part(1), _ip=part(2), _trap=part(3), _rest=part(4)), F.col("_rest"))
    name = F.lower("_trap")
    cat, sub, sev = (lookup(name, {k: v[i] for k, v in TRAPS.items()}) for i in range(3))
    iface = _field("ifname", "interface", "ifindex")
    sysname = F.element_at("f", "sysname")
    out = _record(
        d, "hirschmann", "hios_switch", "snmp_trap", "hirschmann_traps", source_name=F.coalesce(_field("sysname"), F.col("_ip")), timestamp=F.col("_ts"), device_ip=F.col("_ip"),
        hostname=sysname, device_id=sysname, category=F.coalesce(cat, F.lit("system")), subcategory=F.coalesce(sub, name), severity=F.coalesce(_field("severity", "status"), sev, F.lit("medium")),
        message=F.concat(F.lit("Trap "), F.col("_trap"), F.lit(" from "), F.col("_ip"), F.coalesce(F.concat(F.lit(" on "), iface), F.lit(""))),
        raw_ref=F.concat_ws(":", "_ip", "_trap", "_ts"), correlation_keys=_drop_nulls(interface=iface, device_id=sysname), fields=F.map_concat(F.create_map(F.lit("trap"), F.col("_trap")), F.map_filter("f", lambda k, v: k != "trap")))
    return out, bad


ALERT = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "alert_id", "category", "group", "type", "severity", "description", "name", "message", "src_ip", "dst_ip", "destination_ip", "protocol", "proto",
    "created_at", "timestamp", "location", "hostname", "endpoint_id", "device_id")] + [T.StructField("source_info", T.StructType([T.StructField("ip", T.StringType())]))])


def parse_alert_json(df: DataFrame, column: str = "json", source_type: str = "api") -> DataFrame:
    """API alert JSON to records."""
    d = once(df, a=F.from_json(F.col(column), ALERT))
    a = lambda *ns: F.coalesce(*[F.nullif(F.col(f"a.{n}"), F.lit("")) for n in ns])
    by_type = pick([(F.coalesce("a.type", F.lit("")).startswith(p), c) for p, c in ALERT_CATEGORY], "security")
    src = a("src_ip", "source_info.ip")
    return _record(
        d, "sophos", "sophos_central", source_type, "sophos_api", source_name=F.lit("sophos_central"), timestamp=a("created_at", "timestamp"),
        category=F.coalesce(F.lower(a("category", "group")), by_type), subcategory=a("type"), severity=F.col("a.severity"),
        message=F.coalesce(a("description", "name", "message", "type"), F.lit("sophos event")), device_ip=src, hostname=a("location", "hostname"), device_id=a("endpoint_id", "device_id"),
        raw_ref=a("id", "alert_id"), correlation_keys=_drop_nulls(src_ip=src, dst_ip=a("dst_ip", "destination_ip"), protocol=a("protocol", "proto")),
        fields=_drop_nulls(sophos_type=F.col("a.type")))


def _unreachable() -> Column:
    return F.lower(F.coalesce(F.col("reachable").cast("string"), F.lit("true"))).isin("false", "0", "no")


def metric_events(readings: DataFrame, thresholds: Mapping[str, float] = {}) -> DataFrame:
    """Zero or more threshold events per reading."""
    t = {**THRESHOLDS, **thresholds}
    have = lambda c: F.col(c) if c in readings.columns else F.lit(None).cast("string")
    dev, iface, ts = have("device_id"), F.nullif(have("interface"), F.lit("")), have("timestamp")
    err, util, temp = num(have("in_errors")), num(F.coalesce(have("utilization").cast("string"), have("bandwidth_utilization").cast("string"))), num(have("temperature_c"))
    ev = lambda cat, sub, sev, key: F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("subcategory"), (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity"), F.concat_ws(":", dev, key, ts).alias("raw_ref"))
    psu = [F.when(have(p).isNotNull() & ~F.lower(have(p).cast("string")).isin("ok", "up", "present", "1", "true"), ev("power", "power_supply", "high", F.lit(p))) for p in ("power_supply_1", "power_supply_2")]
    events = F.array_compact(F.array(
        F.when(_unreachable(), ev("availability", "device_unreachable", "high", F.lit("unreachable"))),
        F.when(iface.isNotNull() & F.lower(F.coalesce(have("if_oper_status").cast("string"), F.lit(""))).isin("down", "2", "lowerlayerdown"), ev("interface", "port_down", "medium", F.concat(iface, F.lit(":port_down")))),
        F.when(iface.isNotNull() & (err > t["in_errors_high"]), ev("interface", "high_error_rate", "high", F.concat(iface, F.lit(":in_errors")))),
        F.when(iface.isNotNull() & (util > t["utilization_high"]), ev("interface", "high_utilization", "medium", F.concat(iface, F.lit(":utilization")))),
        F.when(temp >= t["temperature_high_c"], ev("environment", "temperature", F.when(temp >= t["temperature_critical_c"], "high").otherwise("medium"), F.lit("temperature"))), *psu))
    return readings.select(dev.alias("device_id"), iface.alias("interface"), ts.alias("timestamp"), F.explode(events).alias("e")).select("device_id", "interface", "timestamp", "e.*")


def heartbeats(readings: DataFrame) -> DataFrame:
    """One ``poll_ok`` record per reachable reading."""
    return readings.where(~_unreachable()).select(
        "device_id", "timestamp", F.lit("availability").alias("category"), F.lit("poll_ok").alias("subcategory"), F.lit("info").alias("severity"),
        F.concat(F.lit("SNMP poll OK for "), F.coalesce("device_id", F.lit("None"))).alias("message"))


def normalize_severity(c: Column) -> Column:
    token = F.lower(strip(c.cast("string")))
    return F.when(token.isNull() | (token == ""), "unknown").otherwise(F.coalesce(lookup(token, SEVERITY_WORDS), F.when(token.rlike("^[0-9]+$"), F.lit("unknown")).otherwise(token)))


def event_severity_rank(c: Column) -> Column:
    return severity_rank(c, EVENT_SEVERITY_RANK)


def route(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """Target engine of a source; unknown sources and invalid targets give ``unknown``."""
    target = lookup(c, {**ROUTES, **(table or {})})
    return F.when(target.isin(*ENGINE_TARGETS), target).otherwise("unknown")


REQUIRED = ["source_vendor", "source_product", "source_type", "source_key", "category", "message"]


def event_key(*parts: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("evt_"), F.substring(F.sha2(joined, 256), 1, 16))


def normalize_events(records: DataFrame, observed_at: Column | None = None, routes: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): rejects lack a required field."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    d = records.withColumn("missing", missing)
    seen = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'") if observed_at is None else observed_at
    ok = d.where("size(missing) = 0").drop("missing").withColumn("observed_at", seen)
    ok = ok.withColumn("timestamp", F.coalesce(F.nullif("timestamp", F.lit("")), "observed_at"))
    ok = ok.withColumn("raw_ref", F.coalesce(F.nullif("raw_ref", F.lit("")), event_key(F.col("source_key"), F.col("timestamp"), F.col("message"))))
    events = ok.withColumns({
        "event_id": event_key(F.col("source_key"), F.col("raw_ref"), F.col("timestamp"), F.col("message")), "source_name": F.coalesce(F.nullif("source_name", F.lit("")), "source_key"),
        **{c: opt(c) for c in ("device_id", "device_ip", "hostname", "subcategory")}, "severity": normalize_severity(F.col("severity")), "engine_target": route(F.col("source_key"), routes)})
    return events, d.where("size(missing) > 0")


def redact_text(c: Column, literals: Sequence[str] = ()) -> Column:
    out = c
    for v in literals:
        if v:
            out = F.replace(out, F.lit(v), F.lit(MASK))
    for pattern, keeps_name in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, f"$1 {MASK}" if keeps_name else MASK)
    return out


def _secret_name(name: str) -> bool:
    return any(w in name.lower() for w in SECRET_WORDS)


def _redacted(c: Column, t: T.DataType, name: str, literals: Sequence[str]) -> Column:
    """Masked value, walking structs, maps and arrays of the schema."""
    if isinstance(t, T.StringType):
        return F.when(c.isNotNull(), F.lit(MASK)) if _secret_name(name) else redact_text(c, literals)
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_redacted(c[f.name], f.dataType, f.name, literals).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _redacted(x, t.elementType, name, literals))
    if isinstance(t, T.MapType) and isinstance(t.valueType, T.StringType):
        secret = lambda k: F.lower(k).rlike("|".join(SECRET_WORDS))
        return F.transform_values(c, lambda k, v: F.when(secret(k), F.lit(MASK)).otherwise(redact_text(v, literals)))
    return c


def redact(df: DataFrame, literals: Sequence[str] = ()) -> DataFrame:
    """Mask secret-named values, secret patterns and literal values in every column."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType, f.name, literals).alias(f.name) for f in df.schema.fields])


def _leaves(c: Column, kind: T.DataType) -> Column:
    """All values below ``c`` as one text."""
    join = lambda parts: F.array_join(parts, "\x00")
    if isinstance(kind, T.StructType):
        return F.concat_ws("\x00", *[_leaves(c[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return join(F.transform(c, lambda v: _leaves(v, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.concat_ws("\x00", join(F.transform(F.map_keys(c), lambda v: _leaves(v, kind.keyType))), join(F.transform(F.map_values(c), lambda v: _leaves(v, kind.valueType))))
    return c.cast("string")


def leak_audit(df: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Per needle, whether it survives in any text or number of any column, nested ones included."""
    # values as they are, apart by a character that JSON would escape: no needle is missed for its quotes or backslashes
    text = F.concat_ws("\x00", *[_leaves(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    row = df.agg(*[F.coalesce(F.bool_or(F.contains(text, F.lit(n))), F.lit(False)).alias(f"n{i}") for i, n in enumerate(needles)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("needle"), F.col(f"n{i}").alias("leaked")) for i, n in enumerate(needles)])).alias("p")).select("p.*")


def source_health(status: DataFrame) -> DataFrame:
    """ok/failed/disabled counts and overall health of one ingestion status table."""
    s = F.col("status")
    return status.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "disabled").alias("disabled"),
        F.count_if((s == "failed") | F.col("error_category").isNotNull()).alias("failures"), (F.count_if(s == "failed") == 0).alias("healthy"))


def checkpoint_age(checkpoints: DataFrame, now: Column) -> DataFrame:
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    return checkpoints.select("source", seconds.alias("age_seconds"), "event_count")
