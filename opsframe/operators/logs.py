"""Device-log ingestion: clean, classify, collapse, parse and enrich, all as Column expressions.

Input is a table of ``source, ord, line``; ``ord`` is an explicit ingest ordinal
because every first/last choice below depends on input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scalars import LOG_SEVERITY_RANK, grab, lookup, once, pick, strip

# Line grammar.
ANSI = r"\x1b\[[0-9;]*m"
ANSI_CODES = r"\x1b\[([0-9;]+)m"
PAGER = r"-{2,}MORE-{2,}\s*"
CODE_MARKER = r"%[A-Z0-9]+-(?:[A-Z0-9_]+-)?\d:"
NOISE = [
    ("putty_header", r"(?i)^=~=.*PuTTY log"),
    ("logging_header", r"(?i)Logging source configurations"),
    ("logging_context", r"(?i)The Context of logging file"),
    ("logging_level", r"(?i)\bis enabled,\s*level:"),
    ("command_echo", r"^\S*#"),
    ("bare_command", r"(?i)^(sh|show|dis|display)\s"),
]
TIME_LINE = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{4}\s+\d{2}:\d{2}:\d{2})\s+(.*)$"
HOST_LINE = r"^(\S+)\s+(?:([^%\s]\S*)\s+)?(%.*)$"
CODE_LINE = r"^%([A-Z0-9]+)-(?:([A-Z0-9_]+)-)?(\d):(.*)$"

# Colour codes, severity digits, zone abbreviations.
COLOR_HINTS = {"33": "yellow", "36": "cyan", "37": "white"}
SEVERITY_LABELS = {0: "emergency", 1: "alert", 2: "critical", 3: "error", 4: "warning", 5: "notice", 6: "info", 7: "debug"}
ZONE_NAMES = {"IST": "Asia/Kolkata"}

# Message patterns.
IFACE = r"(?i)interface\s+([A-Za-z]+\d[\d/]*)"
STATE = r"(?i)changed state to (up|down)"
MAC = r"([0-9a-fA-F]{4}\.[0-9a-fA-F]{4}\.[0-9a-fA-F]{4})"
VLAN = r"(?i)vlan\s+(\d+)"
MOVED_TO = r"(?i)to port(?:\s+interface)?\s+([A-Za-z]+\d[\d/]*)"
TIMES = r"(?i)for\s+(\d+)\s+times"
IP = r"(\d{1,3}(?:\.\d{1,3}){3})"
COMMUNITY = r"(?i)Community\s+(\S+)\s+authentication failed"
USER = r"(?i)User\s+(\S+)\s+authentication failed"
RING = r"(?i)ring\s+(\d+)"
RING_STATE = r"(?i)changed to (\w+)(?:\s+from\s+\w+)?"
RING_PORT_STATE = r"(?i)changed to (\w+)\s+on ring"
RING_PORT = r"(?i)(?:ERPS )?port\s+([A-Za-z]+\d[\d/]*)"
POWER_UNIT = r"(?i)Power\s+(\d+)"
FAN_UNIT = r"(?i)Fan\s+(\d+)"
PROCESS = r"(?i)Process\s+(\S+)\s+(?:is|has)"
LOGIN_PROTOCOL = r"(?i)(Telnet|SSH)\("
HEALTHY = r"(?i)normal|inserted|online"

# Exact codes and their event kind.
CODE_KINDS = {
    "PORTMGR-LINEPROTO_UP": "link",
    "PORTMGR-LINEPROTO_DOWN": "link",
    "LINK-LINEPROTO_UP": "link",
    "LINK-LINEPROTO_DOWN": "link",
    "LINK-INTERFACE_UP": "link",
    "LINK-INTERFACE_DOWN": "link",
    "FDB-MAC_ADDR_FLAPPING_VLAN": "mac_flap",
    "ARP-MAC_CHANGE_TOO_FAST": "arp",
    "SNMP-COMMUNITY_AUTHOR_FAILED": "snmp_community",
    "SNMP-USER_AUTH_FAILED": "snmp_user",
    "POE-POWER_ABNORMAL": "poe_fault",
    "POE-POWER_ON": "poe_churn",
    "POE-POWER_OFF": "poe_churn",
    "ERPS-RING_STAT_CHG": "ring",
    "ERPS-RING_PORT_BLK": "ring_port",
    "ERPS-RING_PORT_FWD": "ring_port",
    "HA-UNIT_STATE_NORMAL": "unit",
    "CLKM-DEV_CLOCK_CHANGE": "clock",
}
# Facility, mnemonic part, event kind; first match wins.
FACILITY_KINDS = [
    ("SYSMGMT", "PWR", "power"),
    ("SYSMGMT", "POWER", "power"),
    ("SYSMGMT", "FAN", "fan"),
    ("HA", "UNIT_STATE", "unit"),
    ("CLKM", "CLOCK", "clock"),
    ("DCM", "PROCESS", "process"),
    ("TELNET", "LOGIN", "telnet"),
    ("TELNET", "LOGOUT", "telnet"),
    ("WEB", "LOGIN", "web"),
]
# Tags per event kind (link, power, fan and short-circuit tags are added below).
KIND_TAGS = {
    "mac_flap": ["mac_flap", "loop_risk"],
    "arp": ["arp_instability", "duplicate_ip_possible", "arp_spoof_possible"],
    "snmp_community": ["snmp_auth_failed", "recon_possible", "brute_force_possible"],
    "snmp_user": ["snmp_user_auth_failed", "management_auth_failed"],
    "poe_fault": ["poe_fault"],
    "poe_churn": ["poe_power_churn"],
    "ring": ["erps_churn", "ring_protection", "topology_instability"],
    "ring_port": ["erps_churn", "ring_protection", "topology_instability"],
    "power": ["device_health"],
    "fan": ["device_health"],
    "unit": ["device_health", "reboot"],
    "clock": ["device_health", "clock_change"],
    "process": ["device_health", "reboot"],
    "telnet": ["management_access", "insecure_telnet"],
    "web": ["management_access"],
}
# Downstream hint flags and the kinds that set them.
HINT_KINDS = {
    "engine_a_intrusion": ["arp", "snmp_community", "snmp_user"],
    "engine_b_health": ["link", "mac_flap", "poe_churn", "ring", "ring_port", "power", "fan", "unit", "clock", "process"],
    "engine_c_config": [],
    "engine_c_topology": ["mac_flap", "ring", "ring_port"],
    "engine_c_poe": ["poe_fault", "poe_churn"],
    "engine_c_security": ["arp", "telnet", "web"],
    "correlation_candidate": ["mac_flap", "arp", "snmp_community", "snmp_user", "poe_fault", "ring", "ring_port"],
}
# The entity a fully parsed event of each kind must carry.
REQUIRED_ENTITIES = {
    "link": ["interface_id"],
    "mac_flap": ["mac_address", "vlan_id"],
    "arp": ["ip_address"],
    "snmp_community": ["community"],
    "snmp_user": ["username"],
    "poe_fault": ["interface_id"],
    "poe_churn": ["interface_id"],
    "ring": ["erps_ring"],
    "ring_port": ["erps_ring"],
    "power": ["power_unit"],
    "fan": ["fan_id"],
    "process": ["process_name"],
}
ENTITY_FIELDS = [
    "interface_id", "vlan_id", "mac_address", "ip_address", "port", "flap_count", "erps_ring",
    "erps_state", "username", "community", "process_name", "fan_id", "power_unit", "login_protocol",
]


# ------------------------------------------------------------ line cleaning
def clean_lines(df: DataFrame) -> DataFrame:
    """Add ``cleaned_line`` and the first known colour code as ``color_hint``."""
    codes = F.flatten(F.transform(F.regexp_extract_all("line", F.lit(ANSI_CODES), F.lit(1)), lambda c: F.split(c, ";")))
    known = F.filter(codes, lambda c: c.isin(*COLOR_HINTS))
    bare = F.regexp_replace(F.regexp_replace("line", ANSI, ""), PAGER, "")
    hint = F.when(F.col("line").contains("\x1b"), lookup(F.get(known, F.lit(0)), COLOR_HINTS))
    return once(df, cleaned_line=strip(bare)).withColumn("color_hint", hint)


def classify_noise(df: DataFrame) -> DataFrame:
    """Add ``drop_reason``; null marks a line that carries a message code."""
    line = F.col("cleaned_line")
    reason = F.when(line == "", "empty").when(line.rlike(CODE_MARKER), F.lit(None))
    for name, pattern in NOISE:
        reason = reason.when(line.rlike(pattern), name)
    return df.withColumn("drop_reason", reason.otherwise("no_syslog_marker"))


def kept_lines(classified: DataFrame) -> DataFrame:
    return classified.where("drop_reason is null").drop("drop_reason")


def dropped_lines(classified: DataFrame) -> DataFrame:
    return classified.where("drop_reason is not null").select("source", "ord", "drop_reason", "line", "cleaned_line")


def collapse_repeats(kept: DataFrame) -> DataFrame:
    """One row per (source, cleaned line) with its repeat count; map-side combined."""
    return kept.groupBy("source", "cleaned_line").agg(
        F.min("ord").alias("ord"),
        F.min_by("line", "ord").alias("line"),
        F.min_by("color_hint", F.when(F.col("color_hint").isNotNull(), F.col("ord"))).alias("color_hint"),
        F.count(F.lit(1)).alias("duplicate_count"),
    )


def collapsed_groups(collapsed: DataFrame) -> DataFrame:
    """Audit table of the lines that were folded."""
    return collapsed.where("duplicate_count > 1").select("source", "cleaned_line", "duplicate_count")


# ------------------------------------------------------------------ parsing
def log_time(text: Column) -> Column:
    """Wall-clock time of a log stamp (session zone stands for the device's local zone)."""
    return F.try_to_timestamp(F.regexp_replace(strip(text), r"\s+", " "), F.lit("MMM d yyyy HH:mm:ss"))


def to_utc(ts: Column, zone: str) -> Column:
    """UTC time of a wall-clock time in any named zone, daylight saving included."""
    return F.to_utc_timestamp(ts, ZONE_NAMES.get(zone, zone))


def iso_text(ts: Column, zone: str = "UTC") -> Column:
    """ISO text of a wall-clock time with its zone's offset at that time."""
    minutes = ((F.unix_seconds(ts) - F.unix_seconds(to_utc(ts, zone))) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(minutes / 60).cast("int"), F.abs(minutes) % 60)
    return F.when(ts.isNotNull(), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), offset))


def severity_label(code: Column) -> Column:
    return lookup(code, SEVERITY_LABELS, "unknown")


def log_severity_rank(label: Column) -> Column:
    return lookup(label, LOG_SEVERITY_RANK, len(LOG_SEVERITY_RANK))


def parse_syslog(df: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Grammar parse of ``cleaned_line``; lines that fail keep a tag with the reason."""
    line = F.col("cleaned_line")
    rest, code = F.col("_rest"), F.col("_code")
    staged = (
        df.withColumn("_stamp", grab(line, TIME_LINE, 1))
        .withColumn("_rest", grab(line, TIME_LINE, 2))
        .withColumn("_code", grab("_rest", HOST_LINE, 3))
        .withColumn("_ok", F.coalesce(code.rlike(CODE_LINE), F.lit(False)))
        .withColumn(
            "fail_reason",
            pick([
                (F.col("_stamp").isNull() & ~line.rlike(TIME_LINE), "no_timestamp"),
                (code.isNull(), "no_host_code"),
                (~F.col("_ok"), "no_code"),
            ]),
        )
    )
    ok = F.col("_ok")
    out = once(
        staged,
        ts=F.when(ok, log_time(F.col("_stamp"))),
        hostname=F.when(ok, grab(rest, HOST_LINE, 1)),
        module=F.when(ok, grab(rest, HOST_LINE, 2)),
        facility=F.when(ok, grab(code, CODE_LINE, 1)),
        mnemonic=F.when(ok, grab(code, CODE_LINE, 2)),
        severity_code=F.when(ok, grab(code, CODE_LINE, 3).try_cast("int")),
        message=F.when(ok, strip(F.regexp_extract(code, CODE_LINE, 4))).otherwise(line),
    ).drop("_stamp", "_rest", "_code", "_ok")
    ts = F.col("ts")
    return (
        out.withColumn("ts_utc", to_utc(ts, zone))
        .withColumn("timestamp", iso_text(ts, zone))
        .withColumn("timestamp_utc", iso_text(F.col("ts_utc")))
        .withColumn("timezone", F.lit(zone))
        .withColumn("clock_unreliable", F.coalesce(F.year(ts) < 2000, F.lit(False)))
        .withColumn("severity_label", severity_label(F.col("severity_code")))
        .withColumn("code", F.when(F.col("mnemonic").isNotNull(), F.concat_ws("-", "facility", "mnemonic")).otherwise(F.col("facility")))
    )


def dispatch_code(df: DataFrame) -> DataFrame:
    """Add ``kind``, the event kind of a code; null for codes without one."""
    exact = lookup("code", CODE_KINDS)
    mnemonic = F.coalesce(F.col("mnemonic"), F.lit(""))
    partial = pick([((F.col("facility") == fac) & mnemonic.contains(part), kind) for fac, part, kind in FACILITY_KINDS])
    return once(df, kind=F.coalesce(exact, partial))


# --------------------------------------------------------------- extractors
def _entity_columns() -> dict[str, dict[str, Column]]:
    """Per entity field, the expression for each event kind that fills it."""
    msg = F.col("message")
    iface = grab(msg, IFACE)
    return {
        "interface_id": {
            "link": iface, "poe_fault": iface, "poe_churn": iface,
            "mac_flap": grab(msg, MOVED_TO),
            "ring_port": F.coalesce(grab(msg, RING_PORT), iface),
        },
        "vlan_id": {"mac_flap": grab(msg, VLAN)},
        "mac_address": {"mac_flap": grab(msg, MAC)},
        "ip_address": {k: grab(msg, IP) for k in ("arp", "telnet", "web")},
        "port": {},
        "flap_count": {"mac_flap": grab(msg, TIMES).try_cast("long")},
        "erps_ring": {k: grab(msg, RING) for k in ("ring", "ring_port")},
        "erps_state": {"ring": F.lower(grab(msg, RING_STATE)), "ring_port": F.lower(grab(msg, RING_PORT_STATE))},
        "username": {"snmp_user": grab(msg, USER)},
        "community": {"snmp_community": grab(msg, COMMUNITY)},
        "process_name": {"process": grab(msg, PROCESS)},
        "fan_id": {"fan": grab(msg, FAN_UNIT)},
        "power_unit": {"power": grab(msg, POWER_UNIT)},
        "login_protocol": {"telnet": F.coalesce(F.lower(grab(msg, LOGIN_PROTOCOL)), F.lit("telnet")), "web": F.lit("http")},
    }


def extract_entities(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Add the ``entities`` struct; ``kinds`` limits the job to some event kinds."""
    kind = F.col("kind")
    fields = []
    for name, per_kind in _entity_columns().items():
        chosen = [(kind == k, e) for k, e in per_kind.items() if kinds is None or k in kinds]
        kind_type = "long" if name == "flap_count" else "string"
        fields.append((pick(chosen) if chosen else F.lit(None)).cast(kind_type).alias(name))
    out = df if kinds is None else df.where(kind.isin(*kinds))
    return once(out, entities=F.struct(*fields))


def event_tags(df: DataFrame) -> DataFrame:
    """Add the ordered ``tags`` array."""
    kind, msg = F.col("kind"), F.col("message")
    words = lambda *ws: F.array(*[F.lit(w) for w in ws])
    state = grab(msg, STATE)
    faulty = ~msg.rlike(HEALTHY)
    base = pick([(kind == k, words(*tags)) for k, tags in KIND_TAGS.items()])
    tags = (
        F.when(kind.isNull() & F.col("fail_reason").isNotNull(), F.array(F.concat(F.lit("parse_failed:"), F.col("fail_reason"))))
        .when(kind == "link", F.array_compact(F.array(F.lit("port_flap"), F.lit("link_state"), F.concat(F.lit("link_"), state))))
        .when((kind == "poe_fault") & F.lower(msg).contains("short"), F.concat(base, words("short_detected")))
        .when(kind.isin("power", "fan") & faulty, F.concat(base, F.array(F.concat(kind, F.lit("_fault")))))
        .otherwise(F.coalesce(base, F.array().cast("array<string>")))
    )
    return once(df, tags=tags)


def engine_hints(df: DataFrame) -> DataFrame:
    """Add the ``hints`` struct of downstream flags."""
    kind = F.col("kind")
    fields = []
    for name, kinds in HINT_KINDS.items():
        on = F.coalesce(kind.isin(*kinds), F.lit(False)) if kinds else F.lit(False)
        if name == "correlation_candidate":
            on = on | F.coalesce(kind.isin("power", "fan") & ~F.col("message").rlike(HEALTHY), F.lit(False))
        fields.append(on.alias(name))
    return df.withColumn("hints", F.struct(*fields))


def enrich(df: DataFrame) -> DataFrame:
    """Entities, tags, hints, parse status and a deterministic id."""
    kind = F.col("kind")
    missing = pick([
        (kind == k, ~F.greatest(*[F.col(f"entities.{f}").isNull() for f in (fields * 2)]))
        for k, fields in REQUIRED_ENTITIES.items()
    ], True)
    out = engine_hints(event_tags(extract_entities(df)))
    return out.withColumn(
        "parse_status",
        F.when(F.col("fail_reason").isNotNull(), "failed")
        .when(kind.isNull(), "generic")
        .when(missing, "parsed")
        .otherwise("partially_parsed"),
    ).withColumn("event_id", F.concat(F.lit("SYS-"), F.substring(F.sha1("cleaned_line"), 1, 12)))


def parse_events(lines: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Raw lines to enriched events: one narrow stage on each side of the repeat shuffle."""
    kept = kept_lines(classify_noise(clean_lines(lines)))
    return enrich(dispatch_code(parse_syslog(collapse_repeats(kept), zone)))


# ------------------------------------------------------------------ summary
def parse_summary(events: DataFrame, top_facilities: int = 15, top_codes: int = 20) -> DataFrame:
    """Long-form quality summary: (metric, key, value) rows.

    Status, severity, facility, code and host counts come from one pass of grouping sets.
    """
    e = events.select(
        "parse_status", "severity_label", "facility", "code", "hostname", "clock_unreliable",
        F.greatest(F.lit(1), F.col("duplicate_count")).alias("w"), "timestamp",
    )
    dims = ["parse_status", "severity_label", "facility", "code", "hostname"]
    # one row per combination first, so only small rows are expanded over the five sets
    fine = e.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    longer = fine.select("n", F.explode(F.array(*[F.struct(F.lit(d).alias("metric"), F.col(d).alias("key")) for d in dims])).alias("s"))
    counts = longer.where("s.key is not null").groupBy("s.metric", "s.key").agg(F.sum("n").alias("value"))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "key"))
    limits = lookup("metric", {"facility": top_facilities, "code": top_codes})
    top = counts.withColumn("r", rank).where(F.col("r") <= F.coalesce(limits, F.col("r"))).select("metric", "key", F.col("value").cast("string").alias("value"))
    good = F.when(~F.col("clock_unreliable"), F.col("timestamp"))
    total = e.agg(
        F.count(F.lit(1)).cast("string").alias("parsed_events"),
        F.sum("w").cast("string").alias("weighted_events"),
        F.sum(F.col("w") - 1).cast("string").alias("duplicate_lines_collapsed"),
        F.count_if("clock_unreliable").cast("string").alias("clock_unreliable_events"),
        F.min(good).alias("first"), F.max(good).alias("last"),
    )
    names = total.columns
    flat = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("metric"), F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])).alias("s")).select("s.*")
    return top.unionByName(flat)
