"""Queries for log ingestion, window features and log findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import LOG_SQL, Case, log_lines
from opsframe.operators import findings as fnd
from opsframe.operators import logs as lg
from opsframe.operators import windows as win

# ------------------------------------------------------------ SQL for DuckDB
CLEAN_CTE = rf"""
with raw as ({LOG_SQL}),
cl as (select source, ord, line,
  regexp_replace(regexp_replace(regexp_replace(line, '\x1b\[[0-9;]*m', '', 'g'), '-{{2,}}MORE-{{2,}}\s*', '', 'g'), '^\s+|\s+$', '', 'g') as cleaned_line,
  list_filter(flatten(list_transform(regexp_extract_all(line, '\x1b\[([0-9;]+)m', 1), lambda x: string_split(x, ';'))), lambda c: c in ('33','36','37'))[1] as cc
  from raw),
cls as (select source, ord, line, cleaned_line,
  case cc when '33' then 'yellow' when '36' then 'cyan' when '37' then 'white' end as color_hint,
  case when cleaned_line = '' then 'empty'
    when regexp_matches(cleaned_line, '%[A-Z0-9]+-(?:[A-Z0-9_]+-)?\d:') then null
    when regexp_matches(cleaned_line, '(?i)^=~=.*PuTTY log') then 'putty_header'
    when regexp_matches(cleaned_line, '(?i)Logging source configurations') then 'logging_header'
    when regexp_matches(cleaned_line, '(?i)The Context of logging file') then 'logging_context'
    when regexp_matches(cleaned_line, '(?i)\bis enabled,\s*level:') then 'logging_level'
    when regexp_matches(cleaned_line, '^\S*#') then 'command_echo'
    when regexp_matches(cleaned_line, '(?i)^(sh|show|dis|display)\s') then 'bare_command'
    else 'no_syslog_marker' end as drop_reason
  from cl),
kept as (select source, cleaned_line, min(ord) as ord, arg_min(line, ord) as line,
  arg_min(color_hint, ord) filter (color_hint is not null) as color_hint, count(*) as duplicate_count
  from cls where drop_reason is null group by source, cleaned_line)
"""
_TS = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{4}\s+\d{2}:\d{2}:\d{2})\s+(.*)$"
_HOST = r"^(\S+)\s+(?:([^%\s]\S*)\s+)?(%.*)$"
_CODE = r"^%([A-Z0-9]+)-(?:([A-Z0-9_]+)-)?(\d):(.*)$"
PARSE_CTE = CLEAN_CTE + rf""",
p1 as (select *, regexp_extract(cleaned_line, '{_TS}', 1) as stamp, regexp_extract(cleaned_line, '{_TS}', 2) as rest from kept),
p2 as (select *, regexp_extract(rest, '{_HOST}', 3) as ctext from p1),
p3 as (select *, regexp_matches(ctext, '{_CODE}') as ok,
  case when not regexp_matches(cleaned_line, '{_TS}') then 'no_timestamp' when ctext = '' then 'no_host_code'
    when not regexp_matches(ctext, '{_CODE}') then 'no_code' end as fail_reason from p2),
p4 as (select source, ord, line, cleaned_line, color_hint, duplicate_count, fail_reason,
  case when ok then try_strptime(regexp_replace(stamp, '\s+', ' ', 'g'), '%b %d %Y %H:%M:%S') end as ts,
  case when ok then regexp_extract(rest, '{_HOST}', 1) end as hostname,
  case when ok then nullif(regexp_extract(rest, '{_HOST}', 2), '') end as module,
  case when ok then regexp_extract(ctext, '{_CODE}', 1) end as facility,
  case when ok then nullif(regexp_extract(ctext, '{_CODE}', 2), '') end as mnemonic,
  case when ok then cast(regexp_extract(ctext, '{_CODE}', 3) as int) end as severity_code,
  case when ok then trim(regexp_extract(ctext, '{_CODE}', 4)) else cleaned_line end as message
  from p3),
p5 as (select *, coalesce(year(ts) < 2000, false) as clock_unreliable,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' as "timestamp",
  strftime(ts - interval 330 minute, '%Y-%m-%dT%H:%M:%S') || '+00:00' as timestamp_utc,
  case severity_code when 0 then 'emergency' when 1 then 'alert' when 2 then 'critical' when 3 then 'error' when 4 then 'warning'
    when 5 then 'notice' when 6 then 'info' when 7 then 'debug' else 'unknown' end as severity_label,
  case when mnemonic is null then facility else facility || '-' || mnemonic end as code from p4),
p6 as (select *, coalesce(case
   when code in ('PORTMGR-LINEPROTO_UP','PORTMGR-LINEPROTO_DOWN','LINK-LINEPROTO_UP','LINK-LINEPROTO_DOWN','LINK-INTERFACE_UP','LINK-INTERFACE_DOWN') then 'link'
   when code = 'FDB-MAC_ADDR_FLAPPING_VLAN' then 'mac_flap' when code = 'ARP-MAC_CHANGE_TOO_FAST' then 'arp'
   when code = 'SNMP-COMMUNITY_AUTHOR_FAILED' then 'snmp_community' when code = 'SNMP-USER_AUTH_FAILED' then 'snmp_user'
   when code = 'POE-POWER_ABNORMAL' then 'poe_fault' when code in ('POE-POWER_ON','POE-POWER_OFF') then 'poe_churn'
   when code = 'ERPS-RING_STAT_CHG' then 'ring' when code in ('ERPS-RING_PORT_BLK','ERPS-RING_PORT_FWD') then 'ring_port'
   when code = 'HA-UNIT_STATE_NORMAL' then 'unit' when code = 'CLKM-DEV_CLOCK_CHANGE' then 'clock' end,
  case when facility = 'SYSMGMT' and mnemonic like '%PWR%' then 'power' when facility = 'SYSMGMT' and mnemonic like '%POWER%' then 'power'
   when facility = 'SYSMGMT' and mnemonic like '%FAN%' then 'fan' when facility = 'HA' and mnemonic like '%UNIT_STATE%' then 'unit'
   when facility = 'CLKM' and mnemonic like '%CLOCK%' then 'clock' when facility = 'DCM' and mnemonic like '%PROCESS%' then 'process'
   when facility = 'TELNET' and (mnemonic like '%LOGIN%' or mnemonic like '%LOGOUT%') then 'telnet'
   when facility = 'WEB' and mnemonic like '%LOGIN%' then 'web' end) as kind from p5),
p7 as (select *,
  nullif(case when kind in ('link','poe_fault','poe_churn') then regexp_extract(message, '(?i)interface\s+([A-Za-z]+\d[\d/]*)', 1)
    when kind = 'mac_flap' then regexp_extract(message, '(?i)to port(?:\s+interface)?\s+([A-Za-z]+\d[\d/]*)', 1)
    when kind = 'ring_port' then coalesce(nullif(regexp_extract(message, '(?i)(?:ERPS )?port\s+([A-Za-z]+\d[\d/]*)', 1), ''), regexp_extract(message, '(?i)interface\s+([A-Za-z]+\d[\d/]*)', 1)) end, '') as interface_id,
  case when kind = 'mac_flap' then nullif(regexp_extract(message, '(?i)vlan\s+(\d+)', 1), '') end as vlan_id,
  case when kind = 'mac_flap' then nullif(regexp_extract(message, '([0-9a-fA-F]{{4}}\.[0-9a-fA-F]{{4}}\.[0-9a-fA-F]{{4}})', 1), '') end as mac_address,
  case when kind in ('arp','telnet','web') then nullif(regexp_extract(message, '(\d{{1,3}}(?:\.\d{{1,3}}){{3}})', 1), '') end as ip_address,
  case when kind = 'mac_flap' then try_cast(nullif(regexp_extract(message, '(?i)for\s+(\d+)\s+times', 1), '') as bigint) end as flap_count,
  case when kind in ('ring','ring_port') then nullif(regexp_extract(message, '(?i)ring\s+(\d+)', 1), '') end as erps_ring,
  case when kind = 'ring' then lower(nullif(regexp_extract(message, '(?i)changed to (\w+)(?:\s+from\s+\w+)?', 1), ''))
    when kind = 'ring_port' then lower(nullif(regexp_extract(message, '(?i)changed to (\w+)\s+on ring', 1), '')) end as erps_state,
  case when kind = 'snmp_user' then nullif(regexp_extract(message, '(?i)User\s+(\S+)\s+authentication failed', 1), '') end as username,
  case when kind = 'snmp_community' then nullif(regexp_extract(message, '(?i)Community\s+(\S+)\s+authentication failed', 1), '') end as community,
  case when kind = 'process' then nullif(regexp_extract(message, '(?i)Process\s+(\S+)\s+(?:is|has)', 1), '') end as process_name,
  case when kind = 'fan' then nullif(regexp_extract(message, '(?i)Fan\s+(\d+)', 1), '') end as fan_id,
  case when kind = 'power' then nullif(regexp_extract(message, '(?i)Power\s+(\d+)', 1), '') end as power_unit,
  case when kind = 'telnet' then coalesce(lower(nullif(regexp_extract(message, '(?i)(Telnet|SSH)\(', 1), '')), 'telnet') when kind = 'web' then 'http' end as login_protocol,
  not regexp_matches(message, '(?i)normal|inserted|online') as faulty
  from p6),
ev as (select *, 'SYS-' || substr(sha1(cleaned_line), 1, 12) as event_id, greatest(1, duplicate_count) as w,
  case when kind is null and fail_reason is not null then ['parse_failed:' || fail_reason]
    when kind = 'link' then list_filter(['port_flap', 'link_state', 'link_' || nullif(regexp_extract(message, '(?i)changed state to (up|down)', 1), '')], lambda x: x is not null)
    when kind = 'mac_flap' then ['mac_flap','loop_risk'] when kind = 'arp' then ['arp_instability','duplicate_ip_possible','arp_spoof_possible']
    when kind = 'snmp_community' then ['snmp_auth_failed','recon_possible','brute_force_possible']
    when kind = 'snmp_user' then ['snmp_user_auth_failed','management_auth_failed']
    when kind = 'poe_fault' then case when lower(message) like '%short%' then ['poe_fault','short_detected'] else ['poe_fault'] end
    when kind = 'poe_churn' then ['poe_power_churn'] when kind in ('ring','ring_port') then ['erps_churn','ring_protection','topology_instability']
    when kind in ('power','fan') then case when faulty then ['device_health', kind || '_fault'] else ['device_health'] end
    when kind in ('unit','process') then ['device_health','reboot'] when kind = 'clock' then ['device_health','clock_change']
    when kind = 'telnet' then ['management_access','insecure_telnet'] when kind = 'web' then ['management_access'] else [] end as tags,
  case when fail_reason is not null then 'failed' when kind is null then 'generic'
    when case kind when 'link' then interface_id is not null when 'poe_fault' then interface_id is not null when 'poe_churn' then interface_id is not null
      when 'mac_flap' then mac_address is not null and vlan_id is not null when 'arp' then ip_address is not null
      when 'snmp_community' then community is not null when 'snmp_user' then username is not null
      when 'ring' then erps_ring is not null when 'ring_port' then erps_ring is not null when 'power' then power_unit is not null
      when 'fan' then fan_id is not null when 'process' then process_name is not null else true end
    then 'parsed' else 'partially_parsed' end as parse_status
  from p7)
"""


def windows_cte(minutes: int = 5) -> str:
    return PARSE_CTE + f""",
el as (select *, coalesce(hostname, 'unknown') as host, date_trunc('day', ts) + to_minutes(cast(floor((hour(ts) * 60 + minute(ts)) / {minutes}) * {minutes} as int)) as ws,
   coalesce(mnemonic, '') as mn, list_contains(tags, 'link_state') or coalesce(mnemonic, '') like 'LINEPROTO%' or coalesce(mnemonic, '') like 'INTERFACE%' as is_link
   from ev where parse_status <> 'failed' and ts is not null and not clock_unreliable),
sc as (select 'host' as scope, '' as iface, * from el union all select 'interface' as scope, interface_id as iface, * from el where interface_id is not null),
wc as (select {minutes} as window_minutes, scope, host as hostname, iface as interface_id, ws as window_start, count(*) as total_events, sum(w) as weighted_event_count,
  sum(case when is_link and not (lower(mn) like '%down%' or list_contains(tags, 'link_down')) and (lower(mn) like '%up%' or list_contains(tags, 'link_up')) then w else 0 end) as lineproto_up_count,
  sum(case when is_link and (lower(mn) like '%down%' or list_contains(tags, 'link_down')) then w else 0 end) as lineproto_down_count,
  sum(case when list_contains(tags, 'mac_flap') then w else 0 end) as mac_flap_count,
  sum(case when list_contains(tags, 'mac_flap') then coalesce(flap_count, 0) else 0 end) as mac_move_total,
  sum(case when list_contains(tags, 'erps_churn') then w else 0 end) as erps_event_count,
  sum(case when list_contains(tags, 'poe_fault') then w else 0 end) as poe_fault_count,
  sum(case when list_contains(tags, 'poe_power_churn') then w else 0 end) as poe_power_churn_count,
  sum(case when list_has_any(tags, ['snmp_auth_failed', 'snmp_user_auth_failed']) then w else 0 end) as snmp_auth_fail_count,
  count(distinct case when list_has_any(tags, ['snmp_auth_failed', 'snmp_user_auth_failed']) then ip_address end) as unique_snmp_source_ips,
  sum(case when list_contains(tags, 'arp_instability') then w else 0 end) as arp_mac_change_count,
  sum(case when list_has_any(tags, ['reboot', 'clock_change']) then w else 0 end) as reboot_or_clock_event_count,
  sum(case when list_contains(tags, 'power_fault') then w else 0 end) as power_fault_count,
  sum(case when list_contains(tags, 'fan_fault') then w else 0 end) as fan_fault_count,
  {", ".join(f"sum(case when severity_label = '{s}' then w else 0 end) as severity_{s}" for s in win.SEVERITY_COLUMNS)}
  from sc group by all),
wf as (select *, lineproto_up_count + lineproto_down_count as port_flap_count,
  strftime(window_start, '%Y-%m-%dT%H:%M:%S') || '+05:30' as window_start_iso,
  strftime(window_start + interval {minutes} minute, '%Y-%m-%dT%H:%M:%S') || '+05:30' as window_end_iso,
  (lineproto_up_count + lineproto_down_count) * 60.0 / {minutes} as fph, snmp_auth_fail_count * 5.0 / {minutes} as s5 from wc),
wl as (select * exclude (fph, s5), case when fph >= 6 then 'high' when fph >= 3 then 'warning' else 'none' end as degradation_level, fph >= 3 as degradation_label,
  round(fph, 3) as port_flaps_per_hour,
  case when mac_move_total >= 100 then 'high' when mac_move_total >= 20 then 'warning' else 'none' end as loop_risk_level, mac_move_total >= 20 as loop_risk_label,
  case when s5 >= 20 then 'high' when s5 >= 5 then 'warning' else 'none' end as snmp_attack_level, s5 >= 5 as snmp_attack_weak_label, round(s5, 3) as snmp_auth_fail_per_5min,
  reboot_or_clock_event_count + power_fault_count + fan_fault_count >= 1 as device_instability_label, poe_fault_count > 0 as poe_fault_label,
  erps_event_count * 60.0 / {minutes} >= 3 as erps_churn_label from wf)
"""


MAPS_SQL = windows_cte(5) + """,
fc as (select scope, host as hostname, iface as interface_id, ws, facility as k, sum(w) as n from sc group by all),
mc as (select scope, host as hostname, iface as interface_id, ws, mnemonic as k, sum(w) as n from sc where mnemonic is not null group by all),
fj as (select scope, hostname, interface_id, ws, '{' || string_agg('"' || k || '": ' || cast(n as varchar), ', ' order by k) || '}' as facility_counts from fc group by all),
mj as (select scope, hostname, interface_id, ws, '{' || string_agg('"' || k || '": ' || cast(n as varchar), ', ' order by k) || '}' as mnemonic_counts from mc group by all)
"""
COUNTERS = [
    "total_events", "weighted_event_count", "lineproto_up_count", "lineproto_down_count", "port_flap_count", "mac_flap_count", "mac_move_total",
    "erps_event_count", "poe_fault_count", "poe_power_churn_count", "snmp_auth_fail_count", "unique_snmp_source_ips", "arp_mac_change_count",
    "reboot_or_clock_event_count", "power_fault_count", "fan_fault_count", *[f"severity_{s}" for s in win.SEVERITY_COLUMNS],
]
LABEL_COLUMNS = [
    "degradation_level", "degradation_label", "port_flaps_per_hour", "loop_risk_level", "loop_risk_label", "snmp_attack_level", "snmp_attack_weak_label",
    "snmp_auth_fail_per_5min", "device_instability_label", "poe_fault_label", "erps_churn_label",
]
WINDOW_KEYS = ["window_minutes", "scope", "hostname", "interface_id", "window_start_iso", "window_end_iso"]


# ------------------------------------------------------------- Spark queries
def events(spark, d):
    return lg.parse_events(log_lines(spark, d))


def _parsed(spark, d):
    kept = lg.kept_lines(lg.classify_noise(lg.clean_lines(log_lines(spark, d))))
    return lg.parse_syslog(lg.collapse_repeats(kept))


def _features(spark, d, sizes=5, maps=False):
    return win.window_features(events(spark, d), sizes, maps=maps)


def _kind(kinds, *cols):
    def run(spark, d):
        e = lg.extract_entities(lg.dispatch_code(_parsed(spark, d)), kinds)
        return lg.event_tags(e).select("source", "ord", *[f"entities.{c}" for c in cols], F.array_join("tags", ";").alias("tags"))

    names = ", ".join(f"'{k}'" for k in kinds)
    sql = PARSE_CTE + f"select source, ord, {', '.join(cols)}{', ' if cols else ''}array_to_string(tags, ';') as tags from ev where kind in ({names})"
    return Case(run, sql)


FINDING_COLUMNS = ["finding_id", "rule_id", "title", "severity", "category", "device", "interface", "vlan", "confidence", "event_count", "first_seen", "last_seen", "tags"]


def _finding_rows(df, *details):
    cols = [F.col(c) if c != "tags" else F.array_join("tags", ";").alias("tags") for c in FINDING_COLUMNS]
    return df.select(*cols, *[F.col("details")[k].alias(k) for k in details])


def _finding_sql(rule, where, keys, select, having="true", minutes=60, extra="", details="", parts=(), tags=""):
    """One rule in plain SQL: group rows, peak per bin, thresholds."""
    key_defs = ", ".join(f"{e} as {k}" for k, e in keys.items())
    names = ", ".join(keys)
    key_id = " || '|' || ".join(["'" + rule + "'", *[f"coalesce({p}, '')" for p in parts]])
    return f"""
select 'SYSF-' || substr(sha1({key_id}), 1, 10) as finding_id, '{rule}' as rule_id, {select}, event_count, first_seen, last_seen, {tags} as tags{details}
from (select {names}, sum(n) as event_count, sum(cnt) as reports, min(a) as first_seen, max(b) as last_seen, coalesce(max(n) filter (bin is not null), 0) as peak,
    max(moves) as moves, arg_max(li, lo) as last_iface, bool_or(short) as short, sum(reboots) as reboots, sum(faults) as faults
  from (select *, sum(w) as n, count(*) as cnt, min("timestamp") as a, max("timestamp") as b, max(coalesce(flap_count, 0)) as moves,
      arg_max(coalesce(interface_id, '<none>'), source || lpad(cast(ord as varchar), 12, '0')) as li, max(source || lpad(cast(ord as varchar), 12, '0')) as lo,
      bool_or(list_contains(tags, 'short_detected')) as short, count_if(list_contains(tags, 'reboot')) as reboots,
      count_if(list_has_any(tags, ['power_fault', 'fan_fault'])) as faults
    from (select {key_defs}, *, date_trunc('day', ts) + to_minutes(cast(floor((hour(ts) * 60 + minute(ts)) / {minutes}) * {minutes} as int)) as bin from ev where {where})
    group by {names}, bin) group by {names}) g {extra}
where {having}
""".replace("select *, sum(w) as n", f"select {names}, bin, sum(w) as n")


def _fsql(select_title, severity, category, interface="null", vlan="null", confidence="'medium'", device="device"):
    return f"{select_title} as title, {severity} as severity, '{category}' as category, {device} as device, {interface} as interface, {vlan} as vlan, {confidence} as confidence"


RULE_SQL = {
    "SYS-PORT-FLAP": _finding_sql(
        "SYS-PORT-FLAP", "list_contains(tags, 'port_flap') and interface_id is not null", {"device": "hostname", "k2": "interface_id"},
        _fsql("'Frequent port flapping observed on ' || k2", "case when peak >= 6 then 'high' else 'medium' end", "interface", "k2", confidence="case when peak >= 6 then 'high' else 'medium' end"),
        "peak >= 3", parts=("device", "k2"), tags="'port_flap;link_state'", details=", cast(peak as varchar) as peak_flaps_per_hour"),
    "SYS-MAC-FLAP": _finding_sql(
        "SYS-MAC-FLAP", "list_contains(tags, 'mac_flap')", {"device": "hostname", "k2": "mac_address", "k3": "vlan_id"},
        _fsql("'MAC flapping / possible L2 loop for ' || coalesce(k2, 'None') || ' in VLAN ' || coalesce(k3, 'None')",
              "case when moves >= 100 and reports > 1 then 'critical' when moves >= 100 then 'high' else 'medium' end", "loop", "nullif(last_iface, '<none>')", "k3", "'high'"),
        "moves >= 20", parts=("device", "k2", "k3"), tags="'mac_flap;loop_risk'", details=", cast(moves as varchar) as max_moves, cast(reports as varchar) as reports"),
    "SYS-SNMP-AUTHFAIL": _finding_sql(
        "SYS-SNMP-AUTHFAIL", "list_has_any(tags, ['snmp_auth_failed', 'snmp_user_auth_failed'])", {"device": "coalesce(hostname, 'unknown')"},
        _fsql("'SNMP authorization failures on ' || g.device || ' (possible recon)'",
              "case when peak >= 20 then 'high' when peak >= 5 or c.insecure <> '' then 'medium' else 'low' end", "security", device="g.device"),
        minutes=5, parts=("g.device",), tags="'snmp_auth_failed;recon_possible'",
        extra="""left join (select coalesce(hostname, 'unknown') as device, string_agg(distinct community, ';' order by community) as communities,
            coalesce(string_agg(distinct community, ';' order by community) filter (community in ('public', 'private')), '') as insecure
            from ev where community is not null group by 1) c on g.device = c.device""",
        details=", cast(peak as varchar) as peak_per_5min, coalesce(c.communities, '') as communities, coalesce(c.insecure, '') as insecure_communities"),
    "SYS-ARP-FAST": _finding_sql(
        "SYS-ARP-FAST", "list_contains(tags, 'arp_instability')", {"device": "hostname", "k2": "ip_address"},
        _fsql("'Rapid ARP/MAC change for host ' || coalesce(k2, 'None')", "case when event_count >= 5 then 'high' else 'medium' end", "security"),
        parts=("device", "k2"), tags="'arp_instability;duplicate_ip_possible'", details=", k2 as ip_address"),
    "SYS-POE-FAULT": _finding_sql(
        "SYS-POE-FAULT", "list_contains(tags, 'poe_fault')", {"device": "hostname", "k2": "interface_id"},
        _fsql("'PoE abnormal/short observed on ' || coalesce(k2, 'None')", "'high'", "poe", "k2", confidence="'high'"),
        parts=("device", "k2"), tags="case when short then 'poe_fault;short_detected' else 'poe_fault' end", details=", cast(short as varchar) as short_detected"),
    "SYS-ERPS-CHURN": _finding_sql(
        "SYS-ERPS-CHURN", "list_contains(tags, 'erps_churn')", {"device": "hostname", "k2": "erps_ring"},
        _fsql("'ERPS ring ' || coalesce(k2, 'None') || ' protection churn / topology instability'", "case when peak >= 6 then 'high' else 'medium' end", "topology"),
        "peak >= 3", parts=("device", "k2"), tags="'erps_churn;topology_instability'", details=", k2 as ring, cast(peak as varchar) as peak_per_hour"),
    "SYS-TELNET": _finding_sql(
        "SYS-TELNET", "list_contains(tags, 'insecure_telnet')", {"device": "coalesce(hostname, 'unknown')"},
        _fsql("'Insecure telnet management observed on ' || device", "'medium'", "security", confidence="'high'"),
        parts=("device",), tags="'management_access;insecure_telnet'"),
    "SYS-DEVICE": _finding_sql(
        "SYS-DEVICE", "list_has_any(tags, ['reboot', 'power_fault', 'fan_fault', 'clock_change'])", {"device": "coalesce(hostname, 'unknown')"},
        _fsql("'Device health / stability events on ' || device", "case when faults > 0 then 'high' else 'medium' end", "device"),
        parts=("device",), tags="'device_health'", details=", cast(reboots as varchar) as reboot_events, cast(faults as varchar) as fault_events"),
}


def findings_cte() -> str:
    cols = ", ".join(FINDING_COLUMNS)
    return PARSE_CTE + ", fnd as (" + " union all ".join(f"select {cols} from ({s})" for s in RULE_SQL.values()) + ")\n"


def _rule(fn, rule, *details):
    return Case(lambda spark, d: _finding_rows(fn(events(spark, d)), *details), PARSE_CTE + RULE_SQL[rule])


def _q(ev_select):
    return PARSE_CTE + ev_select


def _clean(spark, d):
    return lg.clean_lines(log_lines(spark, d)).select("source", "ord", "cleaned_line", "color_hint")


def _noise(spark, d):
    return lg.dropped_lines(lg.classify_noise(lg.clean_lines(log_lines(spark, d)))).select("source", "ord", "drop_reason", "cleaned_line")


def _collapsed(spark, d):
    kept = lg.kept_lines(lg.classify_noise(lg.clean_lines(log_lines(spark, d))))
    return lg.collapse_repeats(kept).select("source", "cleaned_line", "ord", "line", "color_hint", "duplicate_count")


def _grammar(spark, d):
    cols = ["source", "ord", "fail_reason", "hostname", "module", "facility", "mnemonic", "severity_code", "message", "code"]
    return _parsed(spark, d).select(*cols)


def _times(spark, d):
    return _parsed(spark, d).select("source", "ord", "timestamp", "timestamp_utc", "clock_unreliable")


def _severity(spark, d):
    p = _parsed(spark, d)
    return p.groupBy("severity_label", lg.log_severity_rank(F.col("severity_label")).alias("severity_rank")).agg(F.count(F.lit(1)).alias("n"))


def _dispatch(spark, d):
    return lg.dispatch_code(_parsed(spark, d)).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"))


def _enriched(spark, d):
    e = events(spark, d)
    return e.select("source", "ord", "event_id", "parse_status", F.array_join("tags", ";").alias("tags"), "hints.engine_a_intrusion", "hints.engine_b_health",
                    "hints.engine_c_topology", "hints.engine_c_poe", "hints.engine_c_security", "hints.correlation_candidate")


ENRICH_SQL = _q("""select source, ord, event_id, parse_status, array_to_string(tags, ';') as tags,
 coalesce(kind in ('arp','snmp_community','snmp_user'), false) as engine_a_intrusion,
 coalesce(kind in ('link','mac_flap','poe_churn','ring','ring_port','power','fan','unit','clock','process'), false) as engine_b_health,
 coalesce(kind in ('mac_flap','ring','ring_port'), false) as engine_c_topology, coalesce(kind in ('poe_fault','poe_churn'), false) as engine_c_poe,
 coalesce(kind in ('arp','telnet','web'), false) as engine_c_security,
 coalesce(kind in ('mac_flap','arp','snmp_community','snmp_user','poe_fault','ring','ring_port') or (kind in ('power','fan') and faulty), false) as correlation_candidate from ev""")

SUMMARY_SQL = _q("""
, c as (select 'parse_status' as metric, parse_status as key, count(*) as n from ev group by all union all select 'severity_label', severity_label, count(*) from ev group by all
 union all select 'facility', facility, count(*) from ev where facility is not null group by all union all select 'code', code, count(*) from ev where code is not null group by all
 union all select 'hostname', hostname, count(*) from ev where hostname is not null group by all),
r as (select *, row_number() over (partition by metric order by n desc, key) as rn from c),
t as (select count(*) as parsed_events, sum(w) as weighted_events, sum(w - 1) as duplicate_lines_collapsed, count_if(clock_unreliable) as clock_unreliable_events,
  min("timestamp") filter (not clock_unreliable) as f, max("timestamp") filter (not clock_unreliable) as l from ev)
select metric, key, cast(n as varchar) as value from r where (metric <> 'facility' or rn <= 15) and (metric <> 'code' or rn <= 20)
union all select 'total', 'parsed_events', cast(parsed_events as varchar) from t union all select 'total', 'weighted_events', cast(weighted_events as varchar) from t
union all select 'total', 'duplicate_lines_collapsed', cast(duplicate_lines_collapsed as varchar) from t
union all select 'total', 'clock_unreliable_events', cast(clock_unreliable_events as varchar) from t
union all select 'total', 'first', f from t union all select 'total', 'last', l from t""")


def _cols(df, *names):
    return df.select(*names)


def _bin_sql(minutes):
    return _q(f"""select source, ord, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, strftime(ws + interval {minutes} minute, '%Y-%m-%d %H:%M:%S') as window_end
 from (select *, date_trunc('day', ts) + to_minutes(cast(floor((hour(ts) * 60 + minute(ts)) / {minutes}) * {minutes} as int)) as ws from ev where ts is not null)""")


def _bins(spark, d):
    b = win.bin_bounds(events(spark, d).where("ts is not null"), 7)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return b.select("source", "ord", F.date_format("window_start", fmt).alias("window_start"), F.date_format("window_end", fmt).alias("window_end"))


def _peaks(spark, d):
    return win.peak_per_bin(events(spark, d), ["hostname", "kind"], 60)


PEAK_SQL = _q("""select hostname, kind, coalesce(max(n) filter (bin is not null), 0) as peak from (
 select hostname, kind, date_trunc('hour', ts) as bin, sum(w) as n from ev group by all) group by all""")

SUMWIN_SQL = windows_cte(5) + "select count(*) as window_count, count(distinct hostname) as host_count, count_if(scope = 'host') as host_windows, count_if(scope = 'interface') as interface_windows, min(window_start_iso) as first_window, max(window_start_iso) as last_window, " + ", ".join(
    [f"sum({c}) as sum_{c}" for c in win.TOTALS] + [f"count_if({c}) as pos_{c}" for c in win.LABELS]) + " from wl"

CASES = {
    "log_clean_lines": Case(_clean, CLEAN_CTE + "select source, ord, cleaned_line, color_hint from cls"),
    "log_classify_noise": Case(_noise, CLEAN_CTE + "select source, ord, drop_reason, cleaned_line from cls where drop_reason is not null"),
    "log_collapse_repeats": Case(_collapsed, CLEAN_CTE + "select * from kept"),
    "log_parse_grammar": Case(_grammar, _q("select source, ord, fail_reason, hostname, module, facility, mnemonic, severity_code, message, code from ev")),
    "log_time_local_utc": Case(_times, _q('select source, ord, "timestamp", timestamp_utc, clock_unreliable from ev')),
    "log_severity_labels": Case(_severity, _q("""select severity_label, case severity_label when 'emergency' then 0 when 'alert' then 1 when 'critical' then 2 when 'error' then 3
      when 'warning' then 4 when 'notice' then 5 when 'info' then 6 when 'debug' then 7 else 8 end as severity_rank, count(*) as n from ev group by all""")),
    "log_dispatch_code": Case(_dispatch, _q("select code, kind, count(*) as n from ev group by all")),
    "log_extract_link": _kind(["link"], "interface_id"),
    "log_extract_mac_flap": _kind(["mac_flap"], "mac_address", "vlan_id", "interface_id", "flap_count"),
    "log_extract_arp": _kind(["arp"], "ip_address"),
    "log_extract_snmp": _kind(["snmp_community", "snmp_user"], "community", "username"),
    "log_extract_poe": _kind(["poe_fault", "poe_churn"], "interface_id"),
    "log_extract_ring": _kind(["ring", "ring_port"], "erps_ring", "interface_id", "erps_state"),
    "log_extract_device": _kind(["power", "fan", "unit", "clock", "process"], "power_unit", "fan_id", "process_name"),
    "log_extract_access": _kind(["telnet", "web"], "ip_address", "login_protocol"),
    "log_enrich": Case(_enriched, ENRICH_SQL),
    "log_parse_summary": Case(lambda s, d: lg.parse_summary(events(s, d)), SUMMARY_SQL),
    "agg_bin_bounds": Case(_bins, _bin_sql(7)),
    "agg_eligible": Case(lambda s, d: _cols(win.eligible(events(s, d)), "source", "ord", "event_id"), _q("select source, ord, event_id from ev where parse_status <> 'failed' and ts is not null and not clock_unreliable")),
    "agg_two_scope_counters": Case(lambda s, d: _cols(_features(s, d), *WINDOW_KEYS, *COUNTERS[:5]), windows_cte(5) + f"select {', '.join(WINDOW_KEYS + COUNTERS[:5])} from wl"),
    "agg_tag_counters": Case(lambda s, d: _cols(_features(s, d, 60), *WINDOW_KEYS, *COUNTERS[5:16]), windows_cte(60) + f"select {', '.join(WINDOW_KEYS + COUNTERS[5:16])} from wl"),
    "agg_severity_counts": Case(lambda s, d: _cols(_features(s, d, 60), *WINDOW_KEYS, *COUNTERS[16:]), windows_cte(60) + f"select {', '.join(WINDOW_KEYS + COUNTERS[16:])} from wl"),
    "agg_distinct_sources": Case(lambda s, d: _cols(_features(s, d, 15), *WINDOW_KEYS, "unique_snmp_source_ips"), windows_cte(15) + f"select {', '.join(WINDOW_KEYS)}, unique_snmp_source_ips from wl"),
    "agg_count_maps": Case(
        lambda s, d: win.count_maps(events(s, d), [5]).select("scope", "hostname", "interface_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "facility_counts", F.coalesce("mnemonic_counts", F.lit("{}")).alias("mnemonic_counts")),
        MAPS_SQL + "select scope, hostname, interface_id, strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, facility_counts, coalesce(mnemonic_counts, '{}') as mnemonic_counts from fj left join mj using (scope, hostname, interface_id, ws)"),
    "agg_weak_labels": Case(lambda s, d: _cols(_features(s, d), *WINDOW_KEYS, *LABEL_COLUMNS), windows_cte(5) + f"select {', '.join(WINDOW_KEYS + LABEL_COLUMNS)} from wl"),
    "agg_window_features": Case(
        lambda s, d: _cols(_features(s, d, 5, True), *WINDOW_KEYS, *COUNTERS, *LABEL_COLUMNS, "facility_counts", "mnemonic_counts"),
        MAPS_SQL + f"select {', '.join('wl.' + c for c in WINDOW_KEYS + COUNTERS + LABEL_COLUMNS)}, facility_counts, coalesce(mnemonic_counts, '{{}}') as mnemonic_counts from wl left join fj on wl.scope = fj.scope and wl.hostname = fj.hostname and wl.interface_id = fj.interface_id and wl.window_start = fj.ws left join mj on wl.scope = mj.scope and wl.hostname = mj.hostname and wl.interface_id = mj.interface_id and wl.window_start = mj.ws"),
    "agg_several_sizes": Case(
        lambda s, d: win.window_features(events(s, d), [5, 15], maps=False).groupBy("window_minutes", "scope").agg(F.count(F.lit(1)).alias("windows"), F.sum("weighted_event_count").alias("weighted")),
        " union all ".join(f"(select * from ({windows_cte(m)} select window_minutes, scope, count(*) as windows, sum(weighted_event_count) as weighted from wl group by all))" for m in (5, 15))),
    "agg_summarize_windows": Case(lambda s, d: win.summarize_windows(_features(s, d)), SUMWIN_SQL),
    "agg_peak_per_bin": Case(_peaks, PEAK_SQL),
    "fnd_port_flap": _rule(fnd.find_port_flap, "SYS-PORT-FLAP", "peak_flaps_per_hour"),
    "fnd_mac_flap": _rule(fnd.find_mac_flap, "SYS-MAC-FLAP", "max_moves", "reports"),
    "fnd_auth_failures": _rule(fnd.find_auth_failures, "SYS-SNMP-AUTHFAIL", "peak_per_5min", "communities", "insecure_communities"),
    "fnd_arp_change": _rule(fnd.find_arp_change, "SYS-ARP-FAST", "ip_address"),
    "fnd_poe_fault": _rule(fnd.find_poe_fault, "SYS-POE-FAULT", "short_detected"),
    "fnd_ring_churn": _rule(fnd.find_ring_churn, "SYS-ERPS-CHURN", "ring", "peak_per_hour"),
    "fnd_cleartext_mgmt": _rule(fnd.find_cleartext_mgmt, "SYS-TELNET"),
    "fnd_device_health": _rule(fnd.find_device_health, "SYS-DEVICE", "reboot_events", "fault_events"),
    "fnd_all_rules": Case(lambda s, d: _finding_rows(fnd.log_findings(events(s, d))), findings_cte() + f"select {', '.join(FINDING_COLUMNS)} from fnd"),
    "fnd_summary": Case(
        lambda s, d: fnd.summarize_findings(fnd.log_findings(events(s, d))),
        findings_cte() + "select 'severity' as dimension, severity as value, count(*) as n from fnd group by all union all select 'category', category, count(*) from fnd group by all union all select 'rule_id', rule_id, count(*) from fnd group by all"),
}
