"""Queries for signals and incident correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import Case, bind
from opsframe.checks.logs import PARSE_CTE, events, findings_cte
from opsframe.functions.scalars import digest_id
from opsframe.operators import findings as fnd
from opsframe.operators import incidents as inc
from opsframe.operators import signals as sg
from opsframe.session import cut_lineage

SIG = """
select 'run' || cast(day(ts) as string) as run_id, 'S' || cast(event_id as string) as signal_id, event_id as ord,
 case when event_id % 17 = 0 then 'engine_a' when event_id % 8 = 1 then 'engine_b' when event_id % 8 in (2, 3, 4) then 'engine_c' else 'syslog' end as engine,
 case event_id % 8 when 5 then case event_id % 3 when 0 then 'SYSLOG_PORT_FLAP' when 1 then 'SYSLOG_POE_FAULT' else 'SYSLOG_MAC_FLAP' end
   when 6 then case event_id % 3 when 0 then 'SYSLOG_SNMP_AUTH_ACTIVITY' when 1 then 'SYSLOG_ERPS_CHURN' else 'SYSLOG_DUPLICATE_IP' end
   when 7 then case event_id % 3 when 0 then 'SYSLOG_MANAGEMENT_ACCESS' when 1 then 'SYSLOG_HA_STATE_CHANGE' else 'SYSLOG_CLOCK_UNRELIABLE' end end as source_type,
 case event_id % 5 when 0 then 'vlan' when 1 then 'topology' when 2 then 'port' when 3 then 'interface' else 'security' end as category,
 case event_id % 11 when 0 then 'critical' when 1 then 'high' when 2 then 'high' when 3 then 'medium' when 4 then 'low' else 'info' end as severity,
 case when event_id % 6 = 0 then null else 'SW' || cast(user_id % 5 as string) end as device,
 case event_id % 4 when 0 then null when 1 then 'GigabitEthernet0/' || cast(user_id % 3 as string) when 2 then 'gi0/' || cast(user_id % 3 as string) else 'Te 0/' || cast(user_id % 2 as string) end as interface,
 event_id % 20 as event_count, event_id % 9 = 0 as aggregate, event_id % 8 = 7 and event_id % 3 = 2 as clock_unreliable, event_id % 10 <> 0 as entity_confident,
 case when event_id % 7 = 0 then 'low' else 'high' end as confidence_label, 'title ' || cast(event_id % 13 as string) as title, 'file' || cast(event_id % 3 as string) as source_artifact,
 split(case when event_id % 17 = 0 then case when event_id % 2 = 0 then 'attack;dos' else 'attack' end when event_id % 8 = 1 then 'anomaly'
   when event_id % 8 = 2 then 'UNUSED_PORT_ADMIN_UP' when event_id % 8 = 3 then 'WRONG_ACCESS_VLAN' when event_id % 8 = 4 then 'other'
   when event_id % 8 = 7 and event_id % 3 = 2 then 'clock_unreliable' else 'syslog' end, ';') as tags
from events
"""
# runs of a device and day, in which intrusion signals become health signals every other day
QUIET = SIG.replace("'run' || cast(day(ts) as string) as run_id", "'run' || cast(day(ts) as string) || case when day(ts) % 2 = 0 then 'q' else '' end as run_id").replace(
    "case when event_id % 17 = 0 then 'engine_a'", "case when event_id % 17 = 0 and day(ts) % 2 = 1 then 'engine_a'")
CTE = f"""with sig as ({SIG}),
p as (select *, lower(trim(regexp_replace(coalesce(interface, ''), '^([A-Za-z]+) *([0-9/]+)$', '\\1'))) as pf, regexp_extract(coalesce(interface, ''), '([0-9/]+)$', 1) as nm from sig),
c as (select *, coalesce(device, 'unknown') as gd, lower(coalesce(device, '')) as dev, nullif(lower(trim(interface)), '') as lif,
  case when interface is null then null when pf in ('gigabitethernet', 'gi') then 'te' || '' || nm when pf = 'te' then 'te' || nm end as cif0,
  case when interface is null then null when pf = 'te' then 'te' || nm else 'gi' || nm end as cif,
  greatest(1, event_count) as w, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as rk,
  engine = 'engine_a' and list_contains(tags, 'attack') as attack, engine = 'engine_a' and list_contains(tags, 'dos') as dos, engine = 'engine_b' and list_contains(tags, 'anomaly') as health,
  engine = 'engine_c' and category in ('topology', 'interface') as saturation, engine = 'engine_c' and category in ('port', 'topology') as degraded,
  engine = 'engine_c' and list_contains(tags, 'UNUSED_PORT_ADMIN_UP') as exposed, engine = 'engine_c' and list_contains(tags, 'WRONG_ACCESS_VLAN') as vlan_issue,
  engine = 'engine_c' and category = 'topology' as topo, engine = 'syslog' as lg from p),
rf as (select run_id, bool_or(attack) as a, bool_or(dos) as d, bool_or(health) as h, bool_or(degraded) as g from c group by run_id),
m_sat as (select run_id, 'DOS_SATURATION' as rule_id, 'run' as key, signal_id from c join rf using (run_id) where a and h and ((d and dos) or (not d and attack) or health or saturation)),
m_link as (select run_id, 'LINK_DEGRADATION' as rule_id, gd as key, signal_id from c join rf using (run_id) where not a and h and g and degraded
  union select x.run_id, 'LINK_DEGRADATION', x.gd, y.signal_id from c x join rf on x.run_id = rf.run_id join c y on x.run_id = y.run_id where not a and h and x.degraded and y.health),
m_exp as (select run_id, 'CONFIG_EXPOSURE' as rule_id, gd as key, signal_id from c where exposed
  union select x.run_id, 'CONFIG_EXPOSURE', x.gd, y.signal_id from c x join c y on x.run_id = y.run_id where x.exposed and y.attack),
m_vlan as (select run_id, 'VLAN_POLICY_RISK' as rule_id, gd as key, signal_id from c join rf using (run_id) where a and vlan_issue
  union select x.run_id, 'VLAN_POLICY_RISK', x.gd, y.signal_id from c x join c y on x.run_id = y.run_id where x.vlan_issue and y.attack),
au as (select run_id, gd from c where lg and source_type = 'SYSLOG_SNMP_AUTH_ACTIVITY' group by all having sum(w) >= 10),
m_auth as (select run_id, 'SYSLOG_SNMP_AUTH_CAMPAIGN' as rule_id, gd as key, signal_id from c join au using (run_id, gd) where lg and source_type = 'SYSLOG_SNMP_AUTH_ACTIVITY'
  union select au.run_id, 'SYSLOG_SNMP_AUTH_CAMPAIGN', au.gd, y.signal_id from au join c y on au.run_id = y.run_id where y.attack),
m_port as (select run_id, 'PORT_INSTABILITY' as rule_id, signal_id as key, signal_id from c where lg and source_type = 'SYSLOG_PORT_FLAP' and w >= 4
  union select x.run_id, 'PORT_INSTABILITY', x.signal_id, y.signal_id from c x join c y on x.run_id = y.run_id and lower(x.gd) = y.dev
    where x.lg and x.source_type = 'SYSLOG_PORT_FLAP' and x.w >= 4 and (y.health or (y.engine = 'engine_c' and x.cif = y.cif))),
lp as (select run_id, dev, bool_or(source_type = 'SYSLOG_MAC_FLAP') filter (lg) as hm, bool_or(source_type = 'SYSLOG_ERPS_CHURN') filter (lg) as hr, bool_or(topo) as ht,
  coalesce(sum(w) filter (lg and source_type = 'SYSLOG_MAC_FLAP'), 0) as n from c where dev <> '' group by all),
m_loop as (select run_id, 'LOOP_OR_REDUNDANCY_INSTABILITY' as rule_id, dev as key, signal_id from c join lp using (run_id, dev)
  where (coalesce(hm, false) or coalesce(hr, false)) and (coalesce(hr, false) or n >= 3) and (topo or (lg and source_type in ('SYSLOG_MAC_FLAP', 'SYSLOG_ERPS_CHURN')))),
m_dup as (select run_id, 'DUPLICATE_IP_CONFLICT' as rule_id, gd as key, signal_id from c where lg and source_type = 'SYSLOG_DUPLICATE_IP'
  union select x.run_id, 'DUPLICATE_IP_CONFLICT', x.gd, y.signal_id from c x join c y on x.run_id = y.run_id and lower(x.gd) = y.dev where x.lg and x.source_type = 'SYSLOG_DUPLICATE_IP' and y.lg and y.source_type = 'SYSLOG_MAC_FLAP'),
m_poe as (select run_id, 'POE_ENDPOINT_FAILURE' as rule_id, signal_id as key, signal_id from c where lg and source_type = 'SYSLOG_POE_FAULT'
  union select x.run_id, 'POE_ENDPOINT_FAILURE', x.signal_id, y.signal_id from c x join c y on x.run_id = y.run_id where x.lg and x.source_type = 'SYSLOG_POE_FAULT'
    and ((y.lg and y.source_type = 'SYSLOG_PORT_FLAP' and x.interface = y.interface) or (y.engine = 'engine_c' and lower(x.gd) = y.dev and x.cif = y.cif))),
m_mgmt as (select run_id, 'MANAGEMENT_ACCESS_EXPOSURE' as rule_id, gd as key, signal_id from c where lg and source_type = 'SYSLOG_MANAGEMENT_ACCESS'
  union select x.run_id, 'MANAGEMENT_ACCESS_EXPOSURE', x.gd, y.signal_id from c x join c y on x.run_id = y.run_id where x.lg and x.source_type = 'SYSLOG_MANAGEMENT_ACCESS'
    and (y.attack or (lower(x.gd) = y.dev and (y.exposed or (y.lg and y.source_type = 'SYSLOG_SNMP_AUTH_ACTIVITY'))))),
m_clock as (select run_id, 'CLOCK_INTEGRITY_RISK' as rule_id, 'run' as key, signal_id from c where lg and list_contains(tags, 'clock_unreliable')),
mx as (select * from m_sat union select * from m_link union select * from m_exp union select * from m_vlan union select * from m_auth union select * from m_port
  union select * from m_loop union select * from m_dup union select * from m_poe union select * from m_mgmt union select * from m_clock),
m_free as (select run_id, case when engine = 'syslog' then 'SINGLE_SYSLOG_HIGH_RISK' else 'SINGLE_ENGINE_HIGH_RISK' end as rule_id, signal_id as key, signal_id from c
  where rk <= 1 and not exists (select 1 from mx where mx.run_id = c.run_id and mx.signal_id = c.signal_id)),
mem as (select * from mx union all select * from m_free),
j as (select mem.run_id, rule_id, key, c.* exclude (run_id) from mem join c on mem.run_id = c.run_id and mem.signal_id = c.signal_id),
si as (select distinct run_id, rule_id, key from (select run_id, rule_id, key, interface from j where interface is not null group by all having count(distinct engine) > 1)),
sd as (select distinct run_id, rule_id, key from (select run_id, rule_id, key, device from j where device is not null group by all having count(distinct engine) > 1)),
g as (select run_id, rule_id, key, count(*) as n_signals, count(distinct engine) as n_engines, min(rk) as rk, bool_or(aggregate) as ag, bool_and(aggregate) as aggregate_only,
  count_if(engine = 'syslog') as syslog_signals, bool_or(confidence_label = 'low') as low_evidence, bool_or(not entity_confident) as unsure_entities,
  bool_or(clock_unreliable) as anyc, bool_and(clock_unreliable) as allc from j group by all),
s as (select g.*, si.key is not null as same_if, sd.key is not null as same_dev, lp.dev is not null and (coalesce(hm, false)::int + coalesce(hr, false)::int + coalesce(ht, false)::int) < 2 as cap_loop
  from g left join si using (run_id, rule_id, key) left join sd using (run_id, rule_id, key) left join lp on g.rule_id like 'LOOP%' and lp.run_id = g.run_id and lp.dev = g.key),
z as (select *, greatest(case when rule_id = 'DUPLICATE_IP_CONFLICT' or cap_loop then 1 else 0 end,
    greatest(0, rk - case when n_engines >= 2 and rule_id in ('DOS_SATURATION', 'VLAN_POLICY_RISK', 'SYSLOG_SNMP_AUTH_CAMPAIGN', 'PORT_INSTABILITY') then 1 else 0 end - same_if::int)) as fr,
  case rule_id when 'DOS_SATURATION' then 0.45 when 'VLAN_POLICY_RISK' then 0.42 when 'SYSLOG_SNMP_AUTH_CAMPAIGN' then 0.5 when 'PORT_INSTABILITY' then 0.5 when 'LOOP_OR_REDUNDANCY_INSTABILITY' then 0.5
    when 'DUPLICATE_IP_CONFLICT' then 0.55 when 'POE_ENDPOINT_FAILURE' then 0.5 when 'MANAGEMENT_ACCESS_EXPOSURE' then 0.45 when 'SINGLE_ENGINE_HIGH_RISK' then 0.3 when 'SINGLE_SYSLOG_HIGH_RISK' then 0.35 else 0.4 end
    + 0.2 * (n_engines - 1) + case when same_if then 0.25 else 0 end + case when same_dev then 0.15 else 0 end - case when ag then 0.2 else 0 end as sc from s),
pr as (select a.run_id, a.rule_id, a.key, max(case
    when a.dev = '' or b.dev = '' or a.dev <> b.dev then case when a.lif = b.lif then 2 else 3 end
    when a.lif is null or b.lif is null or a.lif = b.lif then 0 when a.cif = b.cif then 1 else 2 end) as worst
  from j a join j b on a.run_id = b.run_id and a.rule_id = b.rule_id and a.key = b.key and a.ord < b.ord and a.engine <> b.engine group by all),
fin as (select z.*, case fr when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end as severity, round(greatest(0, least(1, sc)), 6) as confidence,
  case when allc then 'unreliable' when anyc then 'approximate' else 'reliable' end as time_reliability,
  case worst when 0 then 'exact' when 1 then 'normalized' when 2 then 'uncertain' when 3 then 'none' else 'n/a' end as entity_match from z left join pr using (run_id, rule_id, key))
"""


def sig(s, d):
    return bind(s, d, SIG)


def _rule(fn, name):
    return Case(lambda s, d: fn(inc.classify(sig(s, d))).rows().select("run_id", "rule_id", "key", "signal_id"), CTE + f"select run_id, rule_id, key, signal_id from {name}")


def _incidents(*cols):
    def run(s, d):
        return inc.correlate(sig(s, d))[0].withColumn("confidence", F.round("confidence", 6)).select("run_id", "rule_id", "key", *cols)

    return Case(run, CTE + f"select run_id, rule_id, key{''.join(', ' + c for c in cols)} from fin")


def _evidence(s, d):
    return inc.incident_evidence(inc.cross_members(cut_lineage(inc.classify(sig(s, d)))))


def _items(s, d):
    """Evidence of the critical incidents."""
    incidents, m = inc.correlate(sig(s, d))
    found = incidents.where("severity = 'critical'")
    return inc.evidence_items(m, found).drop("incident_id")


def _uncovered(s, d):
    c = cut_lineage(inc.classify(sig(s, d)))
    return inc.rule_uncovered(c, inc.cross_members(c)).select("run_id", "rule_id", "key", "signal_id")


def _no_attack(s, d):
    """Runs by hour, half of them without an attack, so that degraded links come without one."""
    return bind(s, d, QUIET)


def log_findings(s, d):
    return fnd.log_findings(events(s, d)).withColumn("run_id", F.lit("r1"))


SIGCOLS = ["run_id", "signal_id", "engine", "source_type", "category", "severity", "confidence", "confidence_label", "title", "device", "interface", "vlan", "mac", "src_ip", "event_count", "aggregate", "clock_unreliable", "entity_confident"]


def _sigrows(df):
    return df.select(*[F.round(c, 6).alias(c) if c == "confidence" else F.col(c) for c in SIGCOLS], F.array_join("tags", ";").alias("tags"))


def sid(engine, src, cat, dev, iface, title):
    return f"'SIG-' || substr(sha1('{engine}|' || {src} || '|' || {cat} || '|' || coalesce({dev}, '') || '|' || coalesce({iface}, '') || '|' || {title}), 1, 10)"


_ST = "case rule_id " + " ".join(f"when '{k}' then '{v}'" for k, v in sg.SOURCE_TYPES.items()) + " end"
LOGSIG_SQL = findings_cte() + f""", x as (select *, {_ST} as st from fnd), y as (select *, st in ('SYSLOG_SNMP_AUTH_ACTIVITY', 'SYSLOG_HA_STATE_CHANGE') as aggregate from x),
q as (select *, device is not null and (aggregate or interface is not null) as sure, case when st in ('SYSLOG_MAC_FLAP', 'SYSLOG_MANAGEMENT_ACCESS') then 'medium' else 'high' end as band from y)
select 'r1' as run_id, {sid('syslog', "'syslog_ingestion/r1/engine_c/syslog_findings.json'", 'st', 'device', 'interface', 'title')} as signal_id, 'syslog' as engine, st as source_type, category, severity,
 round(case band when 'high' then 0.9 else 0.7 end * case when sure then 1 else 0.85 end, 6) as confidence, case when not sure and band = 'high' then 'medium' else band end as confidence_label, title, device, interface, vlan,
 nullif(regexp_extract(title, '([0-9a-fA-F]{{4}}\\.[0-9a-fA-F]{{4}}\\.[0-9a-fA-F]{{4}})', 1), '') as mac, case when rule_id = 'SYS-ARP-FAST' then regexp_extract(title, 'host (.*)$', 1) end as src_ip,
 event_count, aggregate, false as clock_unreliable, sure as entity_confident, tags || ';' || st || ';syslog' as tags from q"""

CONF_BIND = """select 'snap' || cast(o_custkey % 3 as string) as run_id, 'F' || cast(o_orderkey as string) as finding_id, 'R' || cast(o_orderkey % 4 as string) as rule_id,
 'port' as category, case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as severity, case o_orderkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'odd' end as confidence,
 case when o_orderkey % 5 = 0 then ' ' else 'sw' || cast(o_custkey % 20 as string) end as device, cast(null as string) as interface, cast(o_orderkey % 90 as string) as vlan, 'finding ' || cast(o_orderkey as string) as title,
 split('a;b', ';') as tags from orders"""
WARN_BIND = """select 'snap' || cast(o_custkey % 3 as string) as run_id, 'W' || cast(o_orderkey as string) as warning_id, 'mac' as category, case o_orderkey % 4 when 0 then 'critical' when 1 then 'warning' when 2 then 'info' else 'odd' end as severity,
 'sw' || cast(o_custkey % 20 as string) as device, 'gi0/' || cast(o_orderkey % 8 as string) as interface, 'warning ' || cast(o_orderkey as string) as message from orders where o_orderkey % 2 = 0"""
CARD_BIND = "select 'snap' || cast(c_nationkey % 3 as string) as run_id, c_name as device, case c_custkey % 3 when 0 then 'Critical' when 1 then 'warning' else 'healthy' end as status from customer"
CONFSIG_SQL = f"""with f as ({CONF_BIND}), w as ({WARN_BIND}), k as ({CARD_BIND})
select run_id, {sid('engine_c', "'network_config/' || run_id || '/findings.json'", 'category', "nullif(trim(device), '')", 'interface', 'title')} as signal_id, severity, case confidence when 'high' then 0.9 when 'medium' then 0.75 when 'low' then 0.55 else 0.7 end as confidence,
  category, nullif(trim(device), '') as device, interface, 'a;b;' || rule_id as tags, false as aggregate from f
union all select run_id, {sid('engine_c', "'network_config/' || run_id || '/topology.json'", "'topology:mac'", 'device', 'interface', 'message')}, case severity when 'critical' then 'critical' when 'warning' then 'medium' else 'info' end, 0.6, 'topology', device, interface, 'topology;mac', false from w
union all select run_id, {sid('engine_c', "'network_config/' || run_id || '/dashboard/device_health_cards.json'", "'device_health'", 'device', 'null', "'Device health ' || lower(status) || ': ' || device")}, case lower(status) when 'critical' then 'high' else 'medium' end, 0.5, 'device_health', device, null, 'device_health;' || lower(status), true
  from k where lower(status) in ('critical', 'warning')"""
HEALTH_BIND = "select 'site' || cast(s_nationkey % 5 as string) as run_id, 'ds' || cast(s_suppkey % 3 as string) as dataset, s_name as experiment_id, 'forest' as model_name, s_suppkey % 50 as n_samples, case when s_suppkey % 2 = 0 then 0 else s_suppkey % 50 end as n_anomalous from supplier"
RUN_BIND = "select 'site' || cast(s_nationkey % 5 as string) as run_id, 'nsl_kdd' as dataset, s_name as experiment_id, 'gbt' as model_type, s_suppkey as k from supplier"


def _intrusion(s, d):
    r = bind(s, d, RUN_BIND)
    pro = r.where("k % 7 = 0").groupBy("run_id", "dataset").agg(F.min("experiment_id").alias("experiment_id"))
    best = r.groupBy("run_id", "dataset").agg(F.min("experiment_id").alias("experiment_id"))
    return sg.intrusion_signals(r, pro.where("run_id <> 'site1'"), best.where("run_id <> 'site2'")).select("run_id", "signal_id", "raw_reference", F.array_join("tags", ";").alias("tags"))


CLOCK_SQL = PARSE_CTE + f"""select 'r1' as run_id, {sid('syslog', "'syslog_ingestion/r1/parser_summary.json'", "'SYSLOG_CLOCK_UNRELIABLE'", 'h', 'null', "'Unreliable device clock(s) observed in syslog'")} as signal_id, n as event_count, h as device, round(0.5 * 0.6, 6) as confidence
 from (select count_if(clock_unreliable) as n, min(hostname) as h from ev) where n > 0"""
GENERIC_SQL = PARSE_CTE + """, g as (select coalesce(hostname, 'unknown') as device, coalesce(code, 'GENERIC') as code, sum(w) as event_count from ev where parse_status = 'generic' group by all)
select 'r1' as run_id, device, code as raw_reference, event_count from (select *, row_number() over (order by event_count desc, device, code) as r from g) where r <= 25"""
PAIR_BIND = """select a.event_id as i, b.event_id as k, 'SW' || cast(a.user_id % 3 as string) as da, case when b.event_id % 4 = 0 then null else 'sw' || cast(b.user_id % 3 as string) end as db,
 case when a.event_id % 5 = 0 then null else 'GigabitEthernet0/' || cast(a.user_id % 2 as string) end as ia, case b.event_id % 3 when 0 then 'gi0/' || cast(b.user_id % 2 as string) when 1 then 'GIGABITETHERNET0/1' else null end as ib
 from events a join events b on a.event_id + 1 = b.event_id"""
PAIR_SQL = f"""with p as ({PAIR_BIND}), q as (select *, lower(da) = lower(db) as sd, lower(ia) as la, lower(ib) as lb, 'gi' || regexp_extract(ia, '([0-9/]+)$', 1) as ca, 'gi' || regexp_extract(ib, '([0-9/]+)$', 1) as cb from p)
select i, k, case when not coalesce(sd, false) then case when la = lb then 'uncertain' else 'none' end when la is null or lb is null or la = lb then 'exact' when ca = cb then 'normalized' else 'uncertain' end as m from q"""
IF_BIND = """select event_id, case event_id % 9 when 0 then 'GigabitEthernet0/' when 1 then 'Gig 0/' when 2 then 'Te' when 3 then 'FastEthernet0/' when 4 then 'Eth' when 5 then 'Port-channel' when 6 then 'vlanif' when 7 then 'g' else 'weird name ' end || cast(user_id % 4 as string) as n from events"""

CASES = {
    "cor_config_signals": Case(lambda s, d: sg.config_signals(bind(s, d, CONF_BIND), bind(s, d, WARN_BIND), bind(s, d, CARD_BIND)).select("run_id", "signal_id", "severity", "confidence", "category", "device", "interface", F.array_join("tags", ";").alias("tags"), "aggregate"), CONFSIG_SQL),
    "cor_health_signals": Case(lambda s, d: sg.health_signals(bind(s, d, HEALTH_BIND)).select("run_id", "title", "severity", "confidence", "raw_reference"),
        f"""with h as ({HEALTH_BIND}), r as (select *, row_number() over (partition by run_id, dataset order by experiment_id desc) as rn, case when n_samples = 0 then 0 else n_anomalous / n_samples end as q from h)
        select run_id, 'Network-health anomalies (aggregate, ' || dataset || ')' as title, case when q >= 0.2 then 'high' when q >= 0.05 then 'medium' when q > 0 then 'low' else 'info' end as severity, 0.6 as confidence, experiment_id as raw_reference from r where rn = 1"""),
    "cor_intrusion_signals": Case(_intrusion, f"""with r as ({RUN_BIND}), p as (select run_id, min(experiment_id) as e from r where k % 7 = 0 and run_id <> 'site1' group by 1), b as (select run_id, min(experiment_id) as e from r where run_id <> 'site2' group by 1),
        x as (select r.run_id, coalesce(min(p.e), min(b.e), max(r.experiment_id)) as e from r left join p using (run_id) left join b using (run_id) group by 1)
        select run_id, {sid('engine_a', "'experiments/nsl_kdd/gbt/' || e || '/metrics.json'", "'intrusion'", 'null', 'null', "'Intrusion-detection coverage (aggregate, nsl_kdd)'")} as signal_id, e as raw_reference, 'attack;aggregate;dos;probe;r2l;u2r' as tags from x"""),
    "cor_log_signals": Case(lambda s, d: _sigrows(sg.log_signals(log_findings(s, d))), LOGSIG_SQL),
    "cor_clock_signal": Case(lambda s, d: sg.clock_signal(events(s, d).withColumn("run_id", F.lit("r1"))).select("run_id", "signal_id", "event_count", "device", F.round("confidence", 6).alias("confidence")), CLOCK_SQL),
    "cor_generic_signals": Case(lambda s, d: sg.generic_signals(events(s, d).withColumn("run_id", F.lit("r1"))).select("run_id", "device", "raw_reference", "event_count"), GENERIC_SQL),
    "cor_signal_confidence": Case(
        lambda s, d: (lambda x: x.select("signal_id", *[(F.round(e, 6) if n == "confidence" else F.array_join(e, ";") if n == "notes" else e).alias(n) for n, e in sg.signal_confidence(F.col("source_type"), F.col("clock_unreliable"), F.col("entity_confident")).items()]))(sig(s, d)),
        f"""with s as ({SIG}), b as (select *, case when source_type in ('SYSLOG_MAC_FLAP', 'SYSLOG_MANAGEMENT_ACCESS') or source_type is null then 'medium' when source_type = 'SYSLOG_CLOCK_UNRELIABLE' then 'low' else 'high' end as q from s)
        select signal_id, round(case q when 'high' then 0.9 when 'medium' then 0.7 else 0.5 end * case when clock_unreliable then 0.6 else 1 end * case when entity_confident then 1 else 0.85 end, 6) as confidence,
        case when clock_unreliable then 'low' when not entity_confident and q = 'high' then 'medium' else q end as band, concat_ws(';', case when clock_unreliable then 'timestamps unreliable' end, case when not entity_confident then 'device/interface identity incomplete' end) as notes from b"""),
    "cor_canonical_iface": Case(lambda s, d: bind(s, d, IF_BIND).select("event_id", sg.canonical_iface(F.col("n")).alias("c")),
        "select event_id, case event_id % 9 when 0 then 'gi0/' when 1 then 'gi0/' when 2 then 'te' when 3 then 'fa0/' when 4 then 'eth' when 5 then 'po' when 6 then 'vlanif' when 7 then 'gi' else 'weirdname' end || cast(user_id % 4 as varchar) as c from events"),
    "cor_match_entities": Case(lambda s, d: bind(s, d, PAIR_BIND).select("i", "k", sg.match_entities(F.col("da"), F.col("ia"), F.col("db"), F.col("ib")).alias("m")), PAIR_SQL),
    "cor_rule_saturation": _rule(inc.rule_saturation, "m_sat"),
    "cor_rule_link_degradation": Case(lambda s, d: inc.rule_link_degradation(inc.classify(_no_attack(s, d))).rows().select("run_id", "rule_id", "key", "signal_id"), CTE.replace(SIG, QUIET) + "select run_id, rule_id, key, signal_id from m_link"),
    "cor_evidence_items": Case(_items, CTE + "select fin.run_id, rule_id, key, c.engine, signal_id, c.title, c.source_artifact from fin join mem using (run_id, rule_id, key) join c using (run_id, signal_id) where fin.severity = 'critical'"),
    "cor_rule_exposure": _rule(inc.rule_exposure, "m_exp"),
    "cor_rule_vlan_risk": _rule(inc.rule_vlan_risk, "m_vlan"),
    "cor_rule_auth_campaign": _rule(inc.rule_auth_campaign, "m_auth"),
    "cor_rule_port_instability": _rule(inc.rule_port_instability, "m_port"),
    "cor_rule_loop": _rule(inc.rule_loop, "m_loop"),
    "cor_rule_duplicate_ip": _rule(inc.rule_duplicate_ip, "m_dup"),
    "cor_rule_poe": _rule(inc.rule_poe, "m_poe"),
    "cor_rule_mgmt_exposure": _rule(inc.rule_mgmt_exposure, "m_mgmt"),
    "cor_rule_clock": _rule(inc.rule_clock, "m_clock"),
    "cor_rule_uncovered": Case(_uncovered, CTE + "select run_id, rule_id, key, signal_id from m_free"),
    "cor_incident_severity": _incidents("severity", "n_signals"),
    "cor_incident_confidence": _incidents("confidence", "n_engines", "aggregate_only"),
    "cor_incident_evidence": Case(_evidence, CTE + "select mx.run_id, rule_id, key, engine, count(*) as signals, count(distinct title) as titles, min(title) as first_title, count(distinct source_artifact) as artifacts from mx join c on mx.run_id = c.run_id and mx.signal_id = c.signal_id group by all"),
    "cor_incident_quality": _incidents("time_reliability", "entity_match"),
    "cor_correlate": _incidents("severity", "confidence", "n_engines", "n_signals", "syslog_signals", "aggregate_only", "low_evidence", "unsure_entities", "time_reliability", "entity_match"),
    "cor_summary": Case(lambda s, d: inc.summarize_incidents(inc.correlate(sig(s, d))[0]), CTE + """select run_id, 'severity' as dimension, severity as value, count(*) as n from fin group by all union all select run_id, 'rule_id', rule_id, count(*) from fin group by all
        union all select run_id, 'multi_engine', cast(n_engines > 1 as varchar), count(*) from fin group by all union all select run_id, 'has_log_evidence', cast(syslog_signals > 0 as varchar), count(*) from fin group by all"""),
}
