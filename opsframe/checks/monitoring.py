"""Queries for vendor events, the event table, monitoring state and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import Case, bind
from opsframe.checks.fleet import FIND
from opsframe.checks.logs import _features, findings_cte, windows_cte
from opsframe.checks.incidents import log_findings
from opsframe.functions import intervals as itv
from opsframe.functions import scalars as sc
from opsframe.operators import monitoring as mon
from opsframe.operators import vendor as vd
from opsframe.operators import windows as win

KV = """select event_id as ord, case when event_id % 20 = 0 then 'no pairs here' when event_id % 20 = 1 then '  ' else '<14>2024-01-01 10:00:00 fw1 log_subtype=' || case event_id % 3 when 0 then 'Denied' when 1 then 'IPS' else '"Web Filter"' end
 || ' src_ip=10.0.0.' || cast(user_id % 200 as string) || case when event_id % 4 = 0 then '' else ' dst_ip="10.1.0.1"' end || ' priority=' || event_type || case when event_id % 7 = 0 then ' message="blocked flow"' else '' end || ' log_id=L' || cast(event_id as string) end as line from events"""
TRAP = """select event_id as ord, case when event_id % 10 = 0 then '# note' when event_id % 10 = 1 then 'broken' else '2024-01-01T00:00:00Z 10.0.0.' || cast(user_id % 200 as string) || ' ' ||
 case event_id % 5 when 0 then 'linkDown' when 1 then 'hmTemperature' when 2 then 'coldStart' else 'vendorThing' end || ' sysName=sw' || cast(user_id % 9 as string) || case when event_id % 3 = 0 then ' ifName=1/' || cast(user_id % 8 as string) else '' end
 || case when event_id % 6 = 0 then ' severity=low' else '' end end as line from events"""
ALERT = """select event_id as ord, '{"id": "' || cast(event_id as string) || '", "type": "' || case event_id % 4 when 0 then 'Event::Endpoint::Threat::X' when 1 then 'Event::Endpoint' when 2 then 'Event::Web' else 'Other' end || '"' ||
 case when event_id % 5 = 0 then ', "category": "General"' else '' end || case when event_id % 3 = 0 then ', "description": "d' || cast(user_id as string) || '"' else '' end || ', "source_info": {"ip": "1.2.3.' || cast(user_id % 9 as string) || '"}, "severity": "high"}' as json from events"""
READ = """select event_id, 'sw' || cast(user_id % 20 as string) as device_id, case when event_id % 4 = 0 then null else '1/' || cast(user_id % 8 as string) end as interface, cast(event_id as string) as timestamp, case when event_id % 13 = 0 then 'False' else 'true' end as reachable,
 case when event_id % 5 = 0 then 'DOWN' else 'up' end as if_oper_status, cast(event_id % 130 as string) as in_errors, cast(event_id % 97 as string) as utilization, case when event_id % 6 = 0 then 'n/a' else cast(event_id % 90 as string) end as temperature_c,
 case when event_id % 9 = 0 then 'failed' when event_id % 9 = 1 then null else 'OK' end as power_supply_1 from events"""
TEXT = "select doc_id, 'password: hunter' || cast(doc_id % 9 as string) || ' and token=abc123 then bearer x.y-z end. ' || lang as note, 'zz' || cast(doc_id as string) as api_key, source from documents"
EV = f"""select finding_id as event_id, case when rule_id like 'TRUNK%' then 'correlation_incident' when rule_id like 'STP%' then 'topology_warning' else 'config_finding' end as event_type, case when cast(substr(finding_id, 2) as bigint) % 4 = 0 then 'syslog' else 'engine_c' end as source_engine,
 severity, 'title ' || rule_id as title, case when cast(substr(finding_id, 2) as bigint) % 7 = 0 then null else '2024-01-' || cast(10 + cast(substr(finding_id, 2) as bigint) % 19 as string) end as timestamp, device as device_id, 'I' || cast(cast(substr(finding_id, 2) as bigint) % 50 as string) as incident_id,
 case cast(substr(finding_id, 2) as bigint) % 6 when 0 then 'snmp_auth' when 1 then 'poe' when 2 then 'loop_redundancy' when 3 then 'port_instability' else 'other' end as log_category, cast(substr(finding_id, 2) as bigint) % 3 = 0 as has_log_evidence, cast(substr(finding_id, 2) as bigint) as ord from ({FIND}) f"""
INC = """select 'I' || cast(o_orderkey as string) as incident_id, o_orderkey as ord, case o_orderkey % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity, cast(o_orderkey % 10 as double) / 10 as confidence, o_orderpriority as title, o_orderstatus as rule_id,
 split(case when o_orderkey % 3 = 0 then 'a;b' else 'c' end, ';') as engines, split('sw' || cast(o_custkey % 40 as string) || ';sw' || cast(o_custkey % 7 as string), ';') as devices, 'cause ' || cast(o_custkey % 9 as string) as cause, split('act' || cast(o_custkey % 11 as string), ';') as actions from orders"""
HEALTH = "select 'ds' || cast(c_nationkey as string) as dataset, c_name as experiment_id, c_custkey % 50 as n_samples, c_custkey % 7 as n_anomalous from customer"
RUNS = "select c_name as run_id, 'ds' || cast(c_nationkey % 4 as string) as dataset, case when c_custkey % 6 = 0 then null else '2024-01-' || cast(10 + c_custkey % 19 as string) end as created_at from customer"


def b(sql):
    return lambda s, d: bind(s, d, sql)


kv, trap, alert, reading, ev, incs, health, runs = map(b, (KV, TRAP, ALERT, READ, EV, INC, HEALTH, RUNS))
NORM = f"""select source_type, source_key from (select 'x' as source_type, case event_id % 5 when 0 then 'sophos_api' when 1 then 'hirschmann_traps' when 2 then 'hirschmann_config' when 3 then 'nowhere' else '' end as source_key from events) e"""


def _records(s, d):
    return vd.parse_kv_syslog(kv(s, d))[0].withColumn("message", F.when(F.col("ord") % 9 == 0, "").otherwise(F.col("message"))).withColumn("hostname", F.lit("  "))


KV_CTE = f"""with k as ({KV}), r as (select ord, 'Firewall ' || case ord % 3 when 0 then 'Denied' when 1 then 'IPS' else 'Web Filter' end || ': 10.0.0.' || regexp_extract(line, 'src_ip=10.0.0.([0-9]+)', 1) || ' -> ' || case when ord % 4 = 0 then '?' else '10.1.0.1' end as made,
 case ord % 3 when 0 then 'firewall' when 1 then 'ips' else 'web_filter' end as category, regexp_extract(line, 'priority=([a-z]+)', 1) as severity, '2024-01-01 10:00:00' as "timestamp", 'L' || cast(ord as varchar) as raw_ref from k where ord % 20 > 1),
q as (select *, case when ord % 7 = 0 then 'blocked flow' else made end as message from r)"""
CATALOG = "select case event_type when 'error' then 'Error ' when 'click' then '3' when 'view' then 'weird' when 'signup' then null else 'Warn' end as w, event_id from events"
FUN = """select event_id, case event_id % 6 when 0 then '1,10-12' when 1 then '5-3,7' when 2 then 'x,4' when 3 then ' 2 - 4 , 3 ' when 4 then null else '100,5000,4999-5001' end as r,
 case event_id % 5 when 0 then '2024-03-01T10:20:30Z' when 1 then '2024-03-01 10:20:30' when 2 then 'nope' when 3 then '2024-03-01T10:20:30+05:30' else '' end as t, case event_id % 3 when 0 then ' ' when 1 then ' a ' end as o, 'If-In  Octets(' || event_type || ')' as n from events"""
WIDE = "select event_id, case event_id % 3 when 0 then '1,5-2000000,7' when 1 then '7-9,5-8' else null end as r from events"


def _intervals(s, d):
    """Every set is parsed once and serves all functions."""
    sets = bind(s, d, WIDE).select("event_id", itv.parse(F.col("r")).alias("p"), itv.parse(F.lit("7-9,100-200")).alias("q"))
    p = F.col("p")
    return sets.select("event_id", itv.text(p).alias("v"), itv.count(p).alias("n"), itv.text(itv.difference(p, F.col("q"))).alias("less"), itv.contains(p, F.lit(1999999)).alias("has"))


CASES = {
    "evt_kv_syslog": Case(lambda s, d: vd.parse_kv_syslog(kv(s, d))[0].select("ord", "category", "severity", "message", "timestamp", "raw_ref", F.element_at("correlation_keys", "dst_ip").alias("dst")),
        KV_CTE + " select ord, category, severity, message, \"timestamp\", raw_ref, case when ord % 4 <> 0 then '10.1.0.1' end as dst from q"),
    "evt_kv_errors": Case(lambda s, d: vd.parse_kv_syslog(kv(s, d))[1], f"with k as ({KV}) select ord, 'no fields' as error, line from k where ord % 20 = 0"),
    "evt_traps": Case(lambda s, d: vd.parse_traps(trap(s, d))[0].select("ord", "category", "subcategory", "severity", "message", "hostname"),
        f"""with k as ({TRAP}), r as (select ord, regexp_extract(line, ' (10[0-9.]+) ', 1) as ip, ord % 5 as k, regexp_extract(line, 'sysName=(sw[0-9]+)', 1) as hostname, nullif(regexp_extract(line, 'ifName=([0-9/]+)', 1), '') as i, ord % 6 = 0 as lo from k where ord % 10 > 1)
        select ord, case k when 0 then 'interface' when 1 then 'environment' else 'system' end as category, case k when 0 then 'port_down' when 1 then 'temperature' when 2 then 'restart' else 'vendorthing' end as subcategory, case when lo then 'low' when k = 1 then 'high' else 'medium' end as severity,
        'Trap ' || case k when 0 then 'linkDown' when 1 then 'hmTemperature' when 2 then 'coldStart' else 'vendorThing' end || ' from ' || ip || coalesce(' on ' || i, '') as message, hostname from r"""),
    "evt_trap_errors": Case(lambda s, d: vd.parse_traps(trap(s, d))[1], f"with k as ({TRAP}) select ord, 'no trap' as error, line from k where ord % 10 = 1"),
    "evt_alert_json": Case(lambda s, d: vd.parse_alert_json(alert(s, d)).select("ord", "category", "subcategory", "message", "device_ip", "raw_ref", "severity"),
        """select event_id as ord, case when event_id % 5 = 0 then 'general' else case event_id % 4 when 0 then 'antivirus' when 1 then 'endpoint' when 2 then 'web_filter' else 'security' end end as category, case event_id % 4 when 0 then 'Event::Endpoint::Threat::X' when 1 then 'Event::Endpoint' when 2 then 'Event::Web' else 'Other' end as subcategory,
        case when event_id % 3 = 0 then 'd' || cast(user_id as varchar) else case event_id % 4 when 0 then 'Event::Endpoint::Threat::X' when 1 then 'Event::Endpoint' when 2 then 'Event::Web' else 'Other' end end as message, '1.2.3.' || cast(user_id % 9 as varchar) as device_ip, cast(event_id as varchar) as raw_ref, 'high' as severity from events"""),
    "evt_metric_events": Case(lambda s, d: vd.metric_events(reading(s, d)).select("device_id", "interface", "category", "subcategory", "severity", "raw_ref"),
        f"""with r as ({READ}) select device_id, interface, 'availability' as category, 'device_unreachable' as subcategory, 'high' as severity, device_id || ':unreachable:' || "timestamp" as raw_ref from r where reachable = 'False'
        union all select device_id, interface, 'interface', 'port_down', 'medium', device_id || ':' || interface || ':port_down:' || "timestamp" from r where interface is not null and if_oper_status = 'DOWN'
        union all select device_id, interface, 'interface', 'high_error_rate', 'high', device_id || ':' || interface || ':in_errors:' || "timestamp" from r where interface is not null and cast(in_errors as double) > 100
        union all select device_id, interface, 'interface', 'high_utilization', 'medium', device_id || ':' || interface || ':utilization:' || "timestamp" from r where interface is not null and cast(utilization as double) > 90
        union all select device_id, interface, 'environment', 'temperature', case when try_cast(temperature_c as double) >= 80 then 'high' else 'medium' end, device_id || ':temperature:' || "timestamp" from r where try_cast(temperature_c as double) >= 70
        union all select device_id, interface, 'power', 'power_supply', 'high', device_id || ':power_supply_1:' || "timestamp" from r where power_supply_1 = 'failed'"""),
    "evt_heartbeats": Case(lambda s, d: vd.heartbeats(reading(s, d)).select("device_id", "timestamp", "message"), f"with r as ({READ}) select device_id, \"timestamp\", 'SNMP poll OK for ' || device_id as message from r where reachable <> 'False'"),
    "evt_normalize": Case(lambda s, d: vd.normalize_events(_records(s, d))[0].select("event_id", "severity", "engine_target", "hostname", "source_name"),
        KV_CTE + """ select 'evt_' || substr(sha256('sophos_syslog|' || raw_ref || '|' || "timestamp" || '|' || message), 1, 16) as event_id, case severity when 'error' then 'high' else severity end as severity, 'cyber' as engine_target, null as hostname, 'sophos_firewall' as source_name from q where ord % 9 <> 0"""),
    "evt_rejects": Case(lambda s, d: vd.normalize_events(_records(s, d))[1].select("ord", F.array_join("missing", ";").alias("missing")), KV_CTE + " select ord, 'message' as missing from q where ord % 9 = 0"),
    "evt_normalize_severity": Case(lambda s, d: bind(s, d, CATALOG).groupBy(vd.normalize_severity(F.col("w")).alias("level"), vd.event_severity_rank(vd.normalize_severity(F.col("w"))).alias("rank")).agg(F.count(F.lit(1)).alias("n")),
        "with x as (select case event_type when 'error' then 'high' when 'click' then 'unknown' when 'view' then 'weird' when 'signup' then 'unknown' else 'medium' end as level from events) select level, case level when 'high' then 1 when 'medium' then 2 when 'unknown' then 5 else 6 end as rank, count(*) as n from x group by level"),
    "evt_route": Case(lambda s, d: bind(s, d, NORM).groupBy(vd.route(F.col("source_key"), {"nowhere": "invalid"}).alias("target")).agg(F.count(F.lit(1)).alias("n")),
        "select case event_id % 5 when 0 then 'cyber' when 1 then 'network_health' when 2 then 'network_config' else 'unknown' end as target, count(*) as n from events group by 1"),
    "evt_redact": Case(lambda s, d: vd.redact(bind(s, d, TEXT), ["end."]).select("doc_id", "note", "api_key", "source"),
        "select doc_id, 'password:  ***REDACTED*** and token= ***REDACTED*** then bearer ***REDACTED*** ***REDACTED*** ' || lang as note, '***REDACTED***' as api_key, source from documents"),
    "evt_leak_audit": Case(lambda s, d: vd.leak_audit(vd.redact(bind(s, d, TEXT)), ["hunter", "abc123", "password", "zz1"]),
        "select n.* from (select count(*) as c from documents) x, (values ('hunter', false), ('abc123', false), ('password', true), ('zz1', false)) n(needle, leaked) where c > 0"),
    "evt_counts": Case(lambda s, d: mon.count_dimensions(vd.parse_kv_syslog(kv(s, d))[0], ["category", "severity", "source_vendor"]),
        KV_CTE + " select 'category' as dimension, category as value, count(*) as n from q group by all union all select 'severity', severity, count(*) from q group by all union all select 'source_vendor', 'sophos', count(*) from q group by all"),
    "evt_source_health": Case(lambda s, d: vd.source_health(bind(s, d, "select s_name as source, case s_suppkey % 4 when 0 then 'failed' when 1 then 'disabled' else 'ok' end as status, case when s_suppkey % 8 = 2 then 'auth' end as error_category from supplier")),
        "select count(*) as sources, count_if(s_suppkey % 4 > 1) as ok, count_if(s_suppkey % 4 = 0) as failed, count_if(s_suppkey % 4 = 1) as disabled, count_if(s_suppkey % 4 = 0 or s_suppkey % 8 = 2) as failures, count_if(s_suppkey % 4 = 0) = 0 as healthy from supplier"),
    "evt_checkpoint_age": Case(lambda s, d: vd.checkpoint_age(bind(s, d, "select cast(event_id as string) as source, ts as updated_at, user_id as event_count from events"), F.lit("2024-02-01 00:00:00")),
        "select cast(event_id as varchar) as source, cast(epoch(timestamp '2024-02-01') - floor(epoch(ts)) as bigint) as age_seconds, user_id as event_count from events"),
    "str_to_events": Case(lambda s, d: mon.to_stream_events({"findings": bind(s, d, FIND).withColumn("title", F.col("rule_id")), "log_findings": log_findings(s, d)}).select("event_id", "event_type", "source_engine", "severity", "entity_type", "entity_id", "log_category"),
        findings_cte() + f""" select 'EVT-' || substr(sha1('config_finding|engine_c|' || finding_id || '|' || rule_id || '|'), 1, 10) as event_id, 'config_finding' as event_type, 'engine_c' as source_engine, severity, case when interface is null then 'device' else 'interface' end as entity_type, coalesce(interface, device) as entity_id, null as log_category from ({FIND})
        union all select 'EVT-' || substr(sha1(case when category = 'security' then 'cyber_alert' when category in ('loop', 'topology') then 'topology_warning' else 'config_finding' end || '|syslog|' || finding_id || '|' || title || '|'), 1, 10), case when category = 'security' then 'cyber_alert' when category in ('loop', 'topology') then 'topology_warning' else 'config_finding' end,
         'syslog', severity, case when interface is null then 'device' else 'interface' end, coalesce(interface, device), case rule_id when 'SYS-SNMP-AUTHFAIL' then 'snmp_auth' when 'SYS-PORT-FLAP' then 'port_instability' when 'SYS-MAC-FLAP' then 'loop_redundancy' when 'SYS-ERPS-CHURN' then 'loop_redundancy' when 'SYS-ARP-FAST' then 'duplicate_ip'
         when 'SYS-POE-FAULT' then 'poe' when 'SYS-TELNET' then 'management_access' else 'device_health' end from fnd"""),
    "str_order_events": Case(lambda s, d: mon.order_events(ev(s, d)).select("event_id", "seq"), f"with e as ({EV}) select event_id, row_number() over (order by \"timestamp\" nulls last, ord) - 1 as seq from e"),
    "str_monitoring_counts": Case(lambda s, d: mon.monitoring_counts(ev(s, d)), f"with e as ({EV}) select 'event_type' as dimension, event_type as value, count(*) as n from e group by all union all select 'severity', severity, count(*) from e group by all union all select 'source_engine', source_engine, count(*) from e group by all"),
    "str_monitoring_state": Case(lambda s, d: mon.monitoring_state(ev(s, d)), f"""with e as ({EV}), i as (select incident_id, arg_max(severity, ord) as sv from e where event_type = 'correlation_incident' group by 1)
        select count(*) as total_events, min("timestamp") as first_at, max("timestamp") as last_at, count(distinct device_id) as active_devices, (select count(*) from i) as active_incidents, (select count_if(sv in ('critical', 'high')) from i) as critical_incidents from e"""),
    "str_log_state": Case(lambda s, d: mon.log_state(ev(s, d)), f"""with e as ({EV}), l as (select * from e where source_engine = 'syslog'), c as (select log_category as k, count(*) as n from l group by 1)
        select 'category_' || k as metric, n from (select * from c order by n desc, k limit 8) union all select 'auth_activity', coalesce(sum(n) filter (k in ('snmp_auth', 'management_access')), 0) from c union all select 'port_instability', coalesce(sum(n) filter (k = 'port_instability'), 0) from c
        union all select 'loop_candidates', coalesce(sum(n) filter (k = 'loop_redundancy'), 0) from c union all select 'duplicate_ip', coalesce(sum(n) filter (k = 'duplicate_ip'), 0) from c union all select 'poe_faults', coalesce(sum(n) filter (k = 'poe'), 0) from c
        union all select 'log_events', count(*) from l union all select 'log_findings', count_if(event_type in ('config_finding', 'topology_warning', 'cyber_alert')) from l union all select 'clock_degraded', 0 union all select 'incidents_with_log_evidence', count_if(has_log_evidence) from e where event_type = 'correlation_incident'"""),
    "str_recent": Case(lambda s, d: mon.recent(ev(s, d), 20, "ord").select("event_id"), f"with e as ({EV}) select event_id from e order by ord desc limit 20"),
    "str_label_events": Case(
        lambda s, d: mon.label_events(win.summarize_windows(_features(s, d)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"pos_{c}").alias("windows")) for c in win.LABELS])).alias("p")).select(F.lit("r1").alias("run_id"), "p.*")).select("event_id", "severity", "title"),
        windows_cte(5) + ", p as (" + " union all ".join(f"select '{c}' as label, count_if({c}) as n from wl" for c in win.LABELS) + ") select 'EVT-' || substr(sha1('health_anomaly|syslog|r1|' || label || '|'), 1, 10) as event_id, case when n >= 20 then 'high' when n >= 5 then 'medium' else 'low' end as severity, 'Syslog weak label: ' || label as title from p where n > 0"),
    "ops_overview": Case(lambda s, d: mon.overview(incs(s, d), bind(s, d, FIND), bind(s, d, "select case when o_orderkey % 2 = 0 then 'planned' else 'x' end as status from orders"), bind(s, d, "select * from region"), mon.latest_health(health(s, d))).withColumn("anomaly_rate", F.round("anomaly_rate", 6)),
        f"""with h as (select dataset, arg_max(n_anomalous, experiment_id) as a, arg_max(n_samples, experiment_id) as n from ({HEALTH}) group by 1), r as (select dataset, case when n = 0 then 0 else a / n end as q from h)
        select (select count(*) from orders) as incidents, (select count_if(o_orderkey % 4 < 2) from orders) as high_critical, (select count(*) from ({FIND})) as findings, (select count_if(o_orderkey % 2 = 0) from orders) as planned_actions, (select count(*) from region) as production_models,
        (select dataset from r order by q desc, dataset desc limit 1) as headline_dataset, (select round(max(q), 6) from r) as anomaly_rate, 'attention' as status"""),
    "ops_executive_summary": Case(lambda s, d: mon.executive_summary(incs(s, d)), f"""with i as (select * from ({INC}) where severity in ('critical', 'high')), v as (select 'device' as kind, ord, generate_subscripts(devices, 1) as i, unnest(devices) as value from i union all select 'cause', ord, 0, cause from i union all select 'action', ord, 0, actions[1] from i),
        f as (select kind, value, min(ord * 10 + i) as pos0 from v group by all), p as (select kind, value, row_number() over (partition by kind order by pos0, value) as position from f) select * from p where position <= case kind when 'device' then 12 when 'cause' then 5 else 6 end"""),
    "ops_network_status": Case(lambda s, d: incs(s, d).select("incident_id", mon.network_status(F.col("ord") % 3, F.col("ord") % 2, F.lit(False)).alias("status")), "select 'I' || cast(o_orderkey as varchar) as incident_id, case when o_orderkey % 3 > 0 then 'attention' when o_orderkey % 2 > 0 then 'monitor' else 'stable' end as status from orders"),
    "ops_count_by": Case(lambda s, d: mon.count_by(bind(s, d, FIND), "interface"), f"select coalesce(interface, 'unknown') as value, count(*) as n from ({FIND}) group by 1"),
    "ops_distinct_values": Case(lambda s, d: mon.distinct_values(bind(s, d, FIND)), f"""with f as ({FIND}), s as (select distinct severity as v, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as k from f), r as (select distinct rule_id as v from f)
        select 'severity' as kind, v as value, row_number() over (order by k) as position from s union all select 'rule_id', v, row_number() over (order by v) from r"""),
    "ops_list_runs": Case(lambda s, d: mon.list_runs(runs(s, d), ["dataset"]), f"with r as ({RUNS}) select *, row_number() over (partition by dataset order by created_at desc nulls last, run_id desc) as position, row_number() over (partition by dataset order by created_at desc nulls last, run_id desc) = 1 as latest from r"),
    "ops_incident_rows": Case(lambda s, d: mon.incident_rows(incs(s, d)), f"select incident_id, severity, round(confidence, 2) as confidence, title, array_to_string(engines, ', ') as engines, array_to_string(devices, ', ') as devices from ({INC})"),
    "prj_filter_incidents": Case(lambda s, d: __import__("opsframe.operators.tables", fromlist=["x"]).filter_incidents(incs(s, d), ["critical", "low"], ["F", "O"]).select("incident_id", "severity_rank"), f"select incident_id, case severity when 'critical' then 0 else 3 end as severity_rank from ({INC}) where severity in ('critical', 'low') and rule_id in ('F', 'O')"),
    "ops_latest_health": Case(lambda s, d: mon.latest_health(health(s, d)).withColumn("anomaly_rate", F.round("anomaly_rate", 6)),
        f"""with r as (select dataset, max(experiment_id) as experiment_id, arg_max(n_samples, experiment_id) as n_samples, arg_max(n_anomalous, experiment_id) as n_anomalous from ({HEALTH}) group by 1), q as (select *, case when n_samples = 0 then 0 else n_anomalous / n_samples end as a from r)
        select dataset, experiment_id, n_samples, n_anomalous, round(a, 6) as anomaly_rate, dataset = (select dataset from q order by a desc, dataset limit 1) as headline from q"""),
    "ops_production_models": Case(
        lambda s, d: mon.production_models(bind(s, d, "select 'd' || cast(c_custkey as string) as dataset, c_mktsegment as model_type, c_name as experiment_id from customer"), bind(s, d, "select 'd' || cast(c_custkey as string) as dataset, c_acctbal as value from customer where c_custkey % 2 = 0"),
                                           bind(s, d, "select 'd' || cast(c_custkey as string) as dataset, c_mktsegment as model_type, c_name as experiment_id, c_custkey % 10 as roc_auc from customer where c_custkey % 3 = 0")),
        "select 'd' || cast(c_custkey as varchar) as dataset, c_mktsegment as model_type, c_name as experiment_id, case when c_custkey % 2 = 0 then c_acctbal end as test_f1, case when c_custkey % 3 = 0 then c_custkey % 10 end as roc_auc from customer"),
    "fun_digest_id": Case(lambda s, d: bind(s, d, FUN).select("event_id", sc.digest_id("X", 10, "r", "o").alias("a"), sc.digest_id("Y", 8, "r", "o", algo="sha256", null_text="None").alias("b")),
        f"with f as ({FUN}) select event_id, 'X-' || substr(sha1(coalesce(r, '') || '|' || coalesce(o, '')), 1, 10) as a, 'Y-' || substr(sha256(coalesce(r, 'None') || '|' || coalesce(o, 'None')), 1, 8) as b from f"),
    "fun_opt_num_snake": Case(lambda s, d: bind(s, d, FUN).select("event_id", sc.opt("o").alias("o"), sc.num("r").alias("num"), sc.snake("n").alias("n")),
        f"with f as ({FUN}) select event_id, nullif(trim(o), '') as o, try_cast(r as double) as num, 'if_in_octets_' || regexp_extract(n, '\\((.*)\\)', 1) as n from f"),
    "fun_severity_rank": Case(lambda s, d: bind(s, d, FIND).select("finding_id", sc.severity_rank("severity").alias("a"), sc.severity_rank("category").alias("b"), sc.severity_rank("severity", sc.LOG_SEVERITY_RANK).alias("c")),
        f"select finding_id, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as a, 5 as b, case severity when 'critical' then 2 when 'info' then 6 else 9 end as c from ({FIND})"),
    "fun_parse_humanize": Case(lambda s, d: bind(s, d, FUN).select("event_id", F.date_format(sc.parse_iso("t"), "yyyy-MM-dd HH:mm:ss").alias("p"), sc.humanize("t").alias("h")),
        "select event_id, case event_id % 5 when 0 then '2024-03-01 10:20:30' when 1 then '2024-03-01 10:20:30' when 3 then '2024-03-01 04:50:30' end as p, case event_id % 5 when 0 then '2024-03-01 10:20 UTC' when 1 then '2024-03-01 10:20 UTC' when 2 then 'nope' when 3 then '2024-03-01 04:50 UTC' else '' end as h from events"),
    "fun_vlan_sort": Case(lambda s, d: bind(s, d, "select event_id, split(cast(event_id % 500 as string) || ',9,x,10,' || cast(user_id as string), ',') as v from events").select("event_id", F.array_join(sc.sort_vlans(F.col("v")), ",").alias("v")),
        "with e as (select event_id, unnest([event_id % 500, 9, 10, user_id]) as v from events) select event_id, string_agg(cast(v as varchar), ',' order by v) || ',x' as v from e group by event_id"),
    "fun_expand_ranges": Case(lambda s, d: bind(s, d, FUN).select("event_id", F.array_join(F.transform(sc.expand_ranges("r"), lambda x: x.cast("string")), ",").alias("v")),
        "select event_id, case event_id % 6 when 0 then '1,10,11,12' when 1 then '7' when 2 then '4' when 3 then '2,3,4' when 4 then '' else '100,4999,5000,5001' end as v from events"),
    "fun_expand_list": Case(lambda s, d: bind(s, d, FUN.replace("'x,4'", "'ALL,none,4'")).select("event_id", F.array_join(sc.expand_list("r"), ",").alias("v")),
        "select event_id, case event_id % 6 when 0 then '1,10,11,12' when 1 then '7' when 2 then 'ALL,none,4' when 3 then '2 - 4,3' when 4 then '' else '100,5000,4999,5000,5001' end as v from events"),
    "fun_intervals": Case(_intervals,
        """select event_id, case event_id % 3 when 0 then '1,5-2000000' when 1 then '5-9' else '' end as v, case event_id % 3 when 0 then 1999997 when 1 then 5 else 0 end as n,
        case event_id % 3 when 0 then '1,5-6,10-99,201-2000000' when 1 then '5-6' else '' end as less, event_id % 3 = 0 as has from events"""),
    "fun_top_counts": Case(lambda s, d: mon.count_by(bind(s, d, FIND), "device").orderBy(F.desc("n"), "value").limit(5), f"select device as value, count(*) as n from ({FIND}) group by 1 order by n desc, value limit 5"),
    "fun_as_text": Case(lambda s, d: bind(s, d, INC).select("incident_id", sc.as_text("devices", True).alias("d"), sc.as_text("ord").alias("o")), f"select incident_id, array_to_string(devices, ';') as d, cast(ord as varchar) as o from ({INC})"),
}
