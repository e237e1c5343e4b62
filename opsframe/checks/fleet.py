"""Queries for topology, policy, snapshot comparison and risk over derived inventory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import Case, bind
from opsframe.operators import policy as pol
from opsframe.operators import risk as rk
from opsframe.operators import snapshots as sn
from opsframe.operators import topology as tp

P = "'s' || cast(p_partkey % 2 as string) as snapshot_id, 'Sw' || cast(p_partkey % 15 as string) as device"
INTERFACES = f"""select {P}, 'Gi0/' || cast(p_partkey as string) as name, case p_partkey % 5 when 0 then 'connected' when 1 then 'notconnect' when 2 then 'disabled' else 'connected' end as status,
 case when p_partkey % 7 = 0 then null else cast(p_size as string) end as vlan, case p_partkey % 3 when 0 then 'access' when 1 then 'trunk' else 'routed' end as mode, p_type as description,
 case p_partkey % 4 when 0 then true when 1 then false end as poe_enabled, case p_partkey % 6 when 0 then 'on' when 1 then 'off' end as poe_state from part"""
TRUNKS = """select 's' || cast(c_custkey % 2 as string) as snapshot_id, 'Sw' || cast(c_custkey % 15 as string) as device, 'Gi0/' || cast(c_custkey as string) as interface,
 split(case c_custkey % 4 when 0 then '1,10' when 1 then '1,20,99' when 2 then '10,20,300' else '1,10,20' end, ',') as allowed_vlans,
 case c_custkey % 3 when 0 then '1' when 1 then '99' end as native_vlan, 'trunking' as trunking_status from customer"""
MACS = """select 's' || cast(l_partkey % 2 as string) as snapshot_id, 'Sw' || cast(l_partkey % 15 as string) as device, case when l_linenumber = 7 then '' else 'Gi0/' || cast(l_partkey as string) end as interface,
 'm' || cast(l_suppkey % 60 as string) as mac_address from lineitem"""
NEIGHBORS = """select 's' || cast(event_id % 2 as string) as snapshot_id, 'Sw' || cast(user_id % 6 as string) as device, 'GigabitEthernet0/' || cast(event_id % 3 as string) as local_interface,
 case when event_id % 5 = 0 then null else case when event_id % 7 = 0 then 'SW' || cast(event_id % 8 as string) || '.lab.example' else 'sw' || cast(event_id % 8 as string) end end as remote_device,
 case when event_id % 11 = 0 then null else 'Gi 0/' || cast(user_id % 3 as string) end as remote_interface, case when event_id % 4 = 0 and event_id % 3 <> 0 then 'cdp' else 'lldp' end as protocol, event_id as ord
 from events where event_type in ('click', 'view', 'error', 'purchase', 'signup')"""
STP = f"select {P}, case when p_partkey % 4 = 0 then 'gigabitethernet0/' else 'Gi0/' end || cast(p_partkey as string) as interface, cast(p_size as string) as vlan, 'altn' as role, case p_partkey % 3 when 0 then 'blocking' else 'forwarding' end as state from part where p_partkey % 10 < 7"
POE = f"select {P}, 'Gi0/' || cast(p_partkey as string) as interface, case p_partkey % 3 when 0 then 'auto' when 1 then 'never' else '' end as admin_state, case p_partkey % 5 when 0 then 'on' else 'off' end as oper_state from part where p_partkey % 2 = 0"
DEVICES = f"select {P}, max('h') as hostname, max('10.0.0.1') as management_ip from part group by 1, 2"
FIND = """select 's' || cast(o_orderkey % 2 as string) as snapshot_id, 'F' || cast(o_orderkey as string) as finding_id,
 case o_orderkey % 6 when 0 then 'UNUSED_PORT_ADMIN_UP' when 1 then 'TRUNK_MISSING_REQUIRED_VLAN' when 2 then 'TRUNK_UNAUTHORIZED_VLAN' when 3 then 'POE_DISABLED_EXPECTED' when 4 then 'STP_BLOCKING_ACCESS_PORT' else 'MAC_ON_MULTIPLE_INTERFACES' end as rule_id,
 case o_orderkey % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end as severity,
 case o_orderkey % 4 when 0 then 'security' when 1 then 'stp' when 2 then 'topology' else 'port' end as category, case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
 'Sw' || cast(o_custkey % 15 as string) as device, case when o_orderkey % 9 = 0 then null else 'Gi0/' || cast(o_custkey as string) end as interface, case when o_orderkey % 8 = 0 then cast(o_custkey % 30 as string) end as vlan,
 case when o_orderkey % 13 = 0 then 'suppressed' else 'open' end as status, split(case when o_orderkey % 2 = 0 then '10,20' else '99' end, ',') as vlans from orders"""
AFTER_FIND = FIND.replace("from orders", "from orders where o_orderkey % 10 <> 1").replace("when 3 then 'low'", "when 3 then 'high'")
PLAN = f"select 'A' || finding_id as action_id, *, case when finding_id like '%7' then 'investigation' else 'config' end as action_type from ({FIND.replace(chr(39) + 'suppressed' + chr(39), chr(39) + 'blocked' + chr(39)).replace(chr(39) + 'open' + chr(39), chr(39) + 'planned' + chr(39))}) f"
BEFORE = "select cast(o_custkey % 50 as string) as d, o_orderkey, o_orderstatus as st, split(o_orderpriority, '-') as pr, o_custkey % 7 as n from orders where o_orderkey % 10 <> 0"
AFTER = "select cast(o_custkey % 50 as string) as d, o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as st, split(case when o_orderkey % 9 = 0 then 'a-b' else o_orderpriority end, '-') as pr, case when o_orderkey % 21 = 0 then null else o_custkey % 7 end as n from orders where o_orderkey % 10 <> 1"

ND = "lower(trim(split_part(coalesce({c}, ''), '.', 1)))"
NI = "case when lower(replace(coalesce({c}, ''), ' ', '')) like 'gigabitethernet%' then 'gi' || substr(lower(replace({c}, ' ', '')), 16) else lower(replace(coalesce({c}, ''), ' ', '')) end"


def nd(c):
    return ND.replace("{c}", c)


def ni(c):
    return NI.replace("{c}", c)


GRAPH = f"""with nb as ({NEIGHBORS}), iface as ({INTERFACES}), tr as ({TRUNKS}), mac as ({MACS}), stp as ({STP}), dev as ({DEVICES}),
n1 as (select *, {nd('device')} as ld, {ni('local_interface')} as li from nb),
pt as (select snapshot_id, ld, li, arg_min(device, ord) as local_device, arg_min(local_interface, ord) as local_interface,
  (select m.remote_device from n1 m where m.snapshot_id = n1.snapshot_id and m.ld = n1.ld and m.li = n1.li and m.remote_device is not null order by length(m.remote_device) desc, ord limit 1) as remote_device,
  arg_min(remote_interface, ord) filter (remote_interface is not null) as remote_interface, list_sort(list_distinct(list(protocol))) as pr from n1 group by snapshot_id, ld, li),
pp as (select *, {nd('remote_device')} as rd, {ni('remote_interface')} as ri from pt),
ee as (select a.*, b.ld is not null and (a.ld <> a.rd or a.li <> a.ri) as bidirectional, b.pr as bpr from pp a left join pp b on a.snapshot_id = b.snapshot_id and a.rd = b.ld and a.ri = b.li and b.rd = a.ld and b.ri = a.li),
edge as (select snapshot_id, local_device, local_interface, remote_device, remote_interface, ld, li, rd, ri, bidirectional,
  array_to_string(case when bidirectional then list_sort(list_distinct(list_concat(pr, bpr))) else pr end, '+') as discovery_protocol from ee where not bidirectional or ld < rd or (ld = rd and li < ri)),
node as (select snapshot_id, {nd('device')} as node, device as node_id, 'local' as source from dev
  union all select snapshot_id, node, arg_min(remote_device, ord), arg_min(protocol, ord) from (select *, {nd('remote_device')} as node from nb) q where node <> '' and not exists (select 1 from dev where dev.snapshot_id = q.snapshot_id and {nd('dev.device')} = q.node) group by 1, 2),
tp as (select distinct snapshot_id, device, interface, {nd('device')} as ld, {ni('interface')} as li from (select snapshot_id, device, interface from tr union all select snapshot_id, device, name from iface where mode = 'trunk')),
ep as (select snapshot_id, ld, li from edge union select snapshot_id, rd, ri from edge where bidirectional),
acc as (select snapshot_id, device, name from iface where mode = 'access'),
mp as (select snapshot_id, device, interface, count(distinct mac_address) as n from mac where interface <> '' group by all),
ms as (select snapshot_id, device, mac_address, count(distinct interface) as n from mac where interface <> '' group by all having count(distinct interface) > 1),
w as (select snapshot_id, 'info' as severity, 'discovery' as category, device, li as interface from n1 group by snapshot_id, device, li having count(distinct protocol) = 1
    and (snapshot_id, device) in (select (snapshot_id, device) from nb group by snapshot_id, device having count(distinct protocol) = 2)
  union all select snapshot_id, 'warning', 'topology', local_device, local_interface from edge e where not bidirectional and rd <> ld and exists (select 1 from dev where dev.snapshot_id = e.snapshot_id and {nd('dev.device')} = e.rd)
  union all select snapshot_id, 'warning', 'topology', device, interface from tp where not exists (select 1 from ep where ep.snapshot_id = tp.snapshot_id and ep.ld = tp.ld and ep.li = tp.li)
  union all select mp.snapshot_id, 'warning', 'topology', mp.device, interface from mp join acc on mp.snapshot_id = acc.snapshot_id and mp.device = acc.device and mp.interface = acc.name where n > 15
  union all select snapshot_id, 'warning', 'loop_risk', device, null from ms
  union all select stp.snapshot_id, 'warning', 'stp', stp.device, interface from stp join acc on stp.snapshot_id = acc.snapshot_id and stp.device = acc.device and interface = acc.name where state = 'blocking'
  union all select snapshot_id, 'info', 'stp', device, interface from tp where not exists (select 1 from stp where stp.snapshot_id = tp.snapshot_id and stp.device = tp.device and {ni('stp.interface')} = tp.li))
"""


def b(sql):
    return lambda s, d: bind(s, d, sql)


iface, trunk, mac, nbr, stp, poe, dev, find, after_find, plan = map(b, (INTERFACES, TRUNKS, MACS, NEIGHBORS, STP, POE, DEVICES, FIND, AFTER_FIND, PLAN))
WCOLS = ["snapshot_id", "severity", "category", "device", "interface"]
CONFIG = {
    "ACCESS_PORT_DISALLOWED_VLAN": {"allowed_vlans": list(range(1, 41))}, "TRUNK_MISSING_REQUIRED_VLAN": {"required_vlans": [10, 20]},
    "TRUNK_UNAUTHORIZED_VLAN": {"authorized_vlans": [1, 10, 20]}, "NATIVE_VLAN_MISMATCH": {"expected_native_vlan": 1}, "ACCESS_PORT_TOO_MANY_MACS": {"threshold": 15, "severity": "high"},
    "POE_DISABLED_EXPECTED": {"expected_poe_keywords": ["o", "TIN"]}, "UNUSED_PORT_ADMIN_UP": {}, "STP_BLOCKING_ACCESS_PORT": {}, "MAC_ON_MULTIPLE_INTERFACES": {"enabled": False}, "TRUNK_WITHOUT_NEIGHBOR": {},
}
DCOLS = ["snapshot_id", "rule_id", "device", "interface", "vlan"]
RULE_SQL = {
    "ACCESS_PORT_DISALLOWED_VLAN": "select snapshot_id, 'ACCESS_PORT_DISALLOWED_VLAN' as rule_id, device, name as interface, vlan, '' as vlans from iface where mode = 'access' and vlan is not null and cast(vlan as int) > 40",
    "TRUNK_MISSING_REQUIRED_VLAN": "select snapshot_id, 'TRUNK_MISSING_REQUIRED_VLAN' as rule_id, device, interface, null as vlan, concat_ws(';', case when not list_contains(allowed_vlans, '10') then '10' end, case when not list_contains(allowed_vlans, '20') then '20' end) as vlans from tr where not (list_contains(allowed_vlans, '10') and list_contains(allowed_vlans, '20'))",
    "TRUNK_UNAUTHORIZED_VLAN": "select snapshot_id, 'TRUNK_UNAUTHORIZED_VLAN' as rule_id, device, interface, null as vlan, array_to_string(list_filter(allowed_vlans, lambda v: v not in ('1', '10', '20')), ';') as vlans from tr where len(list_filter(allowed_vlans, lambda v: v not in ('1', '10', '20'))) > 0",
    "NATIVE_VLAN_MISMATCH": "select snapshot_id, 'NATIVE_VLAN_MISMATCH' as rule_id, device, interface, native_vlan as vlan, '' as vlans from tr where native_vlan <> '1'",
    "ACCESS_PORT_TOO_MANY_MACS": "select mp.snapshot_id, 'ACCESS_PORT_TOO_MANY_MACS' as rule_id, mp.device, interface, null as vlan, '' as vlans from mp join acc on mp.snapshot_id = acc.snapshot_id and mp.device = acc.device and interface = name where n > 15",
    "POE_DISABLED_EXPECTED": "select snapshot_id, 'POE_DISABLED_EXPECTED' as rule_id, device, name as interface, null as vlan, '' as vlans from iface where (lower(description) like '%o%' or lower(description) like '%tin%') and (coalesce(poe_enabled, false) = false or (poe_state is not null and poe_state <> 'on'))",
    "UNUSED_PORT_ADMIN_UP": "select snapshot_id, 'UNUSED_PORT_ADMIN_UP' as rule_id, device, name as interface, null as vlan, '' as vlans from iface where status = 'notconnect'",
    "STP_BLOCKING_ACCESS_PORT": "select stp.snapshot_id, 'STP_BLOCKING_ACCESS_PORT' as rule_id, stp.device, interface, stp.vlan, '' as vlans from stp join acc on stp.snapshot_id = acc.snapshot_id and stp.device = acc.device and interface = name where state = 'blocking'",
    "MAC_ON_MULTIPLE_INTERFACES": "select snapshot_id, 'MAC_ON_MULTIPLE_INTERFACES' as rule_id, device, null as interface, null as vlan, '' as vlans from ms",
    "TRUNK_WITHOUT_NEIGHBOR": "select snapshot_id, 'TRUNK_WITHOUT_NEIGHBOR' as rule_id, device, interface, null as vlan, '' as vlans from tp where not exists (select 1 from edge where edge.snapshot_id = tp.snapshot_id and edge.ld = tp.ld and edge.li = tp.li)",
}


def _rule(fn, name):
    def run(s, d):
        return fn(s, d).select(*DCOLS, F.coalesce(F.array_join("vlans", ";"), F.lit("")).alias("vlans"))

    return Case(run, GRAPH + RULE_SQL[name])


def tables(s, d):
    return {"interfaces": iface(s, d), "trunks": trunk(s, d), "macs": mac(s, d), "stp": stp(s, d), "neighbors": nbr(s, d)}


def suppression(s, d):
    return bind(s, d, "select 'UNUSED_PORT_ADMIN_UP' as rule_id, 'Sw' || cast(n_nationkey as string) as device, cast(null as string) as interface from nation where n_nationkey < 5 union all select null, null, 'Gi0/' || cast(p_partkey as string) from part where p_partkey % 50 = 0")


_OPEN = "and not (rule_id = 'UNUSED_PORT_ADMIN_UP' and device in ('Sw0', 'Sw1', 'Sw2', 'Sw3', 'Sw4')) and not coalesce(interface like 'Gi0/%' and cast(substr(interface, 5) as int) % 50 = 0 and cast(substr(interface, 5) as int) <= (select max(p_partkey) from part), false)"
RUN_SQL = GRAPH + ", r as (" + " union all ".join(f"({q})" for n, q in RULE_SQL.items() if n != "MAC_ON_MULTIPLE_INTERFACES") + f"""), rr as (select *, rule_id || '-' || substr(sha1(rule_id || '|' || device || '|' || coalesce(interface, '') || '|' || coalesce(vlan, '')), 1, 8) as finding_id,
 case when true {_OPEN} then 'open' else 'suppressed' end as status,
 case rule_id when 'ACCESS_PORT_DISALLOWED_VLAN' then 'high' when 'TRUNK_MISSING_REQUIRED_VLAN' then 'high' when 'ACCESS_PORT_TOO_MANY_MACS' then 'high' when 'POE_DISABLED_EXPECTED' then 'high' when 'UNUSED_PORT_ADMIN_UP' then 'low' else 'medium' end as severity,
 case when rule_id like '%VLAN%' then 'vlan' when rule_id like 'POE%' then 'poe' when rule_id like 'STP%' then 'stp' when rule_id = 'TRUNK_WITHOUT_NEIGHBOR' then 'topology' else 'port' end as category from r)"""


def findings(s, d):
    return pol.run_rules(tables(s, d), CONFIG, suppression(s, d))


def did(*parts):
    return "'DIFF-' || substr(sha1(" + " || '|' || ".join(f"coalesce(cast({p} as varchar), 'None')" for p in parts) + "), 1, 8)"


DIFF_SQL = f"""with b as ({BEFORE}), a as ({AFTER}), bb as (select d, cast(o_orderkey as varchar) as k, st, array_to_string(pr, ';') as pr, cast(n as varchar) as n from b), aa as (select d, cast(o_orderkey as varchar) as k, st, array_to_string(pr, ';') as pr, cast(n as varchar) as n from a),
j as (select coalesce(bb.d, aa.d) as d, coalesce(bb.k, aa.k) as k, bb.k as bk, aa.k as ak, bb.st as s1, aa.st as s2, bb.pr as p1, aa.pr as p2, bb.n as n1, aa.n as n2 from bb full join aa on bb.d = aa.d and bb.k = aa.k),
rec as (select {did("'orders'", "'removed'", 'd', 'k', 'null')} as diff_id, 'removed' as change_type, d as device, k as interface, 'presence' as field, null as before_value, null as after_value, 'low' as severity from j where ak is null
 union all select {did("'orders'", "'added'", 'd', 'k', 'null')}, 'added', d, k, 'presence', null, null, 'info' from j where bk is null
 union all select {did("'orders'", 'd', 'k', 'null', "'st'")}, 'changed', d, k, 'st', s1, s2, 'high' from j where ak is not null and bk is not null and s1 is distinct from s2
 union all select {did("'orders'", 'd', 'k', 'null', "'pr'")}, 'changed', d, k, 'pr', p1, p2, 'medium' from j where ak is not null and bk is not null and p1 is distinct from p2
 union all select {did("'orders'", 'd', 'k', 'null', "'n'")}, 'changed', d, k, 'n', n1, n2, 'low' from j where ak is not null and bk is not null and n1 is distinct from n2)"""


def records(s, d):
    return sn.diff_tables(bind(s, d, BEFORE), bind(s, d, AFTER), ["d", "o_orderkey"], {"st": "high", "pr": "medium", "n": "low"}, "orders")


RECCOLS = ["diff_id", "change_type", "device", "interface", "field", "before_value", "after_value", "severity"]
FDIFF = f"""with b as (select rule_id, device, interface, vlan, category, max(severity) as s from ({FIND}) where status = 'open' group by all), a as (select rule_id, device, interface, vlan, category, max(severity) as s from ({AFTER_FIND}) where status = 'open' group by all),
fd as (select coalesce(b.rule_id, a.rule_id) as rule_id, coalesce(b.device, a.device) as device, coalesce(b.interface, a.interface) as interface, coalesce(b.vlan, a.vlan) as vlan, coalesce(b.category, a.category) as category,
 case when a.rule_id is null then 'resolved' when b.rule_id is null then 'new' when a.s is distinct from b.s then 'changed_severity' else 'persistent' end as change, b.s as before_severity, a.s as after_severity, case when a.rule_id is null then 'low' else a.s end as severity
 from b full join a on b.rule_id = a.rule_id and b.device = a.device and b.interface is not distinct from a.interface and b.vlan is not distinct from a.vlan and b.category = a.category)"""


def fdiff(s, d):
    return sn.diff_findings(find(s, d), after_find(s, d))


def _nointerface(f):
    return lambda s, d: f(s, d).where("snapshot_id = 's0'").groupBy("device", *(["name"] if f is iface else ["interface"])).agg(*(
        [F.max("status").alias("status"), F.max("poe_state").alias("poe_state"), F.max("poe_enabled").alias("poe_enabled")] if f is iface else
        [F.max("allowed_vlans").alias("allowed_vlans")] if f is trunk else [F.max("admin_state").alias("admin_state"), F.max("oper_state").alias("oper_state")]))


def verdicts(s, d):
    return sn.verify_actions(plan(s, d), after_find(s, d), _nointerface(iface)(s, d), _nointerface(trunk)(s, d), _nointerface(poe)(s, d))


VERIFY_SQL = f"""with p as (select * from ({PLAN}) where status = 'planned'), o as (select distinct rule_id, device, interface, vlan, category, true as is_open from ({AFTER_FIND}) where status = 'open'),
i as (select * from ({INTERFACES}) where snapshot_id = 's0'), t as (select * from ({TRUNKS}) where snapshot_id = 's0'), q as (select * from ({POE}) where snapshot_id = 's0'),
j as (select p.*, o.is_open, lower(i.status) as st, i.poe_state as ps, i.poe_enabled as pe, t.allowed_vlans as av, q.admin_state as ad, q.oper_state as op from p
 left join o on p.rule_id = o.rule_id and p.device = o.device and p.interface is not distinct from o.interface and p.vlan is not distinct from o.vlan and p.category = o.category
 left join i on p.device = i.device and p.interface = i.name left join t on p.device = t.device and p.interface = t.interface left join q on p.device = q.device and p.interface = q.interface),
v as (select action_id, finding_id, rule_id, action_type, device, interface, case when action_type = 'investigation' then case when is_open is null then 'passed' else 'not_applicable' end
 when rule_id = 'UNUSED_PORT_ADMIN_UP' then case when is_open is null then 'passed' when st like '%disabled%' then 'passed' when st is not null then 'failed' else 'unknown' end
 when rule_id = 'TRUNK_MISSING_REQUIRED_VLAN' then case when av is null then 'unknown' when list_has_all(av, vlans) then 'passed' else 'failed' end
 when rule_id = 'TRUNK_UNAUTHORIZED_VLAN' then case when av is null then 'unknown' when not list_has_any(av, vlans) then 'passed' else 'failed' end
 when rule_id = 'POE_DISABLED_EXPECTED' then case when coalesce(nullif(ad, ''), nullif(op, ''), nullif(ps, ''), case when pe then 'enabled' end) is null then 'unknown' when ad = 'auto' or op = 'on' or ps = 'on' or pe then 'passed' else 'failed' end
 else 'unknown' end as verdict from j)"""


def scored(s, d):
    ports = iface(s, d).where("mode = 'trunk'").select("snapshot_id", "device", F.col("name").alias("interface"))
    cmds = find(s, d).where("finding_id like '%3'")
    ver = find(s, d).where("finding_id like '%4' or finding_id like '%5'").select("snapshot_id", "finding_id", F.when(F.col("finding_id").like("%4"), "failed").otherwise("passed").alias("verdict"))
    return rk.score_findings(find(s, d), ports, cmds, ver)


SCORE = f"""with iface as ({INTERFACES}), f as (select * from ({FIND}) where status = 'open'),
x as (select f.*, (case severity when 'critical' then 100 when 'high' then 75 when 'medium' then 50 when 'low' then 25 else 10 end) * (case confidence when 'high' then 100 when 'medium' then 85 else 70 end)
  + 100 * ((case category when 'security' then 10 when 'stp' then 5 when 'topology' then 3 else 0 end) + case when exists (select 1 from iface where mode = 'trunk' and iface.snapshot_id = f.snapshot_id and iface.device = f.device and iface.name = f.interface) then 5 else 0 end
  + case when finding_id like '%3' then 5 when finding_id like '%4' then 15 when finding_id like '%5' then -25 else 0 end) as cents from f),
y as (select *, greatest(0, least(100, case when cents % 100 = 50 then case when (cents // 100) % 2 = 0 then cents // 100 else cents // 100 + 1 end else cast(round(cents / 100.0) as bigint) end)) as risk_score from x),
sc as (select *, case when risk_score >= 85 then 'critical' when risk_score >= 65 then 'high' when risk_score >= 40 then 'medium' when risk_score >= 20 then 'low' else 'info' end as risk_level from y)"""
TEMPLATES = """select case r_regionkey when 0 then 'UNUSED_PORT_ADMIN_UP' when 1 then 'TRUNK_MISSING_REQUIRED_VLAN' when 2 then 'TRUNK_UNAUTHORIZED_VLAN' when 3 then 'POE_DISABLED_EXPECTED' else 'STP_BLOCKING_ACCESS_PORT' end as rule_id,
 case when r_regionkey = 4 then 'investigation' else 'command' end as kind, 'config' as action_type, r_regionkey <> 1 as enabled, cast(null as string) as mode, case when r_regionkey = 4 then 'odd' else 'medium' end as risk,
 split('shutdown', ';') as commands, case when r_regionkey = 3 then cast(null as {A}) else split('no shutdown', ';') end as rollback, split('show run', ';') as verification from region"""


def actions(s, d):
    return rk.plan_actions(find(s, d), bind(s, d, TEMPLATES.replace("{A}", "array<string>")))


ACT = f"""with f as (select * from ({FIND}) where status = 'open'), ac as (select 'ACT-' || finding_id as action_id, finding_id, rule_id, severity, category, device, interface,
 case rule_id when 'MAC_ON_MULTIPLE_INTERFACES' then 'blocked' when 'TRUNK_MISSING_REQUIRED_VLAN' then 'skipped' when 'POE_DISABLED_EXPECTED' then 'blocked' else 'planned' end as status,
 case rule_id when 'MAC_ON_MULTIPLE_INTERFACES' then 'blocked' when 'STP_BLOCKING_ACCESS_PORT' then 'investigation' else 'config' end as action_type,
 case when rule_id in ('MAC_ON_MULTIPLE_INTERFACES', 'STP_BLOCKING_ACCESS_PORT') then 'low' else 'medium' end as risk_level,
 case rule_id when 'MAC_ON_MULTIPLE_INTERFACES' then 'no remediation template available for this rule' when 'TRUNK_MISSING_REQUIRED_VLAN' then 'remediation template disabled in configuration'
  when 'STP_BLOCKING_ACCESS_PORT' then 'investigation-only; no configuration change proposed' when 'POE_DISABLED_EXPECTED' then 'rollback commands are required but none were generated' end as reason from f)"""
GATED = """select action_id, case status when 'planned' then 'validated' else status end as gate, case when action_type = 'investigation' then 'investigation-only; read-only steps validated' when status = 'planned' then 'command action validated for dry-run (not executed)' else reason end as gate_reason from ac"""


def _snaps(s, d):
    df = bind(s, d, """select cast(o_custkey % 30 as string) as device, o_orderkey, o_orderdate, case when o_orderkey % 5 = 0 then 'mstp' else 'rstp' end as stp_mode, o_orderkey % 4 = 0 as telnet, o_orderkey % 6 <> 0 as ssh,
      split(case o_orderkey % 3 when 0 then '1;2' when 1 then '1;3' else '1' end, ';') as vlans, o_orderkey % 2 as odd, o_orderkey % 9 as nine from orders""")
    port = F.struct(F.when(F.col("odd") == 0, "access").otherwise("trunk").alias("mode"), F.lit("1").alias("access_vlan"), F.when(F.col("nine") == 0, "9").otherwise("1").alias("native_vlan"), F.array(F.lit("1")).alias("trunk_vlans"), F.lit(True).alias("poe"))
    label = F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=F.col("o_orderkey") % 86400)
    snaps = df.select("device", label.alias("label"), "stp_mode", "telnet", "ssh", "vlans", F.create_map(F.lit("1/1"), port).alias("ports"))
    return sn.config_changes(snaps).groupBy("change", "severity").agg(F.count(F.lit(1)).alias("n"))


SNAP_SQL = """with o as (select cast(o_custkey % 30 as varchar) as device, o_orderdate + to_seconds(o_orderkey % 86400) as label, o_orderkey % 5 = 0 as m, o_orderkey % 4 = 0 as t, o_orderkey % 6 <> 0 as s, o_orderkey % 3 as v, o_orderkey % 2 as o, o_orderkey % 9 = 0 as n from orders),
p as (select lag(m) over w as m0, m, lag(t) over w as t0, t, lag(s) over w as s0, s, lag(v) over w as v0, v, lag(o) over w as o0, o, lag(n) over w as n0, n from o window w as (partition by device order by label))
select * from (select 'stp_change' as change, 'medium' as severity, count_if(m0 <> m) as n from p union all select 'mgmt_protocol_change', 'high', count_if(not t0 and t) + count_if(s0 and not s) from p
 union all select 'vlan_added', 'low', count_if(v0 <> v and v < 2) from p union all select 'vlan_removed', 'medium', count_if(v0 <> v and v0 < 2) from p union all select 'port_mode_change', 'medium', count_if(o0 <> o) from p union all select 'native_vlan_change', 'medium', count_if(n0 <> n) from p) where n > 0"""


def _edges(s, d):
    return tp.edges(nbr(s, d)).select("snapshot_id", "ld", "li", "local_device", "local_interface", "remote_device", "remote_interface", "bidirectional", "discovery_protocol")


def _w(fn, where):
    return Case(lambda s, d: fn(s, d).select(*WCOLS), GRAPH + f"select {', '.join(WCOLS)} from w where {where}")


def _warnings(s, d):
    return tp.all_warnings(dev(s, d), iface(s, d), trunk(s, d), nbr(s, d), mac(s, d), stp(s, d), 15)


def _enrich(s, d):
    i = iface(s, d).drop("poe_state", "poe_enabled")
    return i.join(poe(s, d).withColumnRenamed("interface", "name"), ["snapshot_id", "device", "name"], "left").select("snapshot_id", "device", "name", (F.lower("admin_state").isin("auto", "static", "on")).alias("poe_enabled"), F.col("oper_state").alias("poe_state"))


CASES = {
    "top_normalizers": Case(lambda s, d: nbr(s, d).select("ord", tp.norm_device(F.col("remote_device")).alias("d"), tp.norm_iface(F.col("local_interface")).alias("i"), tp.norm_iface(F.col("remote_interface")).alias("r")), f"with nb as ({NEIGHBORS}) select ord, {nd('remote_device')} as d, {ni('local_interface')} as i, {ni('remote_interface')} as r from nb"),
    "top_nodes": Case(lambda s, d: tp.nodes(dev(s, d), nbr(s, d)).select("snapshot_id", "node", "node_id", "source"), GRAPH + "select * from node"),
    "top_edges": Case(_edges, GRAPH + "select snapshot_id, ld, li, local_device, local_interface, remote_device, remote_interface, bidirectional, discovery_protocol from edge"),
    "top_warn_discovery": _w(lambda s, d: tp.warn_discovery(nbr(s, d)), "category = 'discovery'"),
    "top_warn_unidirectional": Case(lambda s, d: tp.warn_unidirectional(tp.edges(nbr(s, d)), dev(s, d)).select(*WCOLS), GRAPH + "select snapshot_id, 'warning' as severity, 'topology' as category, local_device as device, local_interface as interface from edge e where not bidirectional and rd <> ld and exists (select 1 from dev where dev.snapshot_id = e.snapshot_id and lower(dev.device) = e.rd)"),
    "top_warn_trunk_alone": Case(lambda s, d: tp.warn_trunk_alone(iface(s, d), trunk(s, d), tp.edges(nbr(s, d))).select(*WCOLS), GRAPH + "select snapshot_id, 'warning' as severity, 'topology' as category, device, interface from tp where not exists (select 1 from ep where ep.snapshot_id = tp.snapshot_id and ep.ld = tp.ld and ep.li = tp.li)"),
    "top_warn_mac": Case(lambda s, d: tp.warn_mac(mac(s, d), iface(s, d), 15).select(*WCOLS), GRAPH + "select mp.snapshot_id, 'warning' as severity, 'topology' as category, mp.device, interface from mp join acc on mp.snapshot_id = acc.snapshot_id and mp.device = acc.device and interface = name where n > 15 union all select snapshot_id, 'warning', 'loop_risk', device, null from ms"),
    "top_warn_stp": _w(lambda s, d: tp.warn_stp(stp(s, d), iface(s, d), trunk(s, d)), "category = 'stp'"),
    "top_summary": Case(lambda s, d: tp.topology_summary(tp.nodes(dev(s, d), nbr(s, d)), tp.edges(nbr(s, d)), _warnings(s, d)), GRAPH + """select snapshot_id, 'nodes' as metric, count(*) as n from node group by all union all select snapshot_id, 'edges', count(*) from edge group by all
      union all select snapshot_id, 'bidirectional', count_if(bidirectional) from edge group by all union all select snapshot_id, 'lldp_cdp', count(*) from edge group by all union all select snapshot_id, 'confidence_high', count(*) from edge group by all
      union all select snapshot_id, 'warning_' || severity, count(*) from w group by all"""),
    "cfg_access_vlan": _rule(lambda s, d: pol.rule_access_vlan(iface(s, d), range(1, 41)), "ACCESS_PORT_DISALLOWED_VLAN"),
    "cfg_trunk_missing": _rule(lambda s, d: pol.rule_trunk_missing(trunk(s, d), [20, 10]), "TRUNK_MISSING_REQUIRED_VLAN"),
    "cfg_trunk_extra": _rule(lambda s, d: pol.rule_trunk_extra(trunk(s, d), [1, 10, 20]), "TRUNK_UNAUTHORIZED_VLAN"),
    "cfg_native_vlan": _rule(lambda s, d: pol.rule_native_vlan(trunk(s, d), 1), "NATIVE_VLAN_MISMATCH"),
    "cfg_mac_limit": _rule(lambda s, d: pol.rule_mac_limit(mac(s, d), iface(s, d), 15), "ACCESS_PORT_TOO_MANY_MACS"),
    "cfg_poe_expected": _rule(lambda s, d: pol.rule_poe_expected(iface(s, d), ["o", "TIN"]), "POE_DISABLED_EXPECTED"),
    "cfg_unused_port": _rule(lambda s, d: pol.rule_unused_port(iface(s, d)), "UNUSED_PORT_ADMIN_UP"),
    "cfg_stp_block": _rule(lambda s, d: pol.rule_stp_block(stp(s, d), iface(s, d)), "STP_BLOCKING_ACCESS_PORT"),
    "cfg_mac_multi": _rule(lambda s, d: pol.rule_mac_multi(mac(s, d)), "MAC_ON_MULTIPLE_INTERFACES"),
    "cfg_trunk_alone": _rule(lambda s, d: pol.rule_trunk_alone(iface(s, d), trunk(s, d), tp.edges(nbr(s, d))), "TRUNK_WITHOUT_NEIGHBOR"),
    "cfg_suppress_and_run": Case(lambda s, d: findings(s, d).select(*DCOLS, "finding_id", "severity", "category", "status"), RUN_SQL + " select snapshot_id, rule_id, device, interface, vlan, finding_id, severity, category, status from rr"),
    "cfg_rule_summary": Case(lambda s, d: pol.rule_summary(findings(s, d)), RUN_SQL + " select 'severity' as dimension, severity as value, count(*) as n from rr where status = 'open' group by all union all select 'category', category, count(*) from rr where status = 'open' group by all union all select 'status', 'suppressed', count(*) from rr where status = 'suppressed'"),
    "cfg_validator_findings": Case(
        lambda s, d: pol.validator_findings(bind(s, d, "select case o_orderkey % 3 when 0 then 'failed' when 1 then 'Partially parsed' else 'PASSED' end as status, 'f' || cast(o_orderkey as string) as file_name, 'n' || cast(o_custkey as string) as node from orders"),
                                            bind(s, d, "select 'acl' as structure_type, p_name as ref_name, 'f' || cast(p_partkey as string) as file_name, 'n1' as node from part")).select("finding_id", "severity", "title", "device", "evidence"),
        """with x as (select case o_orderkey % 3 when 0 then 'high' else 'medium' end as severity, case o_orderkey % 3 when 0 then 'Configuration file failed to parse' else 'Configuration file partially parsed' end as title, 'n' || cast(o_custkey as varchar) as device,
          case o_orderkey % 3 when 0 then 'Batfish could not parse ' else 'Batfish partially parsed ' end || 'f' || cast(o_orderkey as varchar) || '.' as evidence from orders where o_orderkey % 3 < 2
          union all select 'medium', 'Undefined reference in configuration', 'n1', 'acl ''' || p_name || ''' is referenced but undefined (f' || cast(p_partkey as varchar) || ').' from part)
        select 'BF-' || substr(sha1('config|' || title || '|' || device || '|None|' || evidence), 1, 8) as finding_id, severity, title, device, evidence from x"""),
    "dif_tables": Case(lambda s, d: records(s, d).select(*RECCOLS), DIFF_SQL + f" select {', '.join(RECCOLS)} from rec"),
    "dif_presence": Case(lambda s, d: sn.diff_presence(bind(s, d, BEFORE), bind(s, d, AFTER), ["d", "o_orderkey"], "vlan").drop("category"),
        f"with b as ({BEFORE}), a as ({AFTER}) select d, cast(o_orderkey as varchar) as o_orderkey, 'removed' as change_type, 'low' as severity from b where o_orderkey not in (select o_orderkey from a) union all select d, cast(o_orderkey as varchar), 'added', 'info' from a where o_orderkey not in (select o_orderkey from b)"),
    "dif_topology": Case(lambda s, d: sn.diff_topology(*[tp.nodes(dev(s, d), nbr(s, d)).where(f"snapshot_id = 's{i}'") for i in (0, 1)], *[tp.edges(nbr(s, d)).where(f"snapshot_id = 's{i}'") for i in (0, 1)]).groupBy("field", "change_type", "severity").agg(F.count(F.lit(1)).alias("n")),
        GRAPH + """, ek as (select snapshot_id, array_to_string(list_sort([local_device || ':' || local_interface, coalesce(remote_device, 'None') || ':' || coalesce(remote_interface, 'None')]), ' <-> ') as e, max(discovery_protocol) as p from edge group by all),
        ej as (select x.e as xe, y.e as ye, x.p as xp, y.p as yp from (select * from ek where snapshot_id = 's0') x full join (select * from ek where snapshot_id = 's1') y on x.e = y.e),
        nj as (select x.node_id as xn, y.node_id as yn from (select * from node where snapshot_id = 's0') x full join (select * from node where snapshot_id = 's1') y on x.node_id = y.node_id)
        select * from (select 'edge' as field, 'removed' as change_type, 'medium' as severity, count_if(ye is null) as n from ej union all select 'edge', 'added', 'medium', count_if(xe is null) from ej
         union all select 'discovery_protocol', 'changed', 'low', count_if(xp <> yp) from ej union all select 'node', 'removed', 'low', count_if(yn is null) from nj union all select 'node', 'added', 'info', count_if(xn is null) from nj) where n > 0"""),
    "dif_warnings": Case(lambda s, d: sn.diff_warnings(_warnings(s, d).where("snapshot_id = 's0'"), _warnings(s, d).where("snapshot_id = 's1'")).where("interface is not null").groupBy("change_type", "severity").agg(F.count(F.lit(1)).alias("n"))),
    "dif_findings": Case(fdiff, FDIFF + " select * from fd"),
    "dif_summary": Case(lambda s, d: sn.diff_summary(records(s, d), verdicts(s, d)), DIFF_SQL + ", " + VERIFY_SQL[len("with "):] .replace("j as (select p.*", "jj as (select p.*").replace("from j)", "from jj)").replace("with ", "") + """ select 'category' as dimension, 'orders' as value, count(*) as n from rec union all select 'change_type', change_type, count(*) from rec group by all union all select 'verdict', verdict, count(*) from v group by all"""),
    "dif_verify_actions": Case(verdicts, VERIFY_SQL + " select * from v"),
    "dif_config_changes": Case(_snaps, SNAP_SQL),
    "dif_top_changes": Case(lambda s, d: sn.top_changes(records(s, d), 25).select(*RECCOLS), DIFF_SQL + f" select {', '.join(RECCOLS)} from rec where severity = 'high' order by diff_id limit 25"),
    "rsk_score": Case(lambda s, d: scored(s, d).select("finding_id", "risk_score", "risk_level"), SCORE + " select finding_id, risk_score, risk_level from sc"),
    "rsk_by_device": Case(lambda s, d: rk.risk_by_device(scored(s, d), 5), SCORE + ", g as (select snapshot_id, device, max(risk_score) as max_risk, count(*) as findings from sc group by all) select * from (select *, row_number() over (partition by snapshot_id order by max_risk desc, findings desc, device) as rank from g) where rank <= 5"),
    "rsk_health_cards": Case(lambda s, d: rk.health_cards({**tables(s, d), "devices": dev(s, d), "findings": find(s, d), "poe": poe(s, d)}).select("snapshot_id", "device", "interfaces", "access_ports", "findings", "trunks", "blocked", "poe_ports", "neighbors", "highest_severity", "status"),
        GRAPH + f""", fi as (select snapshot_id, device, count(*) as findings, min(case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end) as r from ({FIND}) where status = 'open' group by all),
        ii as (select snapshot_id, device, count(*) as interfaces, count_if(mode = 'access') as access_ports from iface group by all), tt as (select snapshot_id, device, count(*) as trunks from tr group by all), ss as (select snapshot_id, device, count_if(state = 'blocking') as blocked from stp group by all),
        qq as (select snapshot_id, device, count(*) as poe_ports from ({POE}) group by all), nn as (select snapshot_id, device, count(*) as neighbors from nb group by all)
        select dev.snapshot_id, dev.device, coalesce(interfaces, 0) as interfaces, coalesce(access_ports, 0) as access_ports, coalesce(findings, 0) as findings, coalesce(trunks, 0) as trunks, coalesce(blocked, 0) as blocked, coalesce(poe_ports, 0) as poe_ports, coalesce(neighbors, 0) as neighbors,
         case r when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'info' end as highest_severity, case when coalesce(interfaces, 0) = 0 then 'unknown' when r <= 1 then 'critical' when r is not null then 'warning' else 'healthy' end as status
        from dev left join ii using (snapshot_id, device) left join fi using (snapshot_id, device) left join tt using (snapshot_id, device) left join ss using (snapshot_id, device) left join qq using (snapshot_id, device) left join nn using (snapshot_id, device)"""),
    "rsk_hypotheses": Case(lambda s, d: rk.hypotheses(find(s, d), stp(s, d), mac(s, d), nbr(s, d), verdicts(s, d), fdiff(s, d).withColumn("snapshot_id", F.lit("s0"))).select("snapshot_id", "kind", "confidence", "support"),
        FDIFF + ", " + VERIFY_SQL[len("with "):] + f""", ff as ({FIND}), mm as ({MACS}),
        l as (select snapshot_id, count(*) as n from ff where rule_id in ('STP_BLOCKING_ACCESS_PORT', 'MAC_ON_MULTIPLE_INTERFACES') group by all having count(distinct rule_id) = 2),
        u as (select snapshot_id, count(*) as n from ff where rule_id = 'UNUSED_PORT_ADMIN_UP' and not exists (select 1 from mm where mm.snapshot_id = ff.snapshot_id and mm.device = ff.device and mm.interface = ff.interface) group by all),
        r as (select snapshot_id, count(*) as n from ff where rule_id = 'TRUNK_MISSING_REQUIRED_VLAN' and finding_id in (select finding_id from v where verdict in ('failed', 'unknown')) group by all)
        select snapshot_id, 'loop' as kind, case when n >= 3 then 'likely' when n = 2 then 'candidate' else 'possible' end as confidence, n as support from l union all select snapshot_id, 'unused_exposed', 'likely', n from u
        union all select snapshot_id, 'vlan_not_remediated', case when n >= 2 then 'likely' else 'candidate' end, n from r union all select * from (select 's0', 'unauthorized_vlan', 'candidate', count(*) as c from fd where change = 'new' and rule_id = 'TRUNK_UNAUTHORIZED_VLAN') where c > 0"""),
    "rsk_plan_actions": Case(lambda s, d: actions(s, d).select("action_id", "action_type", "status", "risk_level", "reason"), ACT + " select action_id, action_type, status, risk_level, reason from ac"),
    "rsk_gate_plan": Case(lambda s, d: rk.gate_plan(actions(s, d)).select("action_id", "gate", "gate_reason"), ACT + " " + GATED),
    "rsk_work_items": Case(lambda s, d: rk.work_items(actions(s, d), find(s, d)).select("item_id", "priority", "action_type", "owner"),
        ACT + """ select 'AI-' || substr(sha1('action|' || action_id), 1, 8) as item_id, case when status = 'planned' then case severity when 'critical' then 'P1' when 'high' then 'P1' when 'medium' then 'P2' else 'P3' end else 'P3' end as priority,
        case when status = 'planned' and action_type = 'config' then 'config-plan' else 'investigate' end as action_type, case when action_type = 'investigation' and category = 'security' then 'security' else 'network' end as owner from ac"""),
    "rsk_snapshot_summary": Case(lambda s, d: rk.snapshot_summary({"interfaces": iface(s, d), "trunks": trunk(s, d), "findings": find(s, d)}),
        f"select snapshot_id, 'interfaces' as metric, count(*) as n from ({INTERFACES}) group by all union all select snapshot_id, 'trunks', count(*) from ({TRUNKS}) group by all union all select snapshot_id, 'findings', count(*) from ({FIND}) group by all"),
    "rsk_timeline": Case(lambda s, d: rk.timeline(bind(s, d, "select cast(o_orderkey as string) as snapshot_id, case when o_orderkey % 3 > 0 then cast(o_custkey as string) end as captured, cast(o_orderkey % 7 as string) as planned from orders")),
        "select cast(o_orderkey as varchar) as snapshot_id, 'captured' as step, cast(o_custkey as varchar) as at from orders where o_orderkey % 3 > 0 union all select cast(o_orderkey as varchar), 'planned', cast(o_orderkey % 7 as varchar) from orders"),
    "rsk_findings_view": Case(lambda s, d: rk.findings_view(scored(s, d)), SCORE + ", v as (select snapshot_id, finding_id, severity, risk_score, row_number() over (partition by snapshot_id order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, risk_score desc, finding_id) as position from sc) select *, position <= 10 as is_top from v"),
    "rsk_graph_view": Case(lambda s, d: rk.graph_view(tp.nodes(dev(s, d), nbr(s, d)), tp.edges(nbr(s, d)), _warnings(s, d), scored(s, d))[0].select("snapshot_id", "node_id", "max_risk", "findings"),
        GRAPH + ", " + SCORE[len("with "):].replace(f"iface as ({INTERFACES}), ", "") + " select node.snapshot_id, node_id, coalesce(max(risk_score), 0) as max_risk, count(finding_id) as findings from node left join sc on sc.snapshot_id = node.snapshot_id and sc.device = node.node_id group by all"),
    "rsk_actions_view": Case(lambda s, d: rk.actions_view(actions(s, d)), ACT + " select 'device' as dimension, device as value, count(*) as n from ac group by all union all select 'risk_level', risk_level, count(*) from ac group by all union all select 'status', status, count(*) from ac group by all"),
    "inv_enrich_poe": Case(_enrich, f"with i as ({INTERFACES}), q as ({POE}) select i.snapshot_id, i.device, name, admin_state = 'auto' as poe_enabled, oper_state as poe_state from i left join q on i.snapshot_id = q.snapshot_id and i.device = q.device and i.name = q.interface"),
}
