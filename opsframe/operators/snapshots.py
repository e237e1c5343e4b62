"""Snapshot comparison, goal verification and configuration change events."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import as_text, digest_id, lookup, pick, severity_rank
from opsframe.operators.findings import count_dimensions
from opsframe.operators.series import pair_snapshots

# Compared fields and severities, port-down words, PoE-on words.
INTERFACE_FIELDS = {"status": "medium", "vlan": "medium", "mode": "medium", "description": "low", "poe_enabled": "medium", "poe_state": "medium"}
TRUNK_FIELDS = {"allowed_vlans": "medium", "native_vlan": "high", "trunking_status": "medium"}
POE_FIELDS = {"admin_state": "medium", "oper_state": "medium"}
STP_FIELDS = {"state": "medium", "role": "low"}
DOWN_WORDS = ["disabled", "administratively down", "admin down", "shutdown"]
POE_ON_WORDS = ["on", "auto", "static", "enabled", "true"]
PRESENCE_SEVERITY = {"removed": "low", "added": "info", "unchanged": "info"}
RECORD = ["diff_id", "category", "change_type", "device", "interface", "vlan", "field", "before_value", "after_value", "severity"]


def _text(df: DataFrame, c: str) -> Column:
    return as_text(c, df.schema[c].dataType.typeName() == "array")


def _place(keys: Sequence[str]) -> dict[str, Column]:
    names = ["device", "interface", "vlan"]
    return {n: (F.col(f"k{i}") if i < len(keys) else F.lit(None)).cast("string") for i, n in enumerate(names)}


def _side(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    return df.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.struct(F.lit(True).alias("here"), *[_text(df, f).alias(f) for f in fields]).alias(name))


def diff_tables(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Mapping[str, str], category: str, unchanged: bool = False) -> DataFrame:
    """Added, removed and changed rows of a keyed table; values compare as text, keys null-safe."""
    b, a = _side(before, keys, list(fields), "b"), _side(after, keys, list(fields), "a")
    ks = [f"k{i}" for i in range(len(keys))]
    a2 = a.select(*[F.col(k).alias(f"a_{k}") for k in ks], "a")
    cond = None
    for k in ks:
        e = F.col(k).eqNullSafe(F.col(f"a_{k}"))
        cond = e if cond is None else cond & e
    j = b.join(a2, cond, "full_outer").select(*[F.coalesce(k, f"a_{k}").alias(k) for k in ks], "b", "a")
    null = F.lit(None).cast("string")
    slot = lambda t, f, bv, av, s: F.struct(F.lit(t).alias("change_type"), F.lit(f).alias("field"), bv.alias("before_value"), av.alias("after_value"), F.lit(s).alias("severity"))
    differs = {f: ~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields}
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = [F.when(F.col("a").isNull(), slot("removed", "presence", null, null, "low")), F.when(F.col("b").isNull(), slot("added", "presence", null, null, "info"))]
    rows += [F.when(both & differs[f], slot("changed", f, F.col(f"b.{f}"), F.col(f"a.{f}"), s)) for f, s in fields.items()]
    if unchanged:
        same = both
        for d in differs.values():
            same = same & ~d
        rows.append(F.when(same, slot("unchanged", "presence", null, null, "info")))
    place = _place(keys)
    out = j.select(F.explode(F.array_compact(F.array(*rows))).alias("r"), *[e.alias(n) for n, e in place.items()]).select("r.*", *place)
    cat = F.lit(category)
    by_presence = digest_id("DIFF", 8, cat, "change_type", "device", "interface", "vlan", null_text="None")
    by_field = digest_id("DIFF", 8, cat, "device", "interface", "vlan", "field", null_text="None")
    return out.withColumn("category", cat).withColumn("diff_id", F.when(F.col("change_type") == "changed", by_field).otherwise(by_presence)).select(*RECORD)


def diff_presence(before: DataFrame, after: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Added and removed keys only."""
    side = lambda d, here: d.select(*[F.col(k).cast("string").alias(k) for k in keys], F.lit(here).alias("_after"))
    seen = side(before, False).unionByName(side(after, True)).groupBy(*keys).agg(F.bool_or("_after").alias("_in_after"), F.bool_and("_after").alias("_only_after"))
    rows = seen.where(F.col("_only_after") | ~F.col("_in_after")).select(*keys, F.when(F.col("_only_after"), "added").otherwise("removed").alias("change_type"))
    return rows.withColumn("category", F.lit(category)).withColumn("severity", F.when(F.col("change_type") == "removed", "low").otherwise("info"))


def edge_key(df: DataFrame) -> Column:
    """Undirected key: both endpoints as ``device:port`` in order."""
    end = lambda d, p: F.concat(F.coalesce(d, F.lit("None")), F.lit(":"), F.coalesce(p, F.lit("None")))
    return F.array_join(F.array_sort(F.array(end("local_device", "local_interface"), end("remote_device", "remote_interface"))), " <-> ")


def diff_topology(nodes_b: DataFrame, nodes_a: DataFrame, edges_b: DataFrame | None, edges_a: DataFrame | None) -> DataFrame:
    """Nodes, undirected edges and edge attributes. A missing side skips the comparison."""
    n = diff_tables(nodes_b.select("node_id"), nodes_a.select("node_id"), ["node_id"], {}, "topology").withColumn("field", F.lit("node"))
    if edges_b is None or edges_a is None:
        return n
    shape = lambda e: e.select(edge_key(e).alias("edge"), "confidence", "discovery_protocol").groupBy("edge").agg(F.max("confidence").alias("confidence"), F.max("discovery_protocol").alias("discovery_protocol"))
    e = diff_tables(shape(edges_b), shape(edges_a), ["edge"], {"confidence": "low", "discovery_protocol": "low"}, "topology")
    e = e.withColumn("severity", F.when(F.col("field") == "presence", "medium").otherwise("low")).withColumn("field", F.when(F.col("field") == "presence", "edge").otherwise(F.col("field")))
    return n.unionByName(e)


def _keyed_sides(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    b = before.select(*keys, F.struct(*values).alias("b"))
    a = after.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*values).alias("a"))
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"a_{k}"))
        cond = e if cond is None else cond & e
    return b.join(a, cond, "full_outer").select(*[F.coalesce(k, f"a_{k}").alias(k) for k in keys], "b", "a")


def diff_warnings(before: DataFrame, after: DataFrame) -> DataFrame:
    """New and resolved topology warnings."""
    keys = ["category", "device", "interface", "message"]
    one = lambda d: d.groupBy(*keys).agg(F.min("severity").alias("severity"))
    j = _keyed_sides(one(before), one(after), keys, ["severity"]).where("a is null or b is null")
    gone = F.col("a").isNull()
    return j.select("device", "interface", "message", F.when(gone, "removed").otherwise("added").alias("change_type"), F.when(gone, F.lit("low")).otherwise(F.coalesce("a.severity", F.lit("medium"))).alias("severity"))


FINDING_KEY = ["rule_id", "device", "interface", "vlan", "category"]


def diff_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Open findings on an id-free key: new, resolved, persistent, changed_severity."""
    one = lambda d: d.where("status = 'open'").groupBy(*FINDING_KEY).agg(F.max("severity").alias("severity"))
    j = _keyed_sides(one(before), one(after), FINDING_KEY, ["severity"])
    kind = pick([(F.col("a").isNull(), "resolved"), (F.col("b").isNull(), "new"), (~F.col("a.severity").eqNullSafe(F.col("b.severity")), "changed_severity")], "persistent")
    severity = pick([(F.col("a").isNull(), F.lit("low"))], F.coalesce("a.severity", F.lit("medium")))
    return j.select(*FINDING_KEY, kind.alias("change"), F.col("b.severity").alias("before_severity"), F.col("a.severity").alias("after_severity"), severity.alias("severity"))


def diff_summary(records: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Active changes by category and type, and verdict counts."""
    out = count_dimensions(records.where("change_type in ('added', 'removed', 'changed')"), ["category", "change_type"])
    return out if verdicts is None else out.unionByName(count_dimensions(verdicts, ["verdict"]))


def top_changes(records: DataFrame, n: int = 10) -> DataFrame:
    d = records.where("severity in ('critical', 'high') and change_type in ('added', 'removed', 'changed')")
    return d.withColumn("severity_rank", severity_rank("severity")).orderBy("severity_rank", "diff_id").limit(n)


def verify_actions(plan: DataFrame, after_open: DataFrame | None, interfaces: DataFrame, trunks: DataFrame, poe: DataFrame) -> DataFrame:
    """One verdict per planned action; missing evidence is ``unknown``, never passed.

    ``plan`` carries action_id, rule_id, action_type, status, device, interface, vlans and the finding's vlan and category.
    """
    p = plan.where("status = 'planned'")
    if after_open is not None:
        keys = after_open.where("status = 'open'").select(*[F.col(c).alias(f"o_{c}") for c in FINDING_KEY]).distinct()
        cond = F.lit(True)
        for c in FINDING_KEY:
            cond = cond & F.col(c).eqNullSafe(F.col(f"o_{c}"))
        p = p.join(keys.withColumn("_open", F.lit(True)), cond, "left").drop(*[f"o_{c}" for c in FINDING_KEY])
        resolved, available = F.col("_open").isNull(), True
    else:
        p = p.withColumn("_open", F.lit(None).cast("boolean"))
        resolved, available = F.lit(False), False
    i = interfaces.select("device", F.col("name").alias("interface"), F.lower(F.coalesce("status", F.lit(""))).alias("_st"), F.lower(F.coalesce("poe_state", F.lit(""))).alias("_ps"), "poe_enabled")
    t = trunks.select("device", "interface", F.coalesce("allowed_vlans", F.array().cast("array<string>")).alias("_allowed"))
    q = poe.select("device", "interface", F.lower(F.coalesce("admin_state", F.lit(""))).alias("_ad"), F.lower(F.coalesce("oper_state", F.lit(""))).alias("_op"))
    j = p.join(i, ["device", "interface"], "left").join(t, ["device", "interface"], "left").join(q, ["device", "interface"], "left")
    down = F.lit(False)
    for w in DOWN_WORDS:
        down = down | F.contains("_st", F.lit(w))
    vl = F.coalesce("vlans", F.array().cast("array<string>"))
    no_trunk = F.col("_allowed").isNull() | (F.size(vl) == 0)
    words = F.filter(F.array(F.col("_ad"), F.col("_op"), F.col("_ps"), F.when(F.col("poe_enabled"), F.lit("enabled"))), lambda w: w.isNotNull() & (w != ""))
    rule = F.col("rule_id")
    unused = pick([(resolved, "passed"), (F.col("_st").isNotNull() & down, "passed"), (F.col("_st").isNotNull() & F.lit(available), "failed")], "unknown")
    added = pick([(no_trunk, "unknown"), (F.size(F.array_except(vl, "_allowed")) == 0, "passed")], "failed")
    removed = pick([(no_trunk, "unknown"), (F.size(F.array_intersect(vl, "_allowed")) == 0, "passed")], "failed")
    powered = pick([(F.size(words) == 0, "unknown"), (F.arrays_overlap(words, F.array(*[F.lit(w) for w in POE_ON_WORDS])), "passed")], "failed")
    verdict = pick([
        (F.col("action_type") == "investigation", F.when(resolved, "passed").otherwise("not_applicable")), (rule == "UNUSED_PORT_ADMIN_UP", unused),
        (rule == "TRUNK_MISSING_REQUIRED_VLAN", added), (rule == "TRUNK_UNAUTHORIZED_VLAN", removed), (rule == "POE_DISABLED_EXPECTED", powered)], "unknown")
    return j.select("action_id", "finding_id", "rule_id", "action_type", "device", "interface", verdict.alias("verdict"))


# Change kinds and their severities.
CHANGE_SEVERITY = {
    "stp_change": "medium", "mgmt_protocol_change": "high", "vlan_added": "low", "vlan_removed": "medium", "port_added": "low", "port_removed": "medium",
    "port_mode_change": "medium", "access_vlan_change": "medium", "native_vlan_change": "medium", "trunk_vlan_change": "medium", "poe_change": "medium",
}


def config_changes(snapshots: DataFrame) -> DataFrame:
    """Change events between consecutive snapshots of a device.

    ``snapshots``: device, label (timestamp), stp_mode, telnet, ssh, vlans array, ports map(name → struct(mode, access_vlan, native_vlan, trunk_vlans, poe)).
    """
    p = pair_snapshots(snapshots, "device", "label").select("device", F.col("after.label").alias("label"), "before", "after")
    b, a = (lambda f: F.col(f"before.{f}")), (lambda f: F.col(f"after.{f}"))
    names = F.array_union(F.map_keys(b("ports")), F.map_keys(a("ports")))
    ev = lambda kind, subject, old, new: F.struct(F.lit(kind).alias("change"), subject.cast("string").alias("subject"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    null = F.lit(None)
    globals_ = F.array_compact(F.array(
        F.when(~b("stp_mode").eqNullSafe(a("stp_mode")), ev("stp_change", null, b("stp_mode"), a("stp_mode"))),
        F.when(~F.coalesce(b("telnet"), F.lit(False)) & F.coalesce(a("telnet"), F.lit(False)), ev("mgmt_protocol_change", F.lit("telnet"), F.lit("off"), F.lit("on"))),
        F.when(F.coalesce(b("ssh"), F.lit(False)) & ~F.coalesce(a("ssh"), F.lit(False)), ev("mgmt_protocol_change", F.lit("ssh"), F.lit("on"), F.lit("off")))))
    vlans = F.concat(
        F.transform(F.array_except(a("vlans"), b("vlans")), lambda v: ev("vlan_added", v, null, v)),
        F.transform(F.array_except(b("vlans"), a("vlans")), lambda v: ev("vlan_removed", v, v, null)))

    def port(n: Column) -> Column:
        x, y = F.element_at(b("ports"), n), F.element_at(a("ports"), n)
        both = x.isNotNull() & y.isNotNull()
        changed = lambda kind, f: F.when(both & ~x[f].eqNullSafe(y[f]), ev(kind, n, x[f], y[f]))
        lists = F.when(both & ~F.array_sort(x["trunk_vlans"]).eqNullSafe(F.array_sort(y["trunk_vlans"])), ev("trunk_vlan_change", n, F.array_join(x["trunk_vlans"], ";"), F.array_join(y["trunk_vlans"], ";")))
        return F.array_compact(F.array(
            F.when(x.isNull(), ev("port_added", n, null, null)), F.when(y.isNull(), ev("port_removed", n, null, null)), changed("port_mode_change", "mode"),
            changed("access_vlan_change", "access_vlan"), changed("native_vlan_change", "native_vlan"), lists, changed("poe_change", "poe")))

    events = F.concat(globals_, vlans, F.flatten(F.transform(names, port)))
    out = p.select("device", "label", F.explode(events).alias("e")).select("device", "label", "e.*")
    return out.withColumn("severity", lookup("change", CHANGE_SEVERITY))
