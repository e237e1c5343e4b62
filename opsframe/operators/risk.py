"""Risk scores, hypotheses and action tables over findings."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scalars import SEVERITY_RANK, digest_id, lookup, pick, severity_name, severity_rank
from opsframe.operators.findings import count_dimensions

SNAP = "snapshot_id"
# Weights, factors, bumps and level bounds of the risk score.
WEIGHT = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
FACTOR = {"high": 1.0, "medium": 0.85, "low": 0.7}
CATEGORY_BUMP = {"security": 10, "loop risk": 10, "loop_risk": 10, "stp": 5, "topology": 3}
TOPOLOGY_BUMP, COMMAND_BUMP = 5, 5
VERDICT_DELTA = {"failed": 15, "unknown": 5, "passed": -25, "not_applicable": 0}
LEVELS = [("critical", 85), ("high", 65), ("medium", 40), ("low", 20)]
PRIORITY = {"critical": "P1", "high": "P1", "medium": "P2", "low": "P3", "info": "P3"}
SECURITY_CATEGORIES = ["security"]


def risk_level(score: Column) -> Column:
    return pick([(score >= n, name) for name, n in LEVELS], "info")


def score_findings(findings: DataFrame, topo_ports: DataFrame | None = None, command_ids: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Risk 0–100 per open finding, rounded half to even, with its level and factors."""
    d = findings.where("status = 'open'")
    if topo_ports is not None:
        d = d.join(topo_ports.select(SNAP, "device", "interface").distinct().withColumn("on_topology", F.lit(True)), [SNAP, "device", "interface"], "left")
    else:
        d = d.withColumn("on_topology", F.lit(None).cast("boolean"))
    if command_ids is not None:
        d = d.join(command_ids.select(SNAP, "finding_id").distinct().withColumn("has_command", F.lit(True)), [SNAP, "finding_id"], "left")
    else:
        d = d.withColumn("has_command", F.lit(None).cast("boolean"))
    if verdicts is not None:
        d = d.join(verdicts.select(SNAP, "finding_id", "verdict"), [SNAP, "finding_id"], "left")
    else:
        d = d.withColumn("verdict", F.lit(None).cast("string"))
    base, factor = lookup("severity", WEIGHT, 10), lookup("confidence", FACTOR, 0.85)
    bump = lookup("category", CATEGORY_BUMP, 0)
    topo = F.when(F.col("on_topology"), TOPOLOGY_BUMP).otherwise(0)
    cmd = F.when(F.col("has_command"), COMMAND_BUMP).otherwise(0)
    delta = F.coalesce(lookup("verdict", VERDICT_DELTA), F.lit(0))
    # hundredths in whole numbers keep .5 exact before the half-even rounding
    cents = base * F.round(factor * 100).cast("int") + (bump + topo + cmd + delta) * 100
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(cents.cast("decimal(10,2)") / 100, 0).cast("int")))
    said = lambda c, *parts: F.when(c, F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
    factors = F.array_compact(F.array(
        F.concat(F.lit("severity="), F.col("severity"), F.lit("("), base.cast("string"), F.lit(")")),
        F.concat(F.lit("confidence="), F.col("confidence"), F.lit("(x"), factor.cast("string"), F.lit(")")),
        said(bump > 0, "category=", F.col("category"), "(+", bump, ")"), said(topo > 0, f"topology-relevant(+{TOPOLOGY_BUMP})"),
        said(cmd > 0, f"config-change-needed(+{COMMAND_BUMP})"), said(delta > 0, "verification=", F.col("verdict"), "(+", delta, ")"), said(delta < 0, "verification=", F.col("verdict"), "(", delta, ")")))
    return d.withColumns({"risk_score": score, "factors": factors}).withColumn("risk_level", risk_level(F.col("risk_score")))


def risk_by_device(scored: DataFrame, top: int | None = None) -> DataFrame:
    g = scored.groupBy(SNAP, "device").agg(F.max("risk_score").alias("max_risk"), F.count(F.lit(1)).alias("findings"))
    if top is None:
        return g
    w = Window.partitionBy(SNAP).orderBy(F.desc("max_risk"), F.desc("findings"), F.col("device"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def health_cards(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Counts per device, the most severe finding and a status; each table is combined before the join."""
    key = [SNAP, "device"]
    n = lambda d, name, cond=None: (d if cond is None else d.where(cond)).groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    i = tables["interfaces"].groupBy(*key).agg(F.count(F.lit(1)).alias("interfaces"), F.count_if(F.col("mode") == "access").alias("access_ports"))
    f = tables["findings"].where("status = 'open'").groupBy(*key).agg(F.count(F.lit(1)).alias("findings"), F.min(severity_rank("severity")).alias("rank"))
    parts = [i, f, n(tables["trunks"], "trunks"), n(tables["stp"], "blocked", F.lower("state") == "blocking"), n(tables["poe"], "poe_ports"), n(tables["neighbors"], "neighbors")]
    if "actions" in tables:
        parts.append(n(tables["actions"], "actions"))
    out = tables["devices"].select(*key).distinct()
    for p in parts:
        out = out.join(p, key, "left")
    counts = [c for c in out.columns if c not in (*key, "rank")]
    out = out.fillna(0, counts)
    status = pick([(F.col("interfaces") == 0, "unknown"), (F.col("rank") <= 1, "critical"), (F.col("rank").isNotNull(), "warning")], "healthy")
    return out.withColumn("status", status).withColumn("highest_severity", severity_name(F.col("rank"))).drop("rank")


def confidence_word(n: Column) -> Column:
    return pick([(n >= 3, "likely"), (n == 2, "candidate")], "possible")


def hypotheses(findings: DataFrame, stp: DataFrame, macs: DataFrame, neighbors: DataFrame, verdicts: DataFrame | None = None, diff: DataFrame | None = None) -> DataFrame:
    """Root-cause candidates per snapshot from rules that occur together, with the number of supporting findings."""
    by = lambda d: d.groupBy(SNAP)
    rule = lambda r: findings.where(F.col("rule_id") == r)
    port = [SNAP, "device", "interface"]
    row = lambda d, kind, severity, conf, n: d.select(SNAP, F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), conf.alias("confidence"), n.cast("long").alias("support"))
    pair = by(findings.where("rule_id in ('STP_BLOCKING_ACCESS_PORT', 'MAC_ON_MULTIPLE_INTERFACES')")).agg(
        F.count_if(F.col("rule_id") == "STP_BLOCKING_ACCESS_PORT").alias("s"), F.count(F.lit(1)).alias("n")).where("s > 0 and n > s")
    out = row(pair, "loop", "high", confidence_word(F.col("n")), F.col("n"))
    stale = by(rule("TRUNK_WITHOUT_NEIGHBOR").join(stp.select(*port).distinct(), port, "left_anti")).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(row(stale, "stale_uplink", "medium", confidence_word(F.col("n") + 1), F.col("n")))
    quiet = rule("UNUSED_PORT_ADMIN_UP").join(macs.select(*port).distinct(), port, "left_anti").join(neighbors.select(SNAP, "device", F.col("local_interface").alias("interface")).distinct(), port, "left_anti")
    out = out.unionByName(row(by(quiet).agg(F.count(F.lit(1)).alias("n")), "unused_exposed", "medium", F.lit("likely"), F.col("n")))
    if verdicts is not None:
        bad = rule("TRUNK_MISSING_REQUIRED_VLAN").join(verdicts.where("verdict in ('failed', 'unknown')").select("finding_id").distinct(), "finding_id", "left_semi")
        out = out.unionByName(row(by(bad).agg(F.count(F.lit(1)).alias("n")), "vlan_not_remediated", "high", confidence_word(F.col("n") + 1), F.col("n")))
    if diff is not None:
        new = by(diff.where("change = 'new' and rule_id = 'TRUNK_UNAUTHORIZED_VLAN'")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(row(new, "unauthorized_vlan", "high", F.lit("candidate"), F.col("n")))
    return out


def plan_actions(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Open findings joined to a template table (rule_id, kind, action_type, enabled, mode, risk, commands, rollback, verification)."""
    t = templates.select("rule_id", *[F.col(c).alias(f"t_{c}") for c in ("kind", "action_type", "enabled", "mode", "risk", "commands", "rollback", "verification")], F.lit(True).alias("t_here"))
    d = findings.where("status = 'open'").drop("status").join(t, "rule_id", "left")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    investigate = (F.col("t_kind") == "investigation") | F.coalesce(F.col("t_mode") == "investigation_only", F.lit(False))
    reason = pick([
        (F.col("t_here").isNull(), "no remediation template available for this rule"), (~F.coalesce("t_enabled", F.lit(True)), "remediation template disabled in configuration"),
        (investigate, "investigation-only; no configuration change proposed"), (empty("t_commands"), "no candidate commands could be generated"),
        (empty("t_rollback"), "rollback commands are required but none were generated"), (empty("t_verification"), "verification steps are required but none were generated")])
    status = pick([(F.col("t_here").isNull(), "blocked"), (~F.coalesce("t_enabled", F.lit(True)), "skipped"), (investigate, "planned"),
                   (empty("t_commands") | empty("t_rollback") | empty("t_verification"), "blocked")], "planned")
    kind = pick([(F.col("t_here").isNull(), F.lit("blocked")), (investigate & F.coalesce("t_enabled", F.lit(True)), F.lit("investigation"))], F.col("t_action_type"))
    risk = pick([(F.col("t_here").isNull(), F.lit("low")), (investigate & ~F.col("t_risk").isin("low", "medium", "high"), F.lit("low"))], F.col("t_risk"))
    return d.select(
        SNAP, F.concat(F.lit("ACT-"), F.col("finding_id")).alias("action_id"), "finding_id", "rule_id", "severity", "category", "device", "interface", "vlan",
        kind.alias("action_type"), status.alias("status"), risk.alias("risk_level"), reason.alias("reason"),
        F.when((status == "planned") & ~investigate, F.col("t_commands")).alias("commands"), F.when((status == "planned") & ~investigate, F.col("t_rollback")).alias("rollback"),
        F.when(status == "planned", F.col("t_verification")).alias("verification"), F.lit(True).alias("dry_run_only"),
        F.coalesce((status == "planned") & ~investigate, F.lit(False)).alias("requires_confirmation"))


def gate_plan(actions: DataFrame) -> DataFrame:
    """validated / blocked / skipped with the first failing reason."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    st = F.col("status")
    inv = F.col("action_type") == "investigation"
    checks = [
        (st == "blocked", "blocked", F.coalesce("reason", F.lit("blocked in remediation plan"))), (st == "skipped", "skipped", F.coalesce("reason", F.lit("skipped in remediation plan"))),
        (st != "planned", "blocked", F.concat(F.lit("unexpected plan status '"), st, F.lit("'"))), (~F.coalesce("dry_run_only", F.lit(False)), "blocked", F.lit("action is not marked dry_run_only")),
        (inv & some("commands"), "blocked", F.lit("investigation action contains config commands")), (inv, "validated", F.lit("investigation-only; read-only steps validated")),
        (some("commands") & ~F.coalesce("requires_confirmation", F.lit(False)), "blocked", F.lit("command action does not require confirmation")),
        (some("commands") & ~some("rollback"), "blocked", F.lit("command action is missing rollback commands")),
        (some("commands") & ~some("verification"), "blocked", F.lit("command action is missing verification steps")),
        (some("commands"), "validated", F.lit("command action validated for dry-run (not executed)")),
    ]
    return actions.withColumns({
        "gate": pick([(c, g) for c, g, _ in checks], "validated"),
        "gate_reason": pick([(c, r) for c, _, r in checks], "no-op planned action validated")})


def work_items(actions: DataFrame | None, findings: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Prioritised rows from actions (else critical/high findings) plus verification outcomes."""
    owner = lambda c: F.when(c.isin(*SECURITY_CATEGORIES), "security").otherwise("network")
    prio = lookup("severity", PRIORITY, "P2")
    item = lambda d, kind, ident, p, t, o: d.select(digest_id("AI", 8, F.lit(kind), ident, null_text="None").alias("item_id"), p.alias("priority"), t.alias("action_type"), o.alias("owner"), "device", "interface", "finding_id")
    if actions is not None:
        st = F.col("status")
        plan = (st == "planned") & (F.coalesce(F.size("commands"), F.lit(0)) > 0)
        inv = F.col("action_type") == "investigation"
        d = actions.where(plan | inv | st.isin("blocked", "skipped"))
        out = item(d, "action", F.col("action_id"), F.when(plan | inv, prio).otherwise("P3"), F.when(plan, "config-plan").otherwise("investigate"), F.when(~plan & inv, owner(F.col("category"))).otherwise("network"))
    else:
        d = findings.where("status = 'open' and severity in ('critical', 'high')")
        out = item(d, "finding", F.col("finding_id"), prio, F.lit("investigate"), owner(F.col("category")))
    if verdicts is not None:
        v = F.col("verdict")
        out = out.unionByName(item(verdicts, "verification", F.col("action_id"), lookup(v, {"failed": "P1", "unknown": "P2", "passed": "P3", "not_applicable": "P3"}, "P2"),
                                   F.when(v.isin("passed", "not_applicable"), "monitor").otherwise("verify"), F.when(v.isin("passed", "not_applicable"), "ops").otherwise("network")))
    return out.withColumn("sort_key", F.concat_ws("|", "priority", "action_type", F.coalesce("device", F.lit("")), F.coalesce("interface", F.lit(""))))


def snapshot_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(snapshot, metric, n) rows over every table of a snapshot."""
    out = None
    for name, d in tables.items():
        rows = d.groupBy(SNAP).agg(F.count(F.lit(1)).alias("n")).select(SNAP, F.lit(name).alias("metric"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def timeline(stamps: DataFrame) -> DataFrame:
    """Per-step times of a snapshot, one row per step that has a time, in order."""
    steps = [c for c in stamps.columns if c != SNAP]
    pairs = F.array(*[F.struct(F.lit(c).alias("step"), F.col(c).alias("at")) for c in steps])
    return stamps.select(SNAP, F.explode(pairs).alias("p")).select(SNAP, "p.step", "p.at").where("at is not null")


def findings_view(scored: DataFrame, top: int = 10) -> DataFrame:
    """All findings with their place by severity, then risk; ``is_top`` marks the first ``top`` of a snapshot."""
    w = Window.partitionBy(SNAP).orderBy("severity_rank", F.desc("risk_score"), "finding_id")
    d = scored.withColumn("severity_rank", severity_rank("severity", SEVERITY_RANK))
    ranked = d.withColumn("position", F.row_number().over(w))
    return ranked.select(SNAP, "finding_id", "severity", "risk_score", "position", (F.col("position") <= top).alias("is_top"))


def graph_view(nodes: DataFrame, edges: DataFrame, warnings: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with device risk, edges with warning counts of their local port."""
    risk = risk_by_device(scored).select(SNAP, F.col("device").alias("node_id"), "max_risk", "findings")
    n = nodes.join(risk, [SNAP, "node_id"], "left").fillna(0, ["max_risk", "findings"])
    w = warnings.where("interface is not null").groupBy(SNAP, F.col("device").alias("local_device"), F.col("interface").alias("local_interface")).agg(F.count(F.lit(1)).alias("warnings"))
    return n, edges.join(w, [SNAP, "local_device", "local_interface"], "left").fillna(0, ["warnings"])


def actions_view(actions: DataFrame) -> DataFrame:
    return count_dimensions(actions, ["device", "risk_level", "status"])
