"""Incident correlation over a signals table, every rule grouped by run.

Membership is factorised: an incident has rows of its own, and references to signal sets of its run that many incidents
share (all attacks, a device's health signals, ...). 200 groups that all take in the same 200 signals are 200 own rows,
200 references and 200 set rows. Counts, engines and digests of a set are computed once and added to each incident that
refers to it; cross-engine pairs come from products of counts per key, so neither members nor pairs are ever listed.
Sets of one incident, and its own rows, never share a signal: each takes another engine or source type.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scalars import SEVERITY_RANK, pick, set_digest, severity_name, severity_rank
from opsframe.operators.signals import ENGINE_A, ENGINE_B, ENGINE_C, SYSLOG, canonical_iface
from opsframe.session import cut_lineage

# Tag and category lists of the rules.
DOS_FAMILIES = ["dos", "ddos", "flood"]
SATURATION = ["performance", "topology", "availability", "interface"]
DEGRADATION = ["port", "stp", "performance", "availability", "loop risk", "loop_risk", "topology"]
EXPOSURE = ["unused_port_admin_up", "trunk_without_neighbor", "trunk_unauthorized_vlan", "stp_disabled", "stp_missing", "port_up_no_description"]
VLAN_RULES = ["trunk_unauthorized_vlan", "trunk_missing_required_vlan", "wrong_access_vlan", "wrong_native_vlan"]
# Per rule, base confidence, severity boost and title.
RULES = {
    "DOS_SATURATION": (0.45, 1, "Possible attack-induced network saturation"),
    "LINK_DEGRADATION": (0.40, 0, "Possible link degradation on {}"),
    "CONFIG_EXPOSURE": (0.40, 0, "Possible exposed or misconfigured segment on {}"),
    "VLAN_POLICY_RISK": (0.42, 1, "VLAN policy risk with cyber exposure on {}"),
    "SYSLOG_SNMP_AUTH_CAMPAIGN": (0.50, 1, "Suspected SNMP authentication campaign on {}"),
    "PORT_INSTABILITY": (0.50, 1, "Port instability on {}"),
    "LOOP_OR_REDUNDANCY_INSTABILITY": (0.50, 0, "Possible switching loop or redundancy instability on {}"),
    "DUPLICATE_IP_CONFLICT": (0.55, 0, "Probable IP conflict observed on {}"),
    "POE_ENDPOINT_FAILURE": (0.50, 0, "Likely PoE/endpoint issue on {}"),
    "MANAGEMENT_ACCESS_EXPOSURE": (0.45, 0, "Management-plane access activity on {}"),
    "CLOCK_INTEGRITY_RISK": (0.40, 0, "Monitoring clock integrity risk"),
    "SINGLE_ENGINE_HIGH_RISK": (0.30, 0, "High-risk {}"),
    "SINGLE_SYSLOG_HIGH_RISK": (0.35, 0, "High-risk syslog item: {}"),
}


@dataclass(frozen=True)
class Thresholds:
    min_engines: int = 2
    min_attempts: int = 10
    min_transitions: int = 4
    min_mac_flaps: int = 3
    multi_engine_bonus: float = 0.2
    same_interface_bonus: float = 0.25
    same_device_bonus: float = 0.15
    aggregate_penalty: float = 0.2
    fallback_rank: int = 1


def classify(signals: DataFrame) -> DataFrame:
    """Rule-facing flags and matching keys, computed once per signal."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    has = lambda ws: F.arrays_overlap(tags, F.array(*[F.lit(w) for w in ws]))
    engine = F.col("engine")
    cfg = lambda ws: (engine == ENGINE_C) & (has(ws) | F.lower("category").isin(*ws))
    log = lambda t: (engine == SYSLOG) & F.coalesce(F.col("source_type") == t, F.lit(False))
    return signals.withColumns({
        "dev": F.lower(F.trim(F.coalesce("device", F.lit("")))),
        "group_dev": F.coalesce(F.nullif("device", F.lit("")), F.lit("unknown")),
        "lif": F.nullif(F.lower(F.trim("interface")), F.lit("")),
        "cif": canonical_iface(F.col("interface")),
        "w": F.greatest(F.lit(1), F.coalesce("event_count", F.lit(1))).cast("long"),
        "attack": (engine == ENGINE_A) & has(["attack"]),
        "dos": (engine == ENGINE_A) & has(DOS_FAMILIES),
        "health": (engine == ENGINE_B) & has(["anomaly", "degradation"]),
        "saturation": cfg(SATURATION), "degraded": cfg(DEGRADATION), "exposed": cfg(EXPOSURE), "vlan_issue": cfg(VLAN_RULES),
        "topo": (engine == ENGINE_C) & ((F.col("category") == "topology") | has(["topology"])),
        "auth": log("SYSLOG_SNMP_AUTH_ACTIVITY"), "flap": log("SYSLOG_PORT_FLAP"), "mac_flap": log("SYSLOG_MAC_FLAP"), "ring": log("SYSLOG_ERPS_CHURN"),
        "dup_ip": log("SYSLOG_DUPLICATE_IP"), "poe": log("SYSLOG_POE_FAULT"), "mgmt": log("SYSLOG_MANAGEMENT_ACCESS"),
        "clock": (engine == SYSLOG) & F.array_contains("tags", "clock_unreliable"),
    })


MEMBER = ["run_id", "rule_id", "key", "place", "cap", "signal_id"]
INCIDENT = ["run_id", "rule_id", "key"]
ENGINES = [ENGINE_A, ENGINE_B, ENGINE_C, SYSLOG]
#: What the scores read of a signal.
FACTS = ["dev", "device", "interface", "lif", "cif", "engine", "severity", "aggregate", "clock_unreliable", "entity_confident", "confidence_label", "title", "source_artifact"]


@dataclass(frozen=True)
class Membership:
    """``own``: MEMBER and FACTS; ``refs``: INCIDENT, place, cap, set_id; ``sets``: run_id, set_id, signal_id and FACTS."""

    own: DataFrame
    refs: DataFrame
    sets: DataFrame

    def rows(self) -> DataFrame:
        """All members one by one, for reports on few incidents; the scores don't use it."""
        shared = expand(self.refs.select("run_id", "set_id", "rule_id", "key", "place", "cap"), self.sets.select("run_id", "set_id", "signal_id"))
        return self.own.select(MEMBER).unionByName(shared.select(MEMBER))

    def covered(self) -> DataFrame:
        """``run_id, signal_id`` of every signal in some incident."""
        used = self.sets.join(self.refs.select("run_id", "set_id").distinct(), ["run_id", "set_id"], "left_semi")
        return self.own.select("run_id", "signal_id").unionByName(used.select("run_id", "signal_id")).distinct()


#: Rows of a set that are paired at a time, and parts that number them.
BLOCK, PARTS = 1024, 8


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """The rows of every (run, set) in lists of at most BLOCK, which ``name``_at tells apart."""
    d = rows.select("run_id", "set_id", F.struct(*[c for c in rows.columns if c not in ("run_id", "set_id")]).alias(name))
    d = d.withColumn("_part", F.pmod(F.xxhash64(name), F.lit(PARTS)))
    at = ["run_id", "set_id", "_part"]
    d = d.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*at).orderBy(name)) - 1) / BLOCK))
    return d.groupBy(*at, "_block").agg(F.collect_list(name).alias(name)).select("run_id", "set_id", F.struct("_part", "_block").alias(f"{name}_at"), name)


def expand(refs: DataFrame, sets: DataFrame) -> DataFrame:
    """Every reference with every row of its set, without ``set_id``.

    The result grows with references times members, so lists of both are joined, dealt evenly over the tasks and only then
    listed: what is shuffled is a thousandth of the result, and no task has one set's pairs alone. Generated code keeps all rows
    that come of one input row, a million for two lists; the filter isn't compiled, so only those of one reference are kept.
    """
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _blocks(refs, "ref").join(_blocks(sets, "row"), ["run_id", "set_id"]).repartition(tasks, "run_id", "set_id", "ref_at", "row_at")
    each = pairs.select("run_id", F.explode(F.filter("ref", lambda r: r.isNotNull())).alias("ref"), "row")
    return each.select("run_id", *[F.col(f"ref.{c}") for c in refs.columns if c not in ("run_id", "set_id")], F.inline("row"))


def set_name(kind: str, *keys: Column) -> Column:
    """Id of a shared set; null if a key is."""
    return F.concat(F.lit(kind), *[x for k in keys for x in (F.lit("\x1f"), k)])


#: The sets that a rule's incidents take in; the other rules take none.
TAKES = {
    "LINK_DEGRADATION": ["health"], "CONFIG_EXPOSURE": ["attack"], "VLAN_POLICY_RISK": ["attack"], "SYSLOG_SNMP_AUTH_CAMPAIGN": ["attack"],
    "PORT_INSTABILITY": ["health of device", "config"], "DUPLICATE_IP_CONFLICT": ["moves"], "POE_ENDPOINT_FAILURE": ["flaps", "config"],
    "MANAGEMENT_ACCESS_EXPOSURE": ["access", "attack"],
}


def _set_names(dev: Column) -> dict[str, Column]:
    """Ids of the sets by kind, from a row's device, port and interface."""
    cif, raw_if = F.col("cif"), F.nullif("interface", F.lit(""))
    return {
        "attack": set_name("attack"), "health": set_name("health"), "health of device": set_name("health", dev), "config": set_name("config", dev, cif),
        "moves": set_name("moves", dev), "flaps": set_name("flaps", raw_if), "access": set_name("access", dev),
    }


def shared_sets(c: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """Every signal once per set that it belongs to; with ``rules`` those that they take."""
    conds = {
        "attack": F.col("attack"), "health": F.col("health"), "health of device": F.col("health"), "config": F.col("engine") == ENGINE_C,
        "moves": F.col("mac_flap"), "flaps": F.col("flap"), "access": F.col("auth") | F.col("exposed"),
    }
    if rules is not None:
        conds = {k: cond for k, cond in conds.items() if any(k in TAKES.get(r, []) for r in rules)}
    c = c.where(functools.reduce(lambda x, y: x | y, conds.values(), F.lit(False)))
    names = F.array_compact(F.array(*[F.when(cond, _set_names(F.col("dev"))[k]) for k, cond in conds.items()]).cast("array<string>"))
    return c.select("run_id", F.explode(names).alias("set_id"), "signal_id", *FACTS)


def _by_device(rule: str) -> tuple[str, Column, Column, Column]:
    return rule, F.col("group_dev"), F.col("group_dev"), F.lit(None).cast("string")


def _by_signal(rule: str) -> tuple[str, Column, Column, Column]:
    return rule, F.col("signal_id"), F.coalesce(F.nullif("interface", F.lit("")), "group_dev"), F.lit(None).cast("string")


def own_rows(c: DataFrame, t: Thresholds = Thresholds(), rules: Sequence[str] | None = None) -> DataFrame:
    """The rows that rules take by a signal's own flags and by totals of its run and device, of all rules in one pass.

    Only totals that the rules ask for are joined.
    """
    flags = ("attack", "dos", "health", "degraded", "saturation")
    runs = c.groupBy("run_id").agg(*[F.bool_or(f).alias(f"any_{f}") for f in flags])
    auths = c.where("auth").groupBy("run_id", "group_dev").agg(F.sum("w").alias("auth_n"))
    loops = c.where("dev <> '' and (mac_flap or ring or topo)").groupBy("run_id", "dev").agg(
        F.bool_or("mac_flap").alias("has_mac"), F.bool_or("ring").alias("has_ring"), F.bool_or("topo").alias("has_topo"),
        F.sum(F.when(F.col("mac_flap"), F.col("w")).otherwise(0)).alias("moves"))
    wanted, d = set(RULES if rules is None else rules), c.where("run_id is not null")
    if wanted & {"DOS_SATURATION", "LINK_DEGRADATION", "VLAN_POLICY_RISK"}:
        d = d.join(runs, "run_id")
    if "SYSLOG_SNMP_AUTH_CAMPAIGN" in wanted:
        d = d.join(auths, ["run_id", "group_dev"], "left")
    if "LOOP_OR_REDUNDANCY_INSTABILITY" in wanted:
        d = d.join(loops, ["run_id", "dev"], "left")
    col, none = F.col, F.lit(None).cast("string")
    attacked = col("any_attack") | col("any_dos")
    engines = 2 + col("any_saturation").cast("int")  # intrusion and health signals are there, or the rule doesn't hold
    saturating = (col("any_dos") & col("dos")) | (~col("any_dos") & col("attack")) | col("health") | col("saturation")
    looping = (col("has_mac") | col("has_ring")) & (col("has_ring") | (col("moves") >= t.min_mac_flaps)) & (col("mac_flap") | col("ring") | col("topo"))
    sources = col("has_mac").cast("int") + col("has_ring").cast("int") + col("has_topo").cast("int")
    own = [
        (attacked & col("any_health") & (engines >= t.min_engines) & saturating, ("DOS_SATURATION", F.lit("run"), F.lit(""), none)),
        (col("degraded") & ~col("any_attack") & col("any_health"), _by_device("LINK_DEGRADATION")),
        (col("exposed"), _by_device("CONFIG_EXPOSURE")),
        (col("vlan_issue") & col("any_attack"), _by_device("VLAN_POLICY_RISK")),
        (col("auth") & (col("auth_n") >= t.min_attempts), _by_device("SYSLOG_SNMP_AUTH_CAMPAIGN")),
        (col("flap") & (col("w") >= t.min_transitions), _by_signal("PORT_INSTABILITY")),
        (looping, ("LOOP_OR_REDUNDANCY_INSTABILITY", col("dev"), col("dev"), F.when(sources < 2, "high"))),
        (col("dup_ip"), (*_by_device("DUPLICATE_IP_CONFLICT")[:3], F.lit("high"))),
        (col("poe"), _by_signal("POE_ENDPOINT_FAILURE")),
        (col("mgmt"), _by_device("MANAGEMENT_ACCESS_EXPOSURE")),
        (col("clock"), ("CLOCK_INTEGRITY_RISK", F.lit("run"), F.lit(""), none)),
    ]
    own = [(cond, row) for cond, row in own if row[0] in wanted]
    hits = [
        F.when(cond, F.struct(F.lit(rule).alias("rule_id"), key.cast("string").alias("key"), place.cast("string").alias("place"), cap.cast("string").alias("cap")))
        for cond, (rule, key, place, cap) in own]
    d = d.where(functools.reduce(lambda x, y: x | y, [cond for cond, _ in own]))
    return d.select("run_id", F.explode(F.array_compact(F.array(*hits))).alias("m"), "signal_id", "group_dev", *FACTS).select(
        "run_id", "m.*", "signal_id", "group_dev", *FACTS)


def set_refs(own: DataFrame) -> DataFrame:
    """The sets that each group of own rows takes in, one row each."""
    kinds = _set_names(F.lower(F.trim("group_dev")))
    names = pick([(F.col("rule_id") == r, F.array_compact(F.array(*[kinds[k] for k in ks]))) for r, ks in TAKES.items()], F.array().cast("array<string>"))
    return own.select(*INCIDENT, "place", "cap", F.explode(names).alias("set_id")).distinct()


def cross_members(c: DataFrame, t: Thresholds = Thresholds(), rules: Sequence[str] | None = None) -> Membership:
    """Membership of all cross-engine rules, or of the named ones."""
    own = own_rows(c, t, rules)
    sets = shared_sets(c, rules)
    refs = set_refs(own).join(sets.select("run_id", "set_id").distinct(), ["run_id", "set_id"], "left_semi")
    return Membership(own.drop("group_dev"), refs, sets)


def _rule(name: str) -> Callable[..., Membership]:
    def members(c: DataFrame, t: Thresholds = Thresholds()) -> Membership:
        return cross_members(cut_lineage(c), t, [name])  # own rows and sets read it

    return members


rule_saturation = _rule("DOS_SATURATION")  # denial-of-service tagged (else any) attacks with health anomalies, per run
rule_link_degradation = _rule("LINK_DEGRADATION")  # degraded devices of a run with health anomalies and no attack
rule_exposure = _rule("CONFIG_EXPOSURE")  # exposed devices with the run's attacks
rule_vlan_risk = _rule("VLAN_POLICY_RISK")  # VLAN issues of a device in a run with attacks
rule_auth_campaign = _rule("SYSLOG_SNMP_AUTH_CAMPAIGN")  # devices with many failed authentications
rule_port_instability = _rule("PORT_INSTABILITY")  # one flap report with its device's health and its port's configuration
rule_loop = _rule("LOOP_OR_REDUNDANCY_INSTABILITY")  # moving addresses, ring churn and topology findings of a device
rule_duplicate_ip = _rule("DUPLICATE_IP_CONFLICT")  # a device's address conflicts and its moving addresses
rule_poe = _rule("POE_ENDPOINT_FAILURE")  # one power fault with flaps of that interface name on any device, and its port's configuration
rule_mgmt_exposure = _rule("MANAGEMENT_ACCESS_EXPOSURE")  # management access with the device's exposure and the run's attacks
rule_clock = _rule("CLOCK_INTEGRITY_RISK")  # signals with unreliable clocks, per run


def rule_uncovered(c: DataFrame, covered: Membership, t: Thresholds = Thresholds()) -> DataFrame:
    """High and critical signals in no earlier incident: engines A to C, then logs.

    The two fallbacks look at different engines, so one anti-join serves both.
    """
    risky = c.where(severity_rank("severity") <= t.fallback_rank)
    free = risky.join(covered.covered(), ["run_id", "signal_id"], "left_anti")
    log = F.col("engine") == SYSLOG
    return free.select(
        "run_id", F.when(log, "SINGLE_SYSLOG_HIGH_RISK").otherwise("SINGLE_ENGINE_HIGH_RISK").alias("rule_id"), F.col("signal_id").alias("key"),
        F.when(log, F.col("title")).otherwise(F.concat("engine", F.lit(" item: "), "title")).alias("place"), F.lit(None).cast("string").alias("cap"), "signal_id", *FACTS)


ENTITY = ["dev", "device", "interface", "lif", "cif"]
#: Totals of members that add up over an incident's own rows and its sets.
TOTALS = {
    "n_signals": F.sum, "base_rank": F.min, "any_agg": F.bool_or, "aggregate_only": F.bool_and, "syslog_signals": F.sum, "any_clock": F.bool_or, "all_clock": F.bool_and,
    "low_evidence": F.bool_or, "unsure_entities": F.bool_or, "digest": lambda c: F.sum(c).cast("decimal(38,0)"), **{f"has_{e}": F.max for e in ENGINES},
}


def member_totals(rows: DataFrame, *by: str) -> DataFrame:
    one = {
        "n_signals": F.lit(1).cast("long"), "base_rank": severity_rank("severity"), "any_agg": F.col("aggregate"), "aggregate_only": F.col("aggregate"),
        "syslog_signals": (F.col("engine") == SYSLOG).cast("long"), "any_clock": F.col("clock_unreliable"), "all_clock": F.col("clock_unreliable"),
        "low_evidence": F.coalesce(F.col("confidence_label") == "low", F.lit(False)), "unsure_entities": ~F.col("entity_confident"),
        **{f"has_{e}": (F.col("engine") == e).cast("int") for e in ENGINES},
    }
    given = rows.select(*by, "signal_id", *[e.alias(n) for n, e in one.items()])
    return given.groupBy(*by).agg(*[(set_digest("signal_id") if n == "digest" else f(n)).alias(n) for n, f in TOTALS.items()])


def incident_totals(m: Membership) -> DataFrame:
    """TOTALS of every incident: its own rows and the sets it refers to."""
    own = member_totals(m.own, *INCIDENT, "place", "cap")
    shared = m.refs.join(member_totals(m.sets, "run_id", "set_id"), ["run_id", "set_id"]).select(own.columns)
    return own.unionByName(shared).groupBy(*INCIDENT).agg(
        F.min("place").alias("place"), F.max("cap").alias("cap"), *[f(n).alias(n) for n, f in TOTALS.items()])


def _kinds() -> dict[str, list[Column]]:
    """Keys that two members may agree on."""
    has_if = F.col("lif").isNotNull()
    dev = F.nullif("dev", F.lit(""))
    return {
        "p_all": [F.lit("")], "p_dev": [dev], "p_if": [F.col("lif")], "p_dev_if": [dev, F.col("lif")],
        "p_dev_cif": [dev, F.when(has_if, F.col("cif"))], "p_dev_any": [dev, F.when(has_if, F.lit("any"))],
        "p_same_if": [F.nullif("interface", F.lit(""))], "p_same_dev": [F.nullif("device", F.lit(""))],
    }


KINDS = ["p_all", "p_dev", "p_if", "p_dev_if", "p_dev_cif", "p_dev_any", "p_same_if", "p_same_dev"]
PAIRS = "decimal(38,0)"


def key_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Members per kind of key, key and engine (``e0`` to ``e3``), combined by entity before the kinds are expanded."""
    fine = rows.groupBy(*by, *ENTITY).agg(*[F.count_if(F.col("engine") == e).alias(f"e{i}") for i, e in enumerate(ENGINES)])
    slots = []
    for kind, ks in _kinds().items():
        known = ks[0].isNotNull()
        for k in ks[1:]:
            known = known & k.isNotNull()
        slots.append(F.when(known, F.struct(F.lit(kind).alias("kind"), F.array(*ks).alias("k"))))
    sums = [f"e{i}" for i in range(len(ENGINES))]
    d = fine.select(*by, F.explode(F.array_compact(F.array(*slots))).alias("s"), *sums).select(*by, "s.kind", "s.k", *sums)
    return d.groupBy(*by, "kind", "k").agg(*[F.sum(x).cast("decimal(18,0)").alias(x) for x in sums])


def _product(a: str, b: str) -> Column:
    """Pairs of one member of ``a`` and one of ``b`` under a key that come from different engines."""
    total = lambda t: functools.reduce(lambda x, y: x + y, [F.col(f"{t}.e{i}") for i in range(len(ENGINES))])
    same = functools.reduce(lambda x, y: x + y, [F.col(f"{a}.e{i}") * F.col(f"{b}.e{i}") for i in range(len(ENGINES))])
    return (total(a) * total(b) - same).cast(PAIRS)


def pair_counts(m: Membership) -> DataFrame:
    """Pair counts of every incident; those of a single own row that agree on its entity, its engine and the sets are counted once."""
    by = [*ENTITY, "engine"]
    lone = m.own.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in by]).where("_n = 1").dropna(subset=INCIDENT)
    lone = lone.join(_taken(m.refs), INCIDENT, "left").select(*INCIDENT, F.to_json(F.struct(*by, "taken")).alias("_like"))  # a null has no field
    lone = cut_lineage(lone)
    first = lone.groupBy("run_id", "_like").agg(F.min(F.struct("rule_id", "key")).alias("_first"))
    alike = lone.join(first, ["run_id", "_like"]).where(F.struct("rule_id", "key") != F.col("_first"))
    alike = cut_lineage(alike.select(*INCIDENT, F.col("_first.rule_id").alias("_rule"), F.col("_first.key").alias("_key")))
    rest = Membership(m.own.join(alike, INCIDENT, "left_anti"), m.refs.join(alike, INCIDENT, "left_anti"), m.sets)
    counted = cut_lineage(_pair_counts(rest))
    given = counted.select("run_id", F.col("rule_id").alias("_rule"), F.col("key").alias("_key"), *KINDS)
    return counted.unionByName(alike.join(given, ["run_id", "_rule", "_key"]).select(*INCIDENT, *KINDS))


def _pair_counts(m: Membership) -> DataFrame:
    """Ordered cross-engine member pairs that agree on each kind of key, without forming a pair.

    Of two parts a and b of an incident there are a*b - sum over engines of a_e*b_e under a key: own rows with own rows, own
    rows with each set under the own rows' keys, each set with itself once for all incidents, and each two sets that occur
    together once, under the keys of the narrower one.
    """
    at = ["run_id", "set_id"]
    own, sets = key_counts(m.own, *INCIDENT), cut_lineage(key_counts(m.sets.join(m.refs.select(*at).distinct(), at, "left_semi"), *at))
    own = cut_lineage(own)
    within = own.alias("a").select(*INCIDENT, "kind", _product("a", "a").alias("n"))
    links = m.refs.select(*INCIDENT, "set_id")
    taken = own.join(links, INCIDENT)
    with_sets = taken.alias("a").join(sets.alias("b"), [*at, "kind", "k"]).select(*INCIDENT, "kind", (2 * _product("a", "b")).cast(PAIRS).alias("n"))
    alone = sets.alias("a").groupBy(*at, "kind").agg(F.sum(_product("a", "a")).cast(PAIRS).alias("n"))
    alone = links.join(alone, at).select(*INCIDENT, "kind", "n")
    width = lambda c: F.struct(F.size(F.split(c, "\x1f")), c)
    two = links.alias("x").join(links.withColumnRenamed("set_id", "other").alias("y"), INCIDENT).where(width(F.col("set_id")) > width(F.col("other")))
    met = two.select("run_id", "set_id", "other").distinct().join(sets, at)
    broad = sets.withColumnRenamed("set_id", "other")
    between = met.alias("a").join(broad.alias("b"), ["run_id", "other", "kind", "k"]).groupBy("run_id", "set_id", "other", "kind").agg(F.sum(2 * _product("a", "b")).cast(PAIRS).alias("n"))
    between = two.select(*INCIDENT, "set_id", "other").join(between, ["run_id", "set_id", "other"]).select(*INCIDENT, "kind", "n")
    every = within.unionByName(with_sets).unionByName(alone).unionByName(between)
    return every.groupBy(*INCIDENT).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast(PAIRS).alias(k) for k in KINDS])


def incident_quality(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Time reliability and the worst entity match over cross-engine pairs, from pair counts only."""
    elsewhere = F.col("p_if") - F.col("p_dev_if")
    worst = pick([
        (F.col("p_all") == 0, "n/a"), (F.col("p_all") - F.col("p_dev") - elsewhere > 0, "none"),
        (elsewhere + F.col("p_dev_any") - F.col("p_dev_cif") > 0, "uncertain"), (F.col("p_dev_cif") - F.col("p_dev_if") > 0, "normalized"),
    ], "exact")
    clock = pick([(F.col("all_clock"), "unreliable"), (F.col("any_clock"), "approximate")], "reliable")
    return totals.join(pairs, INCIDENT).select(*INCIDENT, clock.alias("time_reliability"), worst.alias("entity_match"))


def score_incidents(totals: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Severity, confidence, factors and a set-based id per incident; copies with the same members collapse."""
    g = totals.join(pairs.select(*INCIDENT, (F.col("p_same_if") > 0).alias("same_if"), (F.col("p_same_dev") > 0).alias("same_dev")), INCIDENT)
    n_eng = sum((F.col(f"has_{e}") for e in ENGINES[1:]), F.col(f"has_{ENGINES[0]}"))
    rule = F.col("rule_id")
    base = pick([(rule == k, v[0]) for k, v in RULES.items()])
    boost = F.when(n_eng >= 2, pick([(rule == k, v[1]) for k, v in RULES.items()])).otherwise(0) + F.col("same_if").cast("int")
    raised = F.greatest(F.lit(0), F.least(F.col("base_rank"), F.lit(4)) - boost)
    final = F.greatest(raised, F.coalesce(severity_rank("cap") * F.col("cap").isNotNull().cast("int"), F.lit(0)))
    score = base + t.multi_engine_bonus * (n_eng - 1) + F.when(F.col("same_if"), t.same_interface_bonus).otherwise(0.0) \
        + F.when(F.col("same_dev"), t.same_device_bonus).otherwise(0.0) - F.when(F.col("any_agg"), t.aggregate_penalty).otherwise(0.0)
    title = pick([(rule == k, F.replace(F.lit(v[2]), F.lit("{}"), F.col("place"))) for k, v in RULES.items()])
    scored = g.withColumns({
        "severity": severity_name(final), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "n_engines": n_eng, "title": title,
        "engines": F.array_compact(F.array(*[F.when(F.col(f"has_{e}") == 1, e) for e in ENGINES])),
        "incident_id": F.concat(F.lit("INC-"), F.substring(F.sha1(F.concat_ws("|", "run_id", "rule_id", F.col("n_signals").cast("string"), F.col("digest").cast("string"))), 1, 10)),
        "factors": F.array_compact(F.array(
            F.concat(F.lit("max_signal_severity="), severity_name(F.col("base_rank"))),
            F.when((n_eng >= 2) & (boost - F.col("same_if").cast("int") > 0), "multi_engine_boost=+1"), F.when(F.col("same_if"), "interface_alignment=+1"),
            F.when(raised < final, F.concat(F.lit("severity_cap="), F.col("cap"))),
        )),
    })
    cols = ["run_id", "incident_id", "rule_id", "key", "title", "severity", "confidence", "engines", "n_engines", "n_signals", "syslog_signals", "aggregate_only", "low_evidence", "unsure_entities", "factors"]
    rest = [c for c in cols if c not in ("run_id", "incident_id")]
    first = scored.groupBy("run_id", "incident_id").agg(F.min_by(F.struct(*rest), "key").alias("i"))
    return first.select("run_id", "incident_id", "i.*").select(*cols)


def _taken(refs: DataFrame) -> DataFrame:
    """The sets of each incident as one text."""
    return refs.groupBy(*INCIDENT).agg(F.array_join(F.sort_array(F.collect_set("set_id")), "\x1e").alias("taken"))


def incident_evidence(m: Membership) -> DataFrame:
    """Per incident and engine: signals, distinct titles and artefacts.

    Sets that incidents take together are counted once for all of them; an incident adds those of its own titles and artefacts
    that its sets don't have, so no set is listed per incident.
    """
    taken = cut_lineage(_taken(m.refs))
    combos = taken.select("run_id", "taken").distinct().select("run_id", "taken", F.explode(F.split("taken", "\x1e")).alias("set_id"))
    shared = m.sets.groupBy("run_id", "set_id", "engine", "title", "source_artifact").agg(F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(combos.join(shared, ["run_id", "set_id"]).groupBy("run_id", "taken", "engine", "title", "source_artifact").agg(F.sum("n").alias("n")))
    own = m.own.groupBy(*INCIDENT, "engine", "title", "source_artifact").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(taken, INCIDENT, "left").withColumn("taken", F.coalesce("taken", F.lit("")))

    def unseen(what: str) -> DataFrame:
        """Distinct own values with their signals, and whether the sets lack them."""
        known = shared.select("run_id", "taken", "engine", F.col(what).alias("_known")).distinct().withColumn("_met", F.lit(True)).alias("k")
        mine = own.groupBy(*INCIDENT, "taken", "engine", what).agg(F.sum("n").alias("n")).alias("o")
        same = [F.col(f"o.{c}") == F.col(f"k.{c}") for c in ("run_id", "taken", "engine")]
        return mine.join(known, [*same, F.col(f"o.{what}").eqNullSafe(F.col("k._known"))], "left").select("o.*", F.col("_met").isNull().alias("new"))

    none = F.lit(0).cast("long")
    by = [*INCIDENT, "engine"]
    titles = unseen("title").groupBy(*by).agg(F.sum("n").alias("signals"), F.count_if("new").alias("titles"), F.min("title").alias("first_title"), F.lit(0).cast("long").alias("artifacts"))
    arts = unseen("source_artifact").groupBy(*by).agg(F.count_if(F.col("new") & F.col("source_artifact").isNotNull()).alias("artifacts"))
    arts = arts.select(*by, none.alias("signals"), none.alias("titles"), F.lit(None).cast("string").alias("first_title"), "artifacts")
    sets = shared.groupBy("run_id", "taken", "engine", "title").agg(F.sum("n").alias("n")).groupBy("run_id", "taken", "engine").agg(
        F.sum("n").alias("signals"), F.count(F.lit(1)).alias("titles"), F.min("title").alias("first_title"))
    files = shared.groupBy("run_id", "taken", "engine").agg(F.count_distinct("source_artifact").alias("artifacts"))
    sets = taken.join(sets.join(files, ["run_id", "taken", "engine"]), ["run_id", "taken"]).select(*titles.columns)
    every = titles.unionByName(arts).unionByName(sets).dropna(subset=by).groupBy(*by)
    return every.agg(F.sum("signals").alias("signals"), F.sum("titles").alias("titles"), F.min("first_title").alias("first_title"), F.sum("artifacts").alias("artifacts"))


def evidence_items(m: Membership, incidents: DataFrame) -> DataFrame:
    """The evidence of the given incidents as a long table: one row per signal with the incident's keys, engine, title and artefact."""
    keep = ["engine", "signal_id", "title", "source_artifact"]
    named = incidents.select(*INCIDENT, "incident_id")
    own = named.join(m.own.select(*INCIDENT, *keep), INCIDENT)
    taken = named.join(m.refs.select(*INCIDENT, "set_id").distinct(), INCIDENT)
    used = m.sets.join(taken.select("run_id", "set_id").distinct(), ["run_id", "set_id"], "left_semi")
    return own.unionByName(expand(taken, used.select("run_id", "set_id", *keep)))


def correlate(signals: DataFrame, t: Thresholds = Thresholds()) -> tuple[DataFrame, Membership]:
    """Incidents and membership of every run; a signal that comes twice counts once."""
    c = cut_lineage(classify(signals).dropDuplicates(["run_id", "signal_id"]))  # own rows, sets and fallbacks read it
    cross = cross_members(c, t)
    cross = Membership(cut_lineage(cross.own), cut_lineage(cross.refs), cross.sets)
    m = Membership(cross.own.unionByName(rule_uncovered(c, cross, t)), cross.refs, cross.sets)
    totals = cut_lineage(incident_totals(m))
    pairs = cut_lineage(pair_counts(m))
    incidents = score_incidents(totals, pairs, t).join(incident_quality(totals, pairs), INCIDENT, "left")
    return incidents.withColumn("severity_rank", severity_rank("severity", SEVERITY_RANK)), m


def summarize_incidents(incidents: DataFrame) -> DataFrame:
    """(run_id, dimension, value, n): severity, rule and multi-engine counts."""
    d = incidents.withColumn("multi_engine", F.col("n_engines") > 1).withColumn("has_log_evidence", F.col("syslog_signals") > 0)
    dims = ["severity", "rule_id", "multi_engine", "has_log_evidence"]
    fine = d.groupBy("run_id", *dims).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).cast("string").alias("value")) for x in dims])
    return fine.select("run_id", "n", F.explode(pairs).alias("p")).groupBy("run_id", "p.dimension", "p.value").agg(F.sum("n").alias("n"))

