"""Topology tables from neighbour reports: nodes, edges and warnings per snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import digest_id, lookup

# Interface prefixes; any other prefix is cut to two letters.
PREFIXES = {
    "gigabitethernet": "gi", "gig": "gi", "gi": "gi", "tengigabitethernet": "te", "te": "te",
    "fortygigabitethernet": "fo", "fo": "fo", "fastethernet": "fa", "fa": "fa",
    "ethernet": "eth", "eth": "eth", "et": "et", "port": "port", "po": "po", "portchannel": "po",
}
SNAP = "snapshot_id"
WARNING = [SNAP, "warning_id", "severity", "category", "message", "device", "interface"]


def norm_device(c: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit("."), F.lit(1))))


def norm_iface(c: Column) -> Column:
    token = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    prefix = F.regexp_extract(token, "^([a-z]+)", 1)
    rest = F.regexp_extract(token, "^[a-z]+(.*)$", 1)
    return F.when(prefix == "", token).otherwise(F.concat(F.coalesce(lookup(prefix, PREFIXES), F.substring(prefix, 1, 2)), rest))


def nodes(devices: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Captured devices, then remote-only devices as first reported."""
    local = devices.select(SNAP, norm_device(F.col("device")).alias("node"), F.col("device").alias("node_id"), "hostname", F.lit("local").alias("source"))
    seen = neighbors.withColumn("node", norm_device(F.col("remote_device"))).where("node <> ''").join(local.select(SNAP, "node"), [SNAP, "node"], "left_anti")
    first = seen.groupBy(SNAP, "node").agg(F.min_by(F.struct("remote_device", "protocol"), "ord").alias("f"))
    return local.unionByName(first.select(SNAP, "node", F.col("f.remote_device").alias("node_id"), F.col("f.remote_device").alias("hostname"), F.col("f.protocol").alias("source")))


def ports(neighbors: DataFrame) -> DataFrame:
    """One row per local port: protocols merged, longest remote name, first remote port."""
    n = neighbors.select("*", norm_device(F.col("device")).alias("ld"), norm_iface(F.col("local_interface")).alias("li"))
    longest = F.struct(-F.length(F.coalesce("remote_device", F.lit(""))), "ord")
    g = n.groupBy(SNAP, "ld", "li").agg(
        F.min_by("device", "ord").alias("local_device"), F.min_by("local_interface", "ord").alias("local_interface"),
        F.min_by("remote_device", longest).alias("remote_device"),
        F.min_by("remote_interface", F.when(F.coalesce("remote_interface", F.lit("")) != "", F.col("ord"))).alias("remote_interface"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
    )
    return g.withColumns({"rd": norm_device(F.col("remote_device")), "ri": norm_iface(F.col("remote_interface"))})


def edges(neighbors: DataFrame) -> DataFrame:
    """Port rows with A→B and B→A folded into one bidirectional edge."""
    p = ports(neighbors)
    back = p.select(SNAP, F.col("ld").alias("rd"), F.col("li").alias("ri"), F.col("rd").alias("b_rd"), F.col("ri").alias("b_ri"), F.col("protocols").alias("b_protocols"))
    j = p.join(back, [SNAP, "rd", "ri"], "left")
    here, there = F.struct("ld", "li"), F.struct(F.col("rd").alias("ld"), F.col("ri").alias("li"))
    mutual = F.coalesce((F.col("b_rd") == F.col("ld")) & (F.col("b_ri") == F.col("li")) & (here != there), F.lit(False))
    merged = F.array_sort(F.array_union("protocols", F.coalesce("b_protocols", F.array().cast("array<string>"))))
    return j.withColumn("bidirectional", mutual).where(~F.col("bidirectional") | (here < there)).select(
        SNAP, "local_device", "local_interface", "remote_device", "remote_interface", "ld", "li", "rd", "ri", "bidirectional",
        F.array_join(F.when(mutual, merged).otherwise(F.col("protocols")), "+").alias("discovery_protocol"), F.lit("high").alias("confidence"))


def _warn(df: DataFrame, severity: str, category: str, message: Column, device: str = "device", interface: str | None = "interface") -> DataFrame:
    iface = (F.col(interface) if interface else F.lit(None)).cast("string")
    return df.select(SNAP, digest_id("TW", 8, F.lit(category), device, iface, message).alias("warning_id"), F.lit(severity).alias("severity"),
                     F.lit(category).alias("category"), message.alias("message"), F.col(device).alias("device"), iface.alias("interface"))


def warn_discovery(neighbors: DataFrame) -> DataFrame:
    """Port seen by one protocol only, on devices that ran both."""
    both = neighbors.where("protocol in ('lldp', 'cdp')").groupBy(SNAP, "device").agg(F.count_distinct("protocol").alias("k")).where("k = 2")
    per = neighbors.withColumn("interface", norm_iface(F.col("local_interface"))).groupBy(SNAP, "device", "interface").agg(
        F.min("protocol").alias("seen"), F.max("protocol").alias("last")).where("seen = last")
    missing = F.when(F.col("seen") == "lldp", "cdp").otherwise("lldp")
    text = F.concat(F.lit("Neighbour on "), F.col("interface"), F.lit(" seen via "), F.col("seen"), F.lit(" but not "), missing, F.lit(" (possible protocol mismatch)."))
    return _warn(per.join(both, [SNAP, "device"], "left_semi"), "info", "discovery", text)


def warn_unidirectional(edge: DataFrame, devices: DataFrame) -> DataFrame:
    known = devices.select(SNAP, norm_device(F.col("device")).alias("rd")).distinct()
    d = edge.where("not bidirectional and rd <> ld").join(known, [SNAP, "rd"], "left_semi")
    text = F.concat(F.lit("Neighbour relationship "), F.col("local_device"), F.lit(" -> "), F.col("remote_device"), F.lit(" appears unidirectional (reverse link not discovered)."))
    return _warn(d, "warning", "topology", text, "local_device", "local_interface")


def trunk_ports(interfaces: DataFrame, trunks: DataFrame) -> DataFrame:
    own = interfaces.where("mode = 'trunk'").select(SNAP, "device", F.col("name").alias("interface"))
    return trunks.select(SNAP, "device", "interface").unionByName(own).distinct().withColumns({"ld": norm_device(F.col("device")), "li": norm_iface(F.col("interface"))})


def edge_ports(edge: DataFrame) -> DataFrame:
    return edge.select(SNAP, "ld", "li").unionByName(edge.where("bidirectional").select(SNAP, F.col("rd").alias("ld"), F.col("ri").alias("li"))).distinct()


def warn_trunk_alone(interfaces: DataFrame, trunks: DataFrame, edge: DataFrame) -> DataFrame:
    d = trunk_ports(interfaces, trunks).join(edge_ports(edge), [SNAP, "ld", "li"], "left_anti")
    text = F.concat(F.lit("Trunk port "), F.col("interface"), F.lit(" has no discovered LLDP/CDP neighbour (candidate unmanaged neighbour or misconfiguration)."))
    return _warn(d, "warning", "topology", text)


def macs_per_access_port(macs: DataFrame, interfaces: DataFrame, threshold: int) -> DataFrame:
    """Access ports with more distinct addresses than the threshold; distinct pairs combine before the shuffle."""
    n = macs.where("coalesce(interface, '') <> ''").groupBy(SNAP, "device", "interface").agg(F.count_distinct("mac_address").alias("n")).where(F.col("n") > threshold)
    access = interfaces.where("mode = 'access'").select(SNAP, "device", F.col("name").alias("interface")).distinct()
    return n.join(access, [SNAP, "device", "interface"], "left_semi")


def macs_on_several(macs: DataFrame) -> DataFrame:
    pairs = macs.where("coalesce(interface, '') <> ''").select(SNAP, "device", "mac_address", "interface").distinct()
    return pairs.groupBy(SNAP, "device", "mac_address").agg(F.count(F.lit(1)).alias("n_interfaces"), F.min("interface").alias("first_interface"), F.max("interface").alias("last_interface")).where("n_interfaces > 1")


def warn_mac(macs: DataFrame, interfaces: DataFrame, threshold: int = 5) -> DataFrame:
    port = macs_per_access_port(macs, interfaces, threshold)
    a = _warn(port, "warning", "topology", F.concat(F.lit("Access port "), F.col("interface"), F.lit(" has "), F.col("n").cast("string"), F.lit(f" MAC(s) (> threshold {threshold}); possible unmanaged switch/hub downstream.")))
    b = _warn(macs_on_several(macs), "warning", "loop_risk", F.concat(F.lit("MAC "), F.col("mac_address"), F.lit(" learned on "), F.col("n_interfaces").cast("string"), F.lit(" interfaces; possible loop, flapping or duplicate learning.")), interface=None)
    return a.unionByName(b)


def blocked_access(stp: DataFrame, interfaces: DataFrame) -> DataFrame:
    access = interfaces.where("mode = 'access'").select(SNAP, "device", F.col("name").alias("interface")).distinct()
    return stp.where("state = 'blocking'").join(access, [SNAP, "device", "interface"], "left_semi")


def warn_stp(stp: DataFrame, interfaces: DataFrame, trunks: DataFrame) -> DataFrame:
    a = _warn(blocked_access(stp, interfaces), "warning", "stp", F.concat(F.lit("STP is blocking on access port "), F.col("interface"), F.lit(" (unexpected).")))
    have = stp.select(SNAP, "device", norm_iface(F.col("interface")).alias("li")).distinct()
    quiet = trunk_ports(interfaces, trunks).join(have, [SNAP, "device", "li"], "left_anti")
    return a.unionByName(_warn(quiet, "info", "stp", F.concat(F.lit("Trunk port "), F.col("interface"), F.lit(" has no STP data (cannot confirm loop protection)."))))


def all_warnings(devices, interfaces, trunks, neighbors, macs, stp, threshold: int = 5) -> DataFrame:
    e = edges(neighbors)
    parts = [warn_discovery(neighbors), warn_unidirectional(e, devices), warn_trunk_alone(interfaces, trunks, e), warn_mac(macs, interfaces, threshold), warn_stp(stp, interfaces, trunks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topology_summary(node: DataFrame, edge: DataFrame, warnings: DataFrame) -> DataFrame:
    """(snapshot, metric, n) rows."""
    count = lambda d, *ms: d.groupBy(SNAP).agg(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in ms]), F.array(*[F.count_if(c) for _, c in ms])).alias("m")).select(SNAP, F.explode("m").alias("metric", "n"))
    out = count(node, ("nodes", F.lit(True))).unionByName(count(
        edge, ("edges", F.lit(True)), ("bidirectional", F.col("bidirectional")),
        ("lldp_cdp", F.col("discovery_protocol").rlike("lldp|cdp")), ("confidence_high", F.col("confidence") == "high")))
    w = warnings.groupBy(SNAP, F.concat(F.lit("warning_"), F.col("severity")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(w)
