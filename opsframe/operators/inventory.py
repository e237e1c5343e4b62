"""Typed inventory tables from a fleet of command captures.

Input is one table of ``snapshot_id, device, command, line_no, line``. Headings
and sections are carried down in line chunks, so one very long capture does not
end up in one task.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions import intervals
from opsframe.functions.scalars import expand_list, expand_ranges, grab, lookup, num, pick

CAPTURE = ["snapshot_id", "device", "command"]
PLACE = ["snapshot_id", "device"]
CHUNK = 5000
# Spanning-tree words, interface prefixes of the second dialect.
STP_STATES = {"FWD": "forwarding", "BLK": "blocking", "LIS": "listening", "LRN": "learning", "DIS": "disabled", "BKN": "broken"}
VRP_PREFIXES = {"GE": "GigabitEthernet", "XGE": "XGigabitEthernet", "Eth": "Ethernet"}
VRP_ROLES = {"ROOT": "Root", "DESI": "Desg", "ALTE": "Altn", "BACK": "Back", "MAST": "Master"}
VRP_STATES = {"FORWARDING": "forwarding", "DISCARDING": "blocking", "LEARNING": "learning", "DISABLED": "disabled"}
STATUS_COLUMNS = ["Port", "Name", "Status", "Vlan", "Duplex", "Speed", "Type"]
LLDP_COLUMNS = ["Device ID", "Local Intf", "Hold-time", "Capability", "Port ID"]
CDP_COLUMNS = ["Device ID", "Local Intrfce", "Holdtme", "Capability", "Platform", "Port ID"]
POE_COLUMNS = ["Interface", "Admin", "Oper", "Power", "Device", "Class", "Max"]
MAC_ROW = r"^\s*(\d+|All)\s+([0-9a-fA-F]{4}\.[0-9a-fA-F]{4}\.[0-9a-fA-F]{4})\s+(\S+)\s+(\S+)"
STP_ROW = r"(?i)^\s*(\S+)\s+(Root|Desg|Altn|Back|Boun|Mstr)\s+(FWD|BLK|LIS|LRN|DIS|BKN)\b"


def capture(df: DataFrame, command: str) -> DataFrame:
    return df.where(F.col("command") == command)


def carry_down(df: DataFrame, marks: Mapping[str, Column], keys: Sequence[str] = CAPTURE, order: str = "line_no", chunk: int = CHUNK) -> DataFrame:
    """Add, for every mark, its last non-null value at or above each line."""
    base = df.withColumns({f"_m_{n}": e for n, e in marks.items()}).withColumn("_chunk", F.floor(F.col(order) / chunk))
    part = [*keys, "_chunk"]
    ends = base.groupBy(*part).agg(*[F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in marks])
    above = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*part, *[F.last(f"_e_{n}", ignorenulls=True).over(above).alias(f"_p_{n}") for n in marks])
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(ends, part)
    out = out.withColumns({n: F.coalesce(F.last(f"_m_{n}", ignorenulls=True).over(w), F.col(f"_p_{n}")) for n in marks})
    return out.drop("_chunk", *[f"_{x}_{n}" for n in marks for x in "mp"])


def _separator(line: Column) -> Column:
    return line.rlike(r"^[\s-]*-[\s-]*$")


def fixed_width(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of a fixed-width table as a ``cells`` struct: the header is the line naming most columns (at least two)."""
    hits = sum((F.contains("line", F.lit(n)).cast("int") for n in names[1:]), F.contains("line", F.lit(names[0])).cast("int"))
    heads = df.withColumn("_hits", hits).where("_hits >= 2").groupBy(*CAPTURE).agg(
        F.min_by(F.struct(F.col("line").alias("head"), F.col("line_no").alias("head_no")), F.struct(-F.col("_hits"), "line_no")).alias("h"))
    j = df.join(heads.select(*CAPTURE, "h.*"), CAPTURE).where((F.col("line_no") > F.col("head_no")) & (F.trim("line") != "") & ~_separator(F.col("line")))
    starts = F.filter(F.array(*[F.locate(n, F.col("head")) for n in names]), lambda x: x > 0)
    j = j.withColumn("_starts", starts)

    def cell(n: str) -> Column:
        s = F.locate(n, F.col("head"))
        nxt = F.array_min(F.filter("_starts", lambda x: x > s))
        text = F.trim(F.when(nxt.isNotNull(), F.substring("line", s, nxt - s)).otherwise(F.substring("line", s, F.length("line"))))
        return F.when(s > 0, F.nullif(text, F.lit("")))

    out = j.select(*PLACE, "line_no", F.struct(*[cell(n).alias(n) for n in names]).alias("cells"))
    return out.where(F.col("cells")[names[0]].isNotNull())


def _cell(n: str) -> Column:
    return F.col("cells")[n]


def interfaces(df: DataFrame, command: str = "interface_status") -> DataFrame:
    v = F.lower(F.coalesce(_cell("Vlan"), F.lit("")))
    mode = pick([(v == "trunk", "trunk"), (v == "routed", "routed"), (v.rlike("^[0-9]+$"), "access")], "unknown")
    return fixed_width(capture(df, command), STATUS_COLUMNS).select(
        *PLACE, _cell("Port").alias("name"), _cell("Name").alias("description"), _cell("Status").alias("status"), F.when(mode == "access", _cell("Vlan")).alias("vlan"),
        mode.alias("mode"), _cell("Duplex").alias("duplex"), _cell("Speed").alias("speed"))


def _ports(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")


def vlans(df: DataFrame, command: str = "vlan_brief") -> DataFrame:
    """VLAN rows with their port lists; indented lines continue the VLAN above."""
    row = r"^(\d+)\s+(\S+)\s+(\S+)\s*(.*)$"
    line = F.col("line")
    d = capture(df, command).where((F.trim(line) != "") & ~_separator(line) & ~F.lower(line).startswith("vlan "))
    d = carry_down(d, {"vlan_no": F.when(line.rlike(row), F.col("line_no"))}).where("vlan_no is not null")
    head = line.rlike(row)
    ports = pick([(head, _ports(F.regexp_extract(line, row, 4))), (line.startswith(" "), _ports(line))], F.array().cast("array<string>"))
    d = d.select(*PLACE, "line_no", "vlan_no", grab(line, row, 1).alias("vlan_id"), grab(line, row, 2).alias("name"), grab(line, row, 3).alias("status"), head.alias("_head"), ports.alias("p"))
    g = d.groupBy(*PLACE, "vlan_no").agg(
        F.max(F.when(F.col("_head"), F.struct("vlan_id", "name", "status"))).alias("h"), F.array_sort(F.collect_list(F.struct("line_no", "p"))).alias("ps"))
    return g.select(*PLACE, "h.*", F.flatten(F.transform("ps", lambda s: s["p"])).alias("ports"))


def trunks(df: DataFrame, command: str = "trunk") -> DataFrame:
    """Summary and allowed sections of the trunk table joined per port.

    ``allowed_vlans`` lists the ids, with words such as ``ALL`` as they are; ``allowed_ranges`` is the same set of ids as intervals.
    Readers of the ranges alone never list wide ones.
    """
    line, low = F.col("line"), F.lower("line")
    section = F.when(low.startswith("port"), pick([(low.contains("native vlan"), "summary"), (low.contains("vlans allowed on trunk"), "allowed")], "other"))
    d = carry_down(capture(df, command).where(F.trim(line) != ""), {"section": section}).where(~low.startswith("port"))
    words = F.split(F.trim(line), r"\s+")
    s = d.where((F.col("section") == "summary") & (F.size(words) >= 5)).groupBy(*PLACE, F.get(words, F.lit(0)).alias("interface")).agg(
        F.max_by(F.struct(F.get(words, F.lit(3)).alias("trunking_status"), F.get(words, F.lit(4)).alias("native_vlan")), "line_no").alias("s"))
    a = d.where((F.col("section") == "allowed") & (F.size(words) >= 2)).groupBy(*PLACE, F.get(words, F.lit(0)).alias("interface")).agg(F.max_by(F.get(words, F.lit(1)), "line_no").alias("spec"))
    allowed = F.when(F.col("spec").isNull(), F.array().cast("array<string>")).otherwise(expand_list("spec"))
    return s.join(a, [*PLACE, "interface"], "full_outer").select(*PLACE, "interface", allowed.alias("allowed_vlans"), intervals.parse(F.col("spec")).alias("allowed_ranges"), "s.native_vlan", "s.trunking_status")


def neighbors(df: DataFrame, lldp: str = "lldp_neighbors", cdp: str = "cdp_neighbors") -> DataFrame:
    def part(command: str, names: Sequence[str], local: str, protocol: str) -> DataFrame:
        d = fixed_width(capture(df, command), names).where(_cell(local).isNotNull())
        return d.select(*PLACE, _cell(local).alias("local_interface"), _cell("Device ID").alias("remote_device"), _cell("Port ID").alias("remote_interface"), F.lit(protocol).alias("protocol"), F.col("line_no").alias("ord"))

    return part(lldp, LLDP_COLUMNS, "Local Intf", "lldp").unionByName(part(cdp, CDP_COLUMNS, "Local Intrfce", "cdp"))


def mac_table(df: DataFrame, command: str = "mac_table") -> DataFrame:
    d = capture(df, command).where(F.col("line").rlike(MAC_ROW))
    return d.select(*PLACE, grab("line", MAC_ROW, 1).alias("vlan"), F.lower(grab("line", MAC_ROW, 2)).alias("mac_address"), grab("line", MAC_ROW, 4).alias("interface"), F.upper(grab("line", MAC_ROW, 3)).alias("entry_type"))


def poe(df: DataFrame, command: str = "power_inline") -> DataFrame:
    known = lambda c: F.when(~F.lower(_cell(c)).isin("n/a", "na", "-"), _cell(c))
    return fixed_width(capture(df, command), POE_COLUMNS).select(
        *PLACE, _cell("Interface").alias("interface"), F.lower(_cell("Admin")).alias("admin_state"), F.lower(_cell("Oper")).alias("oper_state"), num(_cell("Power")).alias("power_watts"),
        known("Device").alias("powered_device"), F.when(F.lower(_cell("Class")) != "n/a", _cell("Class")).alias("poe_class"), num(_cell("Max")).alias("max_watts"))


def stp(df: DataFrame, command: str = "spanning_tree") -> DataFrame:
    d = carry_down(capture(df, command), {"vlan": grab(F.trim("line"), r"(?i)^VLAN0*(\d+)")}).where(F.col("line").rlike(STP_ROW))
    return d.select(*PLACE, "vlan", grab("line", STP_ROW, 1).alias("interface"), F.initcap(grab("line", STP_ROW, 2)).alias("role"), lookup(F.upper(grab("line", STP_ROW, 3)), STP_STATES).alias("state"))


def identity(df: DataFrame, command: str = "running_config") -> DataFrame:
    """Last hostname and version, first address under a VLAN or management interface."""
    line = F.trim("line")
    mgmt = F.when(line.startswith("interface "), F.lower(F.expr("substring(trim(line), 11)")).startswith("vlan") | F.lower(line).contains("mgmt"))
    d = carry_down(capture(df, command), {"in_mgmt": mgmt})
    host, version = grab(line, r"^hostname\s+(.+)$"), grab(line, r"^version\s+(.+)$")
    addr = F.when(F.col("in_mgmt"), grab(line, r"^ip address\s+(\S+)"))
    at = lambda e: F.when(e.isNotNull(), F.col("line_no"))
    return d.groupBy(*PLACE).agg(F.max_by(host, at(host)).alias("hostname"), F.max_by(version, at(version)).alias("platform"), F.min_by(addr, at(addr)).alias("management_ip"))


# ------------------------------------------------------------ second dialect
def vrp_name(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"\([^)]*\)\s*$", "")
    prefix = F.regexp_extract(bare, r"^([A-Za-z-]+?)(\d.*)$", 1)
    return F.when(prefix != "", F.concat(F.coalesce(lookup(prefix, VRP_PREFIXES), prefix), F.regexp_extract(bare, r"^([A-Za-z-]+?)(\d.*)$", 2))).otherwise(bare)


def _words(n: int) -> Column:
    return F.get(F.split(F.trim("line"), r"\s+"), F.lit(n))


def _after(df: DataFrame, mark: Column) -> DataFrame:
    """Lines below the first marked line of each capture."""
    first = df.where(mark).groupBy(*CAPTURE).agg(F.min("line_no").alias("_from"))
    return df.join(first, CAPTURE).where(F.col("line_no") > F.col("_from")).drop("_from")


def vrp_interface_brief(df: DataFrame, command: str = "interface_brief") -> DataFrame:
    c = capture(df, command)
    d = _after(c, F.col("line").startswith("Interface") & F.col("line").contains("PHY")).where(F.size(F.split(F.trim("line"), r"\s+")) >= 3)
    phy, proto = F.lower(_words(1)), F.lower(_words(2))
    status = pick([(phy.startswith("*"), "disabled"), ((phy == "up") & proto.startswith("up"), "connected")], "notconnect")
    return d.select(*PLACE, vrp_name(_words(0)).alias("name"), status.alias("status"), proto.alias("protocol_status"))


def vrp_stp(df: DataFrame, command: str = "stp") -> DataFrame:
    d = capture(df, command).where(_words(0).rlike("^[0-9]+$") & (F.size(F.split(F.trim("line"), r"\s+")) >= 4))
    return d.select(*PLACE, _words(0).alias("vlan"), vrp_name(_words(1)).alias("interface"), F.coalesce(lookup(F.upper(_words(2)), VRP_ROLES), _words(2)).alias("role"), F.coalesce(lookup(F.upper(_words(3)), VRP_STATES), F.lower(_words(3))).alias("state"))


def vrp_poe(df: DataFrame, command: str = "poe") -> DataFrame:
    """Milliwatts to watts; a port with power drawn is on."""
    d = capture(df, command).where(F.lower(_words(0)).rlike("^(gig|ge|xge|ten)") & (F.size(F.split(F.trim("line"), r"\s+")) >= 6))
    drawn, limit = num(_words(4)), num(_words(3))
    return d.select(*PLACE, vrp_name(_words(0)).alias("interface"), F.lit("auto").alias("admin_state"), F.when(F.coalesce(drawn, F.lit(0.0)) > 0, "on").otherwise("off").alias("oper_state"),
                    (drawn / 1000).alias("power_watts"), (limit / 1000).alias("max_watts"), F.when(_words(1) != "-", _words(1)).alias("poe_class"))


def vrp_macs(df: DataFrame, command: str = "mac") -> DataFrame:
    row = r"^([0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4})\s+(\d+)\S*\s+(\S+)\s+(\w+)"
    d = capture(df, command).where(F.col("line").rlike(row))
    return d.select(*PLACE, grab("line", row, 2).alias("vlan"), F.lower(grab("line", row, 1)).alias("mac_address"), vrp_name(grab("line", row, 3)).alias("interface"), F.lower(grab("line", row, 4)).alias("entry_type"))


def vrp_neighbors(df: DataFrame, command: str = "lldp") -> DataFrame:
    d = _after(capture(df, command), F.col("line").startswith("Local Intf")).where(F.size(F.split(F.trim("line"), r"\s+")) >= 3)
    return d.select(*PLACE, vrp_name(_words(0)).alias("local_interface"), _words(1).alias("remote_device"), _words(2).alias("remote_interface"), F.lit("lldp").alias("protocol"), F.col("line_no").alias("ord"))


def vrp_config(df: DataFrame, command: str = "running_config") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identity, interfaces, defined VLANs) of running configurations."""
    text = F.trim("line")
    block = F.when(text.rlike(r"^interface \S+$"), F.concat(F.lit("i:"), vrp_name(grab(text, r"^interface (\S+)$")))).when(text.rlike(r"^vlan \d+$"), F.concat(F.lit("v:"), grab(text, r"^vlan (\d+)$")))
    d = carry_down(capture(df, command), {"block": block})
    at = lambda e: F.when(e.isNotNull(), F.col("line_no"))
    last = lambda e: F.max_by(e, at(e))
    host, plat = grab(text, "^sysname (.+)$"), grab(text, "^!Software Version(.+)$")
    addr = F.when(F.col("block") == "i:Vlanif200", grab(text, r"^ip address (\S+)"))
    who = d.groupBy(*PLACE).agg(last(host).alias("hostname"), last(F.trim(plat)).alias("platform"), F.min_by(addr, at(addr)).alias("management_ip"),
                                F.bool_or(text == "telnet server enable").alias("telnet_server"), F.bool_or(text.startswith("snmp-agent community")).alias("snmp_community"))
    ports = d.where(F.col("block").startswith("i:")).groupBy(*PLACE, F.expr("substring(block, 3)").alias("name")).agg(
        last(grab(text, "^port link-type (trunk|access)$")).alias("linked"), last(grab(text, r"^port default vlan (\S+)$")).alias("vlan"), last(grab(text, r"^port trunk pvid vlan (\S+)$")).alias("native_vlan"),
        last(grab(text, "^port trunk allow-pass vlan (.+)$")).alias("allow_spec"), last(grab(text, "^description (.+)$")).alias("description"))
    mode = F.coalesce("linked", F.when(F.col("name").startswith("Vlanif"), "routed").otherwise("unknown"))
    ports = ports.select(*PLACE, "name", mode.alias("mode"), F.coalesce("vlan", F.when(mode == "access", "1")).alias("vlan"), "native_vlan", "allow_spec", "description")
    defined = d.where(F.col("block").startswith("v:")).groupBy(*PLACE, F.expr("substring(block, 3)").alias("vlan_id")).agg(last(grab(text, "^name (.+)$")).alias("name"))
    return who, ports, defined


def vrp_trunks(ports: DataFrame, defined: DataFrame) -> DataFrame:
    """``a to b`` specs limited to the VLANs the device defines; explicit range expansion keeps the join on equality."""
    spec = F.regexp_replace(F.regexp_replace("allow_spec", r"(\d+) to (\d+)", "$1-$2"), r"\s+", ",")
    wide = ports.where("mode = 'trunk'").select(*PLACE, F.col("name").alias("interface"), "native_vlan", F.explode_outer(expand_ranges(spec)).alias("v"))
    hit = wide.join(defined.select(*PLACE, F.col("vlan_id").cast("int").alias("v"), F.lit(True).alias("_def")), [*PLACE, "v"], "left")
    g = hit.groupBy(*PLACE, "interface", "native_vlan").agg(F.array_sort(F.collect_set(F.when(F.col("_def"), F.col("v")))).alias("vs"))
    return g.select(*PLACE, "interface", "native_vlan", F.transform("vs", lambda x: x.cast("string")).alias("allowed_vlans"))


# ------------------------------------------------------------------- rollups
def enrich_poe(ifaces: DataFrame, power: DataFrame) -> DataFrame:
    p = power.select(*PLACE, F.col("interface").alias("name"), F.lower("admin_state").isin("auto", "static", "on").alias("poe_enabled"), F.col("oper_state").alias("poe_state"))
    return ifaces.drop("poe_enabled", "poe_state").join(p, [*PLACE, "name"], "left")


def inventory_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(snapshot, metric, n): rows per kind, status and spanning-tree distributions, unused ports."""
    out = None
    add = lambda d: d if out is None else out.unionByName(d)
    for kind, d in tables.items():
        out = add(d.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select("snapshot_id", F.lit(kind).alias("metric"), "n"))
    if "interfaces" in tables:
        i = tables["interfaces"]
        out = add(i.groupBy("snapshot_id", F.concat(F.lit("status_"), F.coalesce("status", F.lit("unknown"))).alias("metric")).agg(F.count(F.lit(1)).alias("n")))
        out = add(i.groupBy("snapshot_id").agg(F.count_if(F.lower("status") == "notconnect").alias("n")).select("snapshot_id", F.lit("unused_ports").alias("metric"), "n"))
    if "stp" in tables:
        out = add(tables["stp"].groupBy("snapshot_id", F.concat(F.lit("stp_"), F.col("state")).alias("metric")).agg(F.count(F.lit(1)).alias("n")))
    if "macs" in tables:
        ports = tables["macs"].where("coalesce(interface, '') <> ''").select(*PLACE, "interface").distinct()
        out = add(ports.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select("snapshot_id", F.lit("ports_with_macs").alias("metric"), "n"))
    return out


def config_snapshots(df: DataFrame, command: str = "config") -> DataFrame:
    """Per (device, label): hostname, VLAN set, global switches and a map of interface settings. ``snapshot_id`` is the label."""
    line, text = F.col("line"), F.trim("line")
    low = F.lower(text)
    is_port = line.rlike(r"(?i)^\s*interface\s+\S+")
    block = F.when(is_port, grab(line, r"(?i)^\s*interface\s+(\S+)")).when(((text == "") | (text == "!")) & ~line.startswith(" "), F.lit(""))
    d = carry_down(capture(df, command), {"port": block}).withColumn("port", F.nullif("port", F.lit("")))
    at = lambda e: F.when(e.isNotNull(), F.col("line_no"))
    last = lambda e: F.max_by(e, at(e))
    top = F.col("port").isNull()
    switched = lambda word: F.when(top & low.contains(word), ~low.startswith("no ") & ~low.contains("disable"))
    vlan = F.when(top, grab(line, r"(?i)^\s*vlan\s+(\d+)").try_cast("int"))
    # distinct VLANs and ports before they are listed; both lists are part of the row
    g = d.groupBy(*PLACE).agg(
        last(F.when(top, grab(text, r"(?i)^hostname\s+(.+)$"))).alias("hostname"), last(F.when(top, grab(text, r"(?i)^spanning-tree mode.*?(\S+)$"))).alias("stp_mode"),
        F.coalesce(last(switched("telnet server")), F.lit(False)).alias("telnet"), F.coalesce(last(switched("ssh server")), F.lit(False)).alias("ssh"),
        F.array_sort(F.collect_set(vlan)).alias("vlans"))
    off = low.isin("poe disabled", "no poe", "poe disable", "power inline never")
    on = low.isin("poe enabled", "poe enable", "power inline auto")
    p = d.where("port is not null").groupBy(*PLACE, "port").agg(
        last(grab(low, r"^switchport mode .*?(\S+)$")).alias("mode"), last(grab(low, r"^switchport access vlan (\d+)$").try_cast("int")).alias("access_vlan"),
        last(grab(low, r"^switchport trunk native vlan (\d+)$").try_cast("int")).alias("native_vlan"), last(grab(low, r"^switchport trunk allowed vlan (\S+)$")).alias("spec"),
        last(F.when(on, True).when(off, False)).alias("poe"), last(grab(text, r"(?i)^description\s+(.+)$")).alias("description"))
    entry = F.struct(F.col("port").alias("key"), F.struct("mode", "access_vlan", "native_vlan", expand_ranges("spec").alias("trunk_vlans"), "poe", "description").alias("value"))
    m = p.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(entry)).alias("ports"))
    return g.join(m, PLACE, "left")


def device_of_file(c: Column) -> Column:
    return F.coalesce(grab(c, r"^(.+?)_\d{4}-\d{2}-\d{2}$"), c)
