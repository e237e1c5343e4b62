"""Incident membership stays linear, and repeated signals count once."""

import re

from pyspark.sql import functions as F

from opsframe.operators import incidents as inc

SCHEMA = (
    "run_id string, signal_id string, engine string, source_type string, category string, severity string, device string, interface string, event_count int, "
    "aggregate boolean, clock_unreliable boolean, entity_confident boolean, confidence_label string, title string, source_artifact string, tags array<string>")


def signal(i, engine, device, tag, category="security", interface=None, severity="high"):
    return ("r", f"S{i}", engine, None, category, severity, device, interface, 1, False, False, True, "high", f"title {i % 7}", f"file{i % 3}", [tag])


def test_groups_share_their_sets(spark):
    rows = [signal(i, "engine_c", f"sw{i}", "UNUSED_PORT_ADMIN_UP") for i in range(200)] + [signal(1000 + i, "engine_a", f"sw{i}", "attack") for i in range(200)]
    c = inc.classify(spark.createDataFrame(rows, SCHEMA))
    m = inc.cross_members(c)
    sizes = m.own.count(), m.refs.count(), m.sets.where("set_id = 'attack'").count()
    assert sizes == (200, 200, 200) and m.rows().count() == 200 * 201 and m.covered().count() == 400
    incidents, _ = inc.correlate(spark.createDataFrame(rows, SCHEMA))
    got = incidents.where("rule_id = 'CONFIG_EXPOSURE'").agg(F.count(F.lit(1)).alias("n"), F.min("n_signals").alias("lo"), F.max("n_signals").alias("hi"), F.max("n_engines").alias("e")).first()
    assert tuple(got) == (200, 201, 201, 2)
    match = {r["entity_match"]: r["count"] for r in incidents.where("rule_id = 'CONFIG_EXPOSURE'").groupBy("entity_match").count().collect()}
    assert match == {"none": 200}  # each meets one attack on its own device and 199 on others


def test_repeated_signals_count_once_and_evidence_lists_them(spark):
    rows = [signal(1, "engine_c", "sw1", "UNUSED_PORT_ADMIN_UP", interface="Gi0/1"), signal(2, "engine_a", "sw1", "attack", interface="gi 0/1")]
    incidents, m = inc.correlate(spark.createDataFrame(rows + rows, SCHEMA))
    one = incidents.where("rule_id = 'CONFIG_EXPOSURE'").first()
    assert (one["n_signals"], one["n_engines"], one["entity_match"]) == (2, 2, "normalized")
    items = inc.evidence_items(m, incidents.where("rule_id = 'CONFIG_EXPOSURE'")).orderBy("signal_id").collect()
    assert [(r["signal_id"], r["engine"], r["title"], r["source_artifact"]) for r in items] == [("S1", "engine_c", "title 1", "file1"), ("S2", "engine_a", "title 2", "file2")]


def test_no_signals_give_no_incidents(spark):
    incidents, m = inc.correlate(spark.createDataFrame([], SCHEMA))
    assert incidents.count() == 0 and m.rows().count() == 0 and inc.evidence_items(m, incidents).count() == 0


def test_a_large_set_is_dealt_over_the_tasks(spark):
    rows = [signal(i, "engine_c", f"sw{i}", "UNUSED_PORT_ADMIN_UP") for i in range(700)] + [signal(10000 + i, "engine_a", f"sw{i}", "attack") for i in range(700)]
    members = inc.rule_exposure(inc.classify(spark.createDataFrame(rows, SCHEMA))).rows()
    tasks = [r["count"] for r in members.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 700 * 701 and max(tasks) < sum(tasks) / 2  # one task had all pairs of a run's set


def test_blocks_keep_repeated_rows(spark):
    refs = spark.createDataFrame([("r", "s", "rule", str(i)) for i in range(3)], "run_id string, set_id string, rule_id string, key string")
    sets = spark.createDataFrame([("r", "s", "S1")] * 2500 + [("r", "s", None), ("q", "s", "S2")], "run_id string, set_id string, signal_id string")
    got = {(r["key"], r["signal_id"]): r["count"] for r in inc.expand(refs, sets).groupBy("key", "signal_id").count().collect()}
    assert got == {(str(i), v): n for i in range(3) for v, n in (("S1", 2500), (None, 1))}


def test_evidence_items_name_their_incident(spark):
    rows = [signal(1, "engine_c", "sw1", "UNUSED_PORT_ADMIN_UP"), signal(2, "engine_a", "sw1", "attack")]
    incidents, m = inc.correlate(spark.createDataFrame(rows, SCHEMA))
    items = inc.evidence_items(m, incidents)
    assert {"rule_id", "key"} <= set(items.columns)  # no join of the long table is needed for them
    assert items.where("rule_id = 'CONFIG_EXPOSURE' and key = 'sw1'").count() == 2


def test_evidence_adds_own_titles_to_those_of_the_sets(spark):
    rows = [signal(i, "engine_c", f"sw{i}", "UNUSED_PORT_ADMIN_UP") for i in range(5)] + [signal(i, "engine_a", "sw9", "attack") for i in range(10, 14)]
    flap = ("r", "F1", "syslog", "SYSLOG_MANAGEMENT_ACCESS", "security", "high", "sw1", None, 1, False, False, True, "high", "title 9", None, [])
    auth = ("r", "A1", "syslog", "SYSLOG_SNMP_AUTH_ACTIVITY", "security", "high", "sw1", None, 1, False, False, True, "high", "title 9", "file1", [])
    m = inc.cross_members(inc.classify(spark.createDataFrame(rows + [flap, auth], SCHEMA)))
    assert inc._taken(m.refs.where("rule_id = 'CONFIG_EXPOSURE'")).select("taken").distinct().count() == 1  # counted once for five incidents
    got = {tuple(r) for r in inc.incident_evidence(m).where("key = 'sw1'").select("rule_id", "engine", "signals", "titles", "first_title", "artifacts").collect()}
    assert got == {("CONFIG_EXPOSURE", "engine_c", 1, 1, "title 1", 1), ("CONFIG_EXPOSURE", "engine_a", 4, 4, "title 3", 3),
                   ("MANAGEMENT_ACCESS_EXPOSURE", "syslog", 2, 1, "title 9", 1), ("MANAGEMENT_ACCESS_EXPOSURE", "engine_c", 1, 1, "title 1", 1),
                   ("MANAGEMENT_ACCESS_EXPOSURE", "engine_a", 4, 4, "title 3", 3)}


def test_alike_incidents_share_their_pair_counts(spark, monkeypatch):
    rows = [("r", f"P{i}", "syslog", "SYSLOG_POE_FAULT", "port", "high", "sw1", "gi0/1", 1, False, False, True, "high", "t", "f", []) for i in range(50)]
    rows += [signal(1, "engine_c", "sw1", "other", interface="gi0/1"), signal(2, "engine_c", "SW1 ", "other", interface="Gi0/1")]
    m = inc.cross_members(inc.classify(spark.createDataFrame(rows, SCHEMA)))
    whole = {tuple(r) for r in inc._pair_counts(m).collect()}
    seen, count = [], inc._pair_counts
    monkeypatch.setattr(inc, "_pair_counts", lambda part: seen.append(part.own.count()) or count(part))
    assert {tuple(r) for r in inc.pair_counts(m).collect()} == whole and len(whole) == 50 and seen == [1]


def test_pairs_are_not_kept_by_the_million(spark):
    """Generated code keeps all that comes of one input row, so lists of both sides must not be opened by the same code."""
    refs = spark.range(300).selectExpr("'r' as run_id", "'s' as set_id", "'A' as rule_id", "string(id) as key")
    sets = spark.range(300).selectExpr("'r' as run_id", "'s' as set_id", "string(id) as signal_id")
    out = inc.expand(refs, sets)
    assert len(out.collect()) == 300 * 300
    opened = re.findall(r"(\*\(\d+\))? ?Generate (?:explode|inline)", out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert len(opened) == 2 and opened.count("") == 1


def test_a_rule_reads_only_what_it_takes(spark):
    rows = [signal(i, "engine_c", f"sw{i}", "x", category="port", interface="gi0/1") for i in range(4)] + [signal(9, "engine_a", "sw1", "attack"), signal(10, "engine_b", "sw1", "anomaly")]
    poe = ("r", "S20", "syslog", "SYSLOG_POE_FAULT", "port", "high", "sw1", "Gi0/1", 1, False, False, True, "high", "t", "f", ["syslog"])
    flap = ("r", "S21", "syslog", "SYSLOG_PORT_FLAP", "port", "high", "sw2", "Gi0/1", 1, False, False, True, "high", "t", "f", ["syslog"])
    c = inc.classify(spark.createDataFrame([*rows, poe, flap, (None, *poe[1:])], SCHEMA))
    m = inc.rule_poe(c)
    assert sorted((r["key"], r["signal_id"]) for r in m.rows().collect()) == [("S20", "S1"), ("S20", "S20"), ("S20", "S21")]
    assert {r["set_id"].split("\x1f")[0] for r in m.sets.collect()} == {"flaps", "config"}
    assert "Join" not in m.own._jdf.queryExecution().optimizedPlan().toString()
    every = inc.cross_members(c).rows().where("rule_id = 'POE_ENDPOINT_FAILURE'")
    assert sorted((r["key"], r["signal_id"]) for r in every.collect()) == [("S20", "S1"), ("S20", "S20"), ("S20", "S21")]
