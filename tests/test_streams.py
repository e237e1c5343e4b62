"""Streams against the batch operators, and replays of a batch."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.checks.base import log_lines
from opsframe.operators import findings, logs, vendor, windows
from opsframe.session import cut_lineage
from opsframe.streaming import jobs


@pytest.fixture(scope="module")
def lines(spark, sf_dir, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('lines')}/in"
    log_lines(spark, sf_dir).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def batch_events(spark, lines):
    """Events of the batch parser with every line counted by itself, as on the stream, and the end of the closed bins."""
    kept = logs.kept_lines(logs.classify_noise(logs.clean_lines(spark.read.parquet(lines))))
    e = windows.eligible(logs.enrich(logs.dispatch_code(logs.parse_syslog(kept.withColumn("duplicate_count", F.lit(1).cast("long")), "Asia/Kolkata"))))
    e = cut_lineage(e)
    return e, e.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def read(spark, path):
    return spark.readStream.schema("source string, ord long, line string").parquet(path)


def test_closed_windows_equal_the_batch_job(spark, lines, batch_events, tmp_path):
    events, mark = batch_events
    jobs.start_window_features(read(spark, lines), 60, f"{tmp_path}/out", f"{tmp_path}/ckpt", "1 hour").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = windows.window_features(events, 60).where(F.col("window_end") <= F.lit(mark))
    cols = ["scope", "hostname", "interface_id", "window_start", *windows.tag_counters(), "unique_snmp_source_ips", "facility_counts", "mnemonic_counts", *windows.LABELS]
    assert rows(got.select(cols)) == rows(want.select(cols)) and got.count() > 20


def test_findings_of_closed_bins_equal_the_batch_job(spark, lines, batch_events, tmp_path):
    events, mark = batch_events
    jobs.start_log_findings(read(spark, lines), f"{tmp_path}/out", f"{tmp_path}/ckpt", "1 hour").awaitTermination()
    got = jobs.latest_findings(spark.read.parquet(f"{tmp_path}/out"))
    want = None
    for minutes in (5, 60):
        closed = events.where(windows.floor_to_bin(F.col("ts"), minutes) + F.make_interval(mins=F.lit(minutes)) <= F.lit(mark))
        part = findings.log_findings(closed, rules=[r for r in findings.RULES if r.minutes == minutes])
        want = part if want is None else want.unionByName(part)
    cols = [F.col(c) if c != "details" else F.array_sort(F.map_entries("details")).cast("string").alias(c) for c in findings.COLUMNS]
    assert rows(got.select(cols)) == rows(want.select(cols)) and {r["rule_id"] for r in got.collect()} >= {"SYS-SNMP-AUTHFAIL", "SYS-ARP-FAST"}


def test_findings_grow_over_several_batches(spark, lines, batch_events, tmp_path):
    """Rows in time order arrive in four files, one a batch; the last version of every finding is that of one batch."""
    ordered = spark.read.parquet(lines).join(batch_events[0].select("source", "ord", "ts"), ["source", "ord"]).orderBy("ts")
    parts = ordered.withColumn("part", F.ntile(4).over(Window.orderBy("ts")))
    for part in range(1, 5):
        parts.where(F.col("part") == part).select("source", "ord", "line").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.start_log_findings(read(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ckpt", "1 hour").awaitTermination()
    jobs.start_log_findings(read(spark, lines), f"{tmp_path}/one", f"{tmp_path}/ckpt1", "1 hour").awaitTermination()
    many, once = (jobs.latest_findings(spark.read.parquet(f"{tmp_path}/{p}")).select("finding_id", "event_count", "severity", "first_seen", "last_seen", "bins") for p in ("out", "one"))
    assert rows(many) == rows(once)


def test_a_replayed_batch_changes_no_count(spark, tmp_path):
    text = [(i, f"<14>2024-01-01 10:00:0{i % 10} fw1 log_subtype=Denied src_ip=10.0.0.{i} priority=error log_id=L{i}") for i in range(30)]
    records = vendor.parse_kv_syslog(spark.createDataFrame(text, "ord long, line string"))[0]
    records = records.withColumn("message", F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("message")))
    write = jobs.ingest_batch(str(tmp_path), observed_at="2024-01-02T00:00:00+00:00")
    write(records.where("ord < 10"), 0)
    write(records.where("ord >= 10"), 1)
    before = rows(jobs.source_progress(spark, str(tmp_path)))
    write(records.where("ord >= 10"), 1)
    assert rows(jobs.source_progress(spark, str(tmp_path))) == before
    p = jobs.source_progress(spark, str(tmp_path)).first()
    assert (p["records"], p["events"], p["rejects"], p["batches"], p["last_batch"], p["status"]) == (30, 24, 6, 2, 1, "ok")
    assert p["reason"] == "missing message" and (p["first_time"], p["last_time"]) == ("2024-01-01 10:00:00", "2024-01-01 10:00:09")
    records.where("ord = 3").write.mode("overwrite").parquet(f"{tmp_path}/events/batch_id=2")  # a batch that broke off before its ledger entry
    assert jobs.ingested(spark, str(tmp_path)).count() == 24 and jobs.ingested(spark, str(tmp_path), "rejects").count() == 6 and jobs.ingested(spark, str(tmp_path), "raw").count() == 30


def test_stream_ingest_with_an_empty_source(spark, tmp_path):
    spark.createDataFrame([], "ord long, line string").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, "<14>2024-01-01 10:00:00 fw1 log_subtype=IPS src_ip=10.0.0.1 log_id=L1")], "ord long, line string").write.mode("append").parquet(f"{tmp_path}/in")
    lines = spark.readStream.schema("ord long, line string").parquet(f"{tmp_path}/in")
    jobs.start_ingest(vendor.parse_kv_syslog(lines)[0], f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert jobs.ingested(spark, f"{tmp_path}/out").count() == 1
