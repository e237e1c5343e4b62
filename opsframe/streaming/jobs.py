"""Continuous jobs: event ingestion with progress, window features, findings and monitoring state as Structured Streaming.

Windows and findings share their expressions with the batch jobs. Stateful steps are chained in append mode: a bin is
handed on once the watermark has closed it, so what comes out of a chain equals the batch job over closed bins.
"""

from __future__ import annotations

import functools
import math
from typing import Any, Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opsframe.operators import findings, logs, vendor, windows


def _start(df: DataFrame, path: str, checkpoint: str, available_now: bool, partition_by: Sequence[str] = ()) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return (w.trigger(availableNow=True) if available_now else w).start()


def batch_progress(raw: DataFrame, events: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row per source of a batch: records, events and rejects, first and last record time, and one reason of a reject."""
    key = F.coalesce(F.col("source_key"), F.lit("unknown")).alias("source_key")
    zero = F.lit(0).cast("long")
    parts = [
        raw.select(key, F.lit(1).cast("long").alias("records"), zero.alias("events"), zero.alias("rejects"), F.nullif(F.col("timestamp"), F.lit("")).alias("at"), F.lit(None).cast("string").alias("reason")),
        events.select(key, zero, F.lit(1).cast("long"), zero, F.lit(None).cast("string"), F.lit(None).cast("string")),
        rejects.select(key, zero, zero, F.lit(1).cast("long"), F.lit(None).cast("string"), F.concat(F.lit("missing "), F.array_join("missing", ", "))),
    ]
    return functools.reduce(DataFrame.union, parts).groupBy("source_key").agg(
        *[F.sum(c).alias(c) for c in ("records", "events", "rejects")], F.min("at").alias("first_time"), F.max("at").alias("last_time"), F.min("reason").alias("reason"))


def ingest_batch(out: str, literals: Sequence[str] = (), observed_at: str | None = None) -> Callable[[DataFrame, int], None]:
    """Writer of one batch: events, rejects, raw records and the ledger entry, each in the batch's own folder.

    A batch that runs again replaces its folders, so a replay after a failure changes no count. The ledger entry comes last
    and carries the batch's id; readers take batches with an entry only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = vendor.redact(batch, literals).persist()
        try:
            events, rejects = vendor.normalize_events(raw, None if observed_at is None else F.lit(observed_at))
            put = lambda df, part: df.write.mode("overwrite").parquet(f"{out}/{part}/batch_id={batch_id}")
            put(events, "events")
            put(rejects, "rejects")
            put(raw, "raw")
            done = batch_progress(raw, events, rejects).withColumn("engine_target", vendor.route(F.col("source_key")))
            put(done.withColumn("finished_at", F.current_timestamp()).coalesce(1), "progress")
        finally:
            raw.unpersist()

    return write


def start_ingest(records: DataFrame, out: str, checkpoint: str, literals: Sequence[str] = (), available_now: bool = True, observed_at: str | None = None) -> StreamingQuery:
    """Source records (any vendor parser's output, streaming) to redacted, normalised, routed events, rejects, raw records and progress."""
    w = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ingest_batch(out, literals, observed_at))
    return (w.trigger(availableNow=True) if available_now else w).start()


def ingested(spark: SparkSession, out: str, part: str = "events") -> DataFrame:
    """``events``, ``rejects`` or ``raw`` of all batches that have a ledger entry, with their ``batch_id``."""
    done = spark.read.parquet(f"{out}/progress").select("batch_id").distinct()
    return spark.read.parquet(f"{out}/{part}").join(F.broadcast(done), "batch_id", "left_semi")  # one row per batch


def source_progress(spark: SparkSession, out: str) -> DataFrame:
    """Per source: batches, records, events, rejects, first and last time, last batch, status and one reason."""
    led = spark.read.parquet(f"{out}/progress")
    return led.groupBy("source_key", "engine_target").agg(
        F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in ("records", "events", "rejects")], F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"), F.max("batch_id").cast("long").alias("last_batch"), F.min("reason").alias("reason"),
    ).withColumn("status", F.when(F.col("events") > 0, "ok").otherwise("failed"))


def stream_log_events(lines: DataFrame, zone: str = "Asia/Kolkata", delay: str = "10 minutes") -> DataFrame:
    """Streaming lines to parsed events; every line counts, repeats too, as in the batch job's weights."""
    kept = logs.kept_lines(logs.classify_noise(logs.clean_lines(lines)))
    once = kept.withColumn("duplicate_count", F.lit(1).cast("long"))
    events = logs.enrich(logs.dispatch_code(logs.parse_syslog(once, zone)))
    return windows.eligible(events).withWatermark("ts", delay)


def stream_window_features(events: DataFrame, minutes: int, maps: bool = True) -> DataFrame:
    """Two-scope window rows over a watermarked event stream, with exact address counts and count maps.

    ``ts`` is device wall-clock time, so bins that divide a day already start at local midnight. Three chained windows:
    per interface, code and address; per scope and address; per scope. Addresses are keys of the second, never a list.
    """
    if 1440 % minutes:
        raise ValueError("streaming bins must divide a day")
    counters = windows.tag_counters()
    sums = [F.sum(n).alias(n) for n in counters]
    flat = events.select(
        "ts", F.coalesce("hostname", F.lit("unknown")).alias("hostname"), F.col("entities.interface_id").alias("iface"), *([F.col("facility"), F.col("mnemonic")] if maps else []),
        windows.failed_from().alias("ip"), *[e.alias(n) for n, e in counters.items()])
    codes = ["facility", "mnemonic"] if maps else []
    fine = flat.groupBy(F.window("ts", f"{minutes} minutes"), "hostname", "iface", *codes, "ip").agg(*sums)
    scope = ["window", "scope", "hostname", "interface_id"]
    scoped = windows.scoped(fine.withColumn("w", F.col("weighted_event_count")))
    listed = [F.collect_list(F.struct(*windows.CODE)).alias("codes")] if maps else []
    by_address = scoped.groupBy(*scope, "ip").agg(*sums, *listed)
    merged = [F.flatten(F.collect_list("codes")).alias("codes")] if maps else []
    rows = by_address.groupBy(*scope).agg(*sums, F.count("ip").alias("unique_snmp_source_ips"), *merged)
    text = [windows.counts_json(F.col("codes"), k).alias(f"{k}_counts") for k in codes]
    out = rows.select(F.lit(minutes).alias("window_minutes"), "scope", "hostname", "interface_id", F.col("window.start").alias("window_start"), *counters, "unique_snmp_source_ips", *text)
    return windows.weak_labels(out.withColumn("port_flap_count", F.col("lineproto_up_count") + F.col("lineproto_down_count")))


def start_window_features(lines: DataFrame, minutes: int, out: str, checkpoint: str, delay: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    return _start(stream_window_features(stream_log_events(lines, delay=delay), minutes), out, checkpoint, available_now)


_STATE = (
    "event_count long, reports long, first_seen string, last_seen string, moves long, source string, ord long, iface string, short boolean, "
    "reboots long, faults long, communities array<string>, peak long, bins long")


def _null(v: Any) -> bool:
    return v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v)


def _ends(values: Sequence[Any], pick: Callable) -> Any:
    known = [v for v in values if not _null(v)]
    return pick(known) if known else None


def _later(a: tuple, b: tuple) -> tuple:
    """The greater of two places, nulls first, as Spark orders structs."""
    return max(a, b, key=lambda place: tuple((0,) if _null(v) else (1, v) for v in place))


class FindingTotals(StatefulProcessor):
    """Keyed state of one group: its totals over closed bins and its peak bin."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Merge the group's closed bins and hand its totals on."""
        names = [c.split()[0] for c in _STATE.split(", ")]
        s = dict(zip(names, self.totals.get())) if self.totals.exists() else dict.fromkeys(names) | {"communities": [], "short": False}
        for bins in rows:
            for r in bins.to_dict("records"):
                for total, part in (("event_count", r["n"]), ("reports", r["reports"]), ("reboots", r["reboots"]), ("faults", r["faults"]), ("bins", 1)):
                    s[total] = (s[total] or 0) + int(part)
                s["peak"] = max(s["peak"] or 0, int(r["n"]))
                s["first_seen"] = _ends([s["first_seen"], r["first_seen"]], min)
                s["last_seen"] = _ends([s["last_seen"], r["last_seen"]], max)
                s["moves"] = _ends([s["moves"], r["moves"]], max)
                s["source"], s["ord"], s["iface"] = _later((s["source"], s["ord"], s["iface"]), (r["source"], r["ord"], r["iface"]))
                s["short"] = bool(s["short"]) or bool(r["short"])
                s["communities"] = sorted({*s["communities"], *r["communities"]})
        s |= {k: None if _null(s[k]) else int(s[k]) for k in ("moves", "ord")}
        self.totals.update(tuple(s[n] for n in names))
        yield pd.DataFrame([[*key, *s.values()]], columns=[*findings.GROUP, *s])

    def close(self) -> None:
        pass


def stream_log_findings(events: DataFrame, t: dict = findings.THRESHOLDS, rules: Sequence[findings.Rule] = tuple(findings.RULES)) -> DataFrame:
    """Findings of a watermarked event stream over all closed bins; a group's later row, with more ``bins``, replaces the earlier.

    Bins per group and rule close with the watermark; a keyed state behind them holds each group's totals and its peak bin.
    """
    closed = []
    for minutes in sorted({r.minutes for r in rules}):
        own = [r for r in rules if r.minutes == minutes]
        closed.append(findings.bin_hits(findings.rule_hits(events, own), F.window("ts", f"{minutes} minutes")).drop("window"))
    bins = functools.reduce(DataFrame.unionByName, closed).select(
        *findings.GROUP, "n", "reports", "first_seen", "last_seen", "moves", "last.source", "last.ord", "last.iface", F.coalesce("short", F.lit(False)).alias("short"), "reboots", "faults", "communities")
    keyed = "rule_id string, device string, k2 string, k3 string, "
    totals = bins.groupBy(*findings.GROUP).transformWithStateInPandas(FindingTotals(), keyed + _STATE, "append", "none")
    g = totals.withColumn("last", F.struct("source", "ord", "iface"))
    return findings.finding_rows(g, t, rules, also=["bins"])


def latest_findings(rows: DataFrame) -> DataFrame:
    """The newest row of every finding that ``stream_log_findings`` has written."""
    cols = [c for c in rows.columns if c not in ("finding_id", "bins")]
    return rows.groupBy("finding_id").agg(F.max_by(F.struct(*cols), "bins").alias("r"), F.max("bins").alias("bins")).select("finding_id", "r.*", "bins")


def start_log_findings(lines: DataFrame, out: str, checkpoint: str, delay: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """The keyed state needs Spark's RocksDB state store, which this query alone is started with."""
    conf, name = lines.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _start(stream_log_findings(stream_log_events(lines, delay=delay)), out, checkpoint, available_now)
    finally:
        conf.set(name, before)


def start_monitoring(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Running counts per (dimension, value), handed to ``sink`` in complete mode each batch."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("event_type", "severity", "source_engine")])
    counts = events.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if available_now else w).start()


__all__ = [
    "ingest_batch", "ingested", "latest_findings", "source_progress", "start_ingest", "start_log_findings", "start_monitoring", "start_window_features",
    "stream_log_events", "stream_log_findings", "stream_window_features",
]
