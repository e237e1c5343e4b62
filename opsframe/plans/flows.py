"""Composed jobs: log ingestion, telemetry, table preprocessing and feature engineering."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from opsframe.operators import encoding, findings, learning, logs, profiling, selection, series, splits, tables, telemetry, windows
from opsframe.session import cut_lineage


@dataclass(frozen=True)
class IngestConfig:
    zone: str = "Asia/Kolkata"
    minutes: int = 5
    extra_minutes: Sequence[int] = (15,)
    drop_unreliable: bool = True
    ratios: Sequence[float] = splits.RATIOS
    holdout: str | None = None
    thresholds: Mapping[str, object] = field(default_factory=lambda: dict(windows.THRESHOLDS))


def ingest_logs(lines: DataFrame, config: IngestConfig = IngestConfig()) -> dict[str, DataFrame]:
    """Lines to events, windows per size, split, findings and audit tables.

    Parsed events feed six outputs, so they are written once to the checkpoint folder.
    """
    classified = logs.classify_noise(logs.clean_lines(lines))
    collapsed = logs.collapse_repeats(logs.kept_lines(classified))
    events = cut_lineage(logs.enrich(logs.dispatch_code(logs.parse_syslog(collapsed, config.zone))))
    make = lambda sizes: windows.window_features(events, sizes, config.drop_unreliable, dict(config.thresholds), zone=config.zone)
    main = splits.split_by_position(make(config.minutes), ["window_start_iso", "hostname", "scope", "interface_id"], config.ratios, holdout=config.holdout)
    out = {
        "events": events, "dropped": logs.dropped_lines(classified), "duplicates": logs.collapsed_groups(collapsed), "windows": main,
        "split_manifest": splits.split_manifest(main, "window_start_iso"), "findings": findings.log_findings(events, dict(config.thresholds)), "summary": logs.parse_summary(events),
    }
    if config.extra_minutes:
        out["extra_windows"] = make(list(config.extra_minutes))
    return out


def preprocess_telemetry(df: DataFrame, schema: telemetry.TelemetrySchema, tiebreak: str, clip_resets: bool = True, rule: str | None = None,
                         fractions: Mapping[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse, dedupe, fill, rates, clip, optional resample, time split; plus a manifest of (metric, value) rows."""
    ts, keys = schema.ts, schema.series
    timed = df.withColumn(ts, telemetry.parse_ts(F.col(ts))).where(F.col(ts).isNotNull())
    once = series.dedupe_readings(timed, [ts, *keys], tiebreak)
    numeric = schema.present(once, [*schema.counters, *schema.gauges])
    once = cut_lineage(once.withColumns({c: F.col(c).try_cast("double") for c in numeric}))  # the fill and the manifest read it
    gaps = Observation()
    filled = series.fill_series(once, numeric, keys, [ts], dropped=gaps)
    rated = series.counter_rates(filled, schema.present(filled, schema.counters), clip_resets, keys, [ts])
    bounds = {c: (0.0, None) for c in numeric} | {c: b for c, b in schema.bounds.items() if c in rated.columns}
    work = telemetry.clip_bounds(rated, bounds)
    if rule:
        work = series.resample(work.drop(tiebreak), rule, keys, ts)
    out = telemetry.split_by_time(cut_lineage(work), ts, fractions)
    n = lambda d, name: d.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")
    lost = df.sparkSession.createDataFrame([("unfilled_rows", str(gaps.get["dropped"]))], "metric string, value string")  # known since the work was written
    manifest = n(df, "raw_rows").unionByName(n(timed, "timed_rows")).unionByName(n(once, "deduped_rows")).unionByName(lost).unionByName(n(out, "rows"))
    per = out.groupBy("split").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("rows_"), F.col("split")).alias("metric"), "value")
    return out, manifest.unionByName(per)


def health_features(df: DataFrame, schema: telemetry.TelemetrySchema, rolling: Sequence[int] = (3, 6), stats: Sequence[str] = ("mean", "std", "max"), lags: Sequence[int] = (1, 2)) -> DataFrame:
    """Rate aliases, rolling, lag and status features; state restarts at each split."""
    named = series.rate_aliases(df)
    base = [c for c in series.RATE_ALIASES if c in named.columns] + schema.present(named, schema.gauges)
    keys = [*(["split"] if "split" in df.columns else []), *schema.series]
    return series.series_features(named, base, rolling, stats, lags, schema.present(named, schema.status), keys, [schema.ts])


@dataclass(frozen=True)
class PreprocessConfig:
    label: str
    key: str
    categorical: Sequence[str] = ()
    expected: Sequence[str] = ()
    clean: tables.CleanConfig = tables.CleanConfig()
    ratios: Sequence[float] = splits.RATIOS
    encoder: str = "onehot"
    scaler: str = "standard"
    seed: int = 42


def preprocess(df: DataFrame, config: PreprocessConfig) -> tuple[DataFrame, DataFrame]:
    """Validate, clean, split, encode, scale, narrow; returns the table with a ``split`` column and a one-row JSON manifest.

    Validation errors stop the job. Encoders and scalers are fitted on train only.
    """
    errors = profiling.check_schema(df, config.expected, config.label, config.categorical).where("severity = 'error'").collect()
    if errors:
        raise ValueError("; ".join(e["message"] for e in errors))
    cleaned, report = tables.clean(df, config.clean)
    parts = cut_lineage(splits.split_random(cleaned, config.key, config.ratios, config.label, config.seed))
    train = parts.where("split = 'train'")
    cats = [c for c in config.categorical if c in parts.columns]
    numeric = [c for c in tables.numeric_columns(parts) if c not in (config.key, config.label)]
    coded = parts
    if cats:
        enc = encoding.fit_onehot(train, cats) if config.encoder == "onehot" else encoding.fit_ordinal(train, cats)
        coded = enc.transform(parts)
    coded = encoding.fit_scaler(train, numeric, config.scaler).transform(coded)
    coded = encoding.fit_labels(train, config.label).transform(coded)
    out, narrowed = tables.narrow_types(coded)
    sizes = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {
        "clean": {r["step"]: r["n"] for r in report.collect()}, "rows": sizes, "encoder": config.encoder, "scaler": config.scaler,
        "features": [c for c in out.columns if c not in (config.key, config.label, "split")], "narrowed": narrowed,
    }
    return out, df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string")


def engineer_features(parts: Mapping[str, DataFrame], label: str, exclude: Sequence[str] = tables.PROVENANCE, variance: float = 0.0, correlation: float = 0.95,
                      method: str = "anova", k: int | None = None, pca: float | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Exclude, variance, correlation, select and optional PCA fitted on train, replayed on every split, with a removal report."""
    train = parts["train"]
    cols, removed = tables.feature_columns(train, label, exclude)
    reasons = [(c, "excluded") for c in removed]
    cols, low = selection.variance_filter(train, cols, variance)
    reasons += [(c, "low_variance") for c in low]
    kept, _pairs = selection.correlation_filter(train, cols, correlation)
    reasons += [(c, "correlated") for c in cols if c not in kept]
    chosen = selection.select_features(train, kept, label, method, k).columns if k else kept
    reasons += [(c, "not_selected") for c in kept if c not in chosen] + [(c, "selected") for c in chosen]
    fitted = selection.FeatureSelection(tuple(chosen), label)
    out = {n: fitted.transform(d) for n, d in parts.items()}
    if pca:
        model = learning.fit_pca(out["train"], chosen, pca)
        out = {n: model.transform(d).drop(*chosen) for n, d in out.items()}
    return out, train.sparkSession.createDataFrame(reasons, "feature string, reason string")
