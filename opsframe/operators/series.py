"""Per-series window functions that stay even when one series holds much of the table.

Windows are partitioned by (series, time chunk), not by series. What a chunk
needs from earlier chunks (the last few rows, or the last known values) is
carried over by a small table with one entry per (series, chunk).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

DAY = 86400
SERIES = ("device_id", "interface_id")


def with_chunk(df: DataFrame, ts: str = "ts", seconds: int = DAY) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds).cast("long"))


def with_history(df: DataFrame, n: int, series: Sequence[str] = SERIES, order: Sequence[str] = ("ts",), seconds: int = DAY) -> DataFrame:
    """Add copies of the ``n`` rows before each chunk, marked ``_past``; drop them after the window."""
    ts = order[0]
    base = with_chunk(df, ts, seconds)
    keys = [*series, "_chunk"]
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    tail = base.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")
    payload = [c for c in df.columns if c not in series]
    by_order = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*payload).alias("v"))), by_order)
    packed = tail.groupBy(*keys).agg(F.transform(rows, lambda r: r["v"]).alias("rows"))
    # every chunk holds at least one row, so n earlier chunks hold the n earlier rows
    before = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(-n, -1)
    carried = packed.withColumn("rows", F.flatten(F.collect_list("rows").over(before)))
    carried = carried.withColumn("rows", F.slice("rows", -F.greatest(F.least(F.size("rows"), F.lit(n)), F.lit(1)), n)).where(F.size("rows") > 0)
    past = carried.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*", F.lit(True).alias("_past"))
    return base.withColumn("_past", F.lit(False)).unionByName(past)


def chunk_window(series: Sequence[str] = SERIES, order: Sequence[str] = ("ts",)):
    return Window.partitionBy(*series, "_chunk").orderBy(*order)


def drop_history(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_past")).drop("_past", "_chunk")


def dedupe_readings(df: DataFrame, keys: Sequence[str] = ("ts", *SERIES), tiebreak: str = "event_id") -> DataFrame:
    """First reading per key; a map-side combined aggregate, not a window.

    Each column is picked by the same rule over the same rows, so all come from one reading; numbers need no sort, as a struct would.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, tiebreak).alias(c) for c in rest]).select(*df.columns)


def fill_series(df: DataFrame, cols: Sequence[str], series: Sequence[str] = SERIES, order: Sequence[str] = ("ts",), seconds: int = DAY, dropped: Observation | None = None) -> DataFrame:
    """Forward fill, then back fill the leading gap; rows still incomplete are dropped.

    A row without a value up to it in its chunk has the chunk's first value next, else that of a later chunk. No window is open
    towards its end, which would take the square of its rows. ``dropped`` counts them as ``dropped`` when the plan runs, without a scan of its own.
    """
    base = with_chunk(df, order[0], seconds)
    keys = [*series, "_chunk"]
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    ends = base.groupBy(*keys).agg(
        *[F.max_by(c, seen(c)).alias(f"_l_{c}") for c in cols], *[F.min_by(c, seen(c)).alias(f"_f_{c}") for c in cols]
    )
    past, future = (Window.partitionBy(*series).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_chunk", F.desc("_chunk")))
    carried = ends.select(
        *keys,
        *[F.last(f"_l_{c}", ignorenulls=True).over(past).alias(f"_p_{c}") for c in cols],
        *[F.coalesce(f"_f_{c}", F.last(f"_f_{c}", ignorenulls=True).over(future)).alias(f"_n_{c}") for c in cols],
    )
    back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(carried, keys)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_p_{c}"), F.col(f"_n_{c}")) for c in cols}
    out = out.withColumns(filled).select(*df.columns)
    if dropped is not None:
        gaps = F.lit(False)
        for c in cols:
            gaps = gaps | F.col(c).isNull()
        out = out.observe(dropped, F.count_if(gaps).alias("dropped"))
    return out.dropna(subset=list(cols))


def counter_rates(df: DataFrame, counters: Sequence[str], clip_resets: bool = True, series: Sequence[str] = SERIES, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``<c>_delta`` and per-second ``<c>_rate``; the first row of a series is 0."""
    h = with_history(df, 1, series, order)
    w = chunk_window(series, order)
    stamp = F.unix_micros(F.col(order[0]).cast("timestamp"))
    seconds = (stamp - F.lag(stamp).over(w)) / 1e6
    out = h.withColumn("_sec", seconds)
    for c in counters:
        delta = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)).cast("double")
        out = out.withColumn(f"{c}_delta", F.when((delta < 0) & F.lit(clip_resets), 0.0).otherwise(delta))
    for c in counters:
        out = out.withColumn(f"{c}_rate", F.coalesce(F.when(F.col("_sec") > 0, F.col(f"{c}_delta") / F.col("_sec")), F.lit(0.0)))
    return drop_history(out.drop("_sec"))


def resample(df: DataFrame, duration: str, series: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Mean of every numeric column per series and fixed bin; empty bins do not appear."""
    skip = {*series, ts}
    numeric = [f.name for f in df.schema.fields if f.name not in skip and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    binned = df.groupBy(*series, F.window(F.col(ts).cast("timestamp"), duration).start.alias(ts)).agg(*[F.avg(c).alias(c) for c in numeric])
    return binned.dropna("all", subset=numeric).select(ts, *series, *numeric)


# Feature name and the counter rate it renames.
RATE_ALIASES = {
    "traffic_in_rate": "ifInOctets_rate",
    "traffic_out_rate": "ifOutOctets_rate",
    "error_rate_in": "ifInErrors_rate",
    "error_rate_out": "ifOutErrors_rate",
    "discard_rate_in": "ifInDiscards_rate",
    "discard_rate_out": "ifOutDiscards_rate",
}


def rate_aliases(df: DataFrame, aliases: dict[str, str] = RATE_ALIASES) -> DataFrame:
    return df.select("*", *[F.col(src).alias(out) for out, src in aliases.items() if src in df.columns])


def _rolling(cols, windows, stats, w) -> dict[str, Column]:
    fns = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}
    out = {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        for stat in stats:
            for c in cols:
                out[f"{c}_roll{n}_{stat}"] = F.coalesce(fns[stat](F.col(c)).over(frame).cast("double"), F.lit(0.0))
    return out


def _lags(cols, ns, w) -> dict[str, Column]:
    return {f"{c}_lag{n}": F.coalesce(F.lag(c, n).over(w).cast("double"), F.lit(0.0)) for n in ns for c in cols}


def _changes(cols, w) -> dict[str, Column]:
    return {f"{c}_changed": (F.lag(c).over(w).isNotNull() & ~F.lag(c).over(w).eqNullSafe(F.col(c))).cast("int") for c in cols}


def rolling(df, cols, windows=(3,), stats=("mean",), series=SERIES, order=("ts",)) -> DataFrame:
    """Causal statistics over the last n rows; the deviation of one row is 0."""
    h = with_history(df, max(windows), series, order)
    return drop_history(h.withColumns(_rolling(cols, windows, stats, chunk_window(series, order))))


def lags(df, cols, ns=(1,), series=SERIES, order=("ts",)) -> DataFrame:
    h = with_history(df, max(ns), series, order)
    return drop_history(h.withColumns(_lags(cols, ns, chunk_window(series, order))))


def status_changes(df, cols, series=SERIES, order=("ts",)) -> DataFrame:
    h = with_history(df, 1, series, order)
    return drop_history(h.withColumns(_changes(cols, chunk_window(series, order))))


def series_features(df, base, windows=(3,), stats=("mean",), ns=(1,), status=(), series=SERIES, order=("ts",)) -> DataFrame:
    """Rolling, lag and status features from one window pass; put ``split`` into ``series`` to restart per split."""
    h = with_history(df, max([*windows, *ns, 1]), series, order)
    w = chunk_window(series, order)
    return drop_history(h.withColumns({**_rolling(base, windows, stats, w), **_lags(base, ns, w), **_changes(status, w)}))


def pair_snapshots(df: DataFrame, device: str, label: str, seconds: int = DAY) -> DataFrame:
    """Each snapshot beside the previous one of its device: ``before`` and ``after`` structs."""
    h = with_history(df, 1, [device], [label], seconds)
    w = chunk_window([device], [label])
    names = [c for c in df.columns if c != device]
    after = F.struct(*names)
    out = h.withColumn("before", F.lag(after).over(w)).withColumn("after", after)
    return drop_history(out).where("before is not null").select(device, "before", "after")
