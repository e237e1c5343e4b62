"""Table shaping and cleaning: projections, contracts, imputation, clipping, narrowing."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from opsframe.functions.quantiles import exact_quantiles
from opsframe.functions.scalars import SEVERITY_RANK, severity_rank
from opsframe.session import cut_lineage

NUMERIC = ("byte", "short", "integer", "long", "float", "double")
FLOATS = ("float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC or f.dataType.typeName().startswith("decimal")]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in FLOATS]


def is_missing(df: DataFrame, c: str) -> Column:
    return (F.col(c).isNull() | F.isnan(F.col(c))) if c in float_columns(df) else F.col(c).isNull()


@dataclass(frozen=True)
class Roles:
    """Column roles of a labelled table."""

    label: str | None = None
    categorical: Sequence[str] = ()
    identifiers: Sequence[str] = ()
    kinds: Mapping[str, str] = field(default_factory=dict)


# ---------------------------------------------------------------- projection
def drop_present(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    hit = [c for c in cols if c in df.columns]
    return df.drop(*hit), hit


# Provenance columns that never feed a model.
PROVENANCE = ["split", "source_file", "__split__", "__source__", "difficulty"]


def feature_columns(df: DataFrame, label: str, exclude: Sequence[str] = PROVENANCE) -> tuple[list[str], list[str]]:
    """(kept, removed) feature names: provenance by name, then every non-numeric column."""
    banned = {c.lower() for c in exclude}
    numeric = set(numeric_columns(df))
    rest = [c for c in df.columns if c != label]
    kept = [c for c in rest if c.lower() not in banned and c in numeric]
    return kept, [c for c in rest if c not in kept]


def infer_kinds(df: DataFrame, roles: Roles = Roles()) -> dict[str, str]:
    """Declared roles first, then the type."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if f.name == roles.label:
            kind = "target"
        elif f.name in roles.kinds:
            kind = roles.kinds[f.name]
        elif f.name in roles.identifiers:
            kind = "identifier"
        elif f.name in roles.categorical:
            kind = "categorical"
        elif t in ("timestamp", "timestamp_ntz", "date"):
            kind = "timestamp"
        elif t == "boolean":
            kind = "binary"
        else:
            kind = "numerical" if f.name in numeric_columns(df) else "categorical"
        out[f.name] = kind
    return out


def require_columns(df: DataFrame, cols: Sequence[str], shown: int = 10) -> tuple[DataFrame, list[str]]:
    """Required columns in the required order, plus the names of ignored extra ones."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        more = f" and {len(missing) - shown} more" if len(missing) > shown else ""
        raise ValueError(f"missing required columns: {', '.join(missing[:shown])}{more}")
    return df.select(*cols), [c for c in df.columns if c not in cols]


def search_events(df: DataFrame, contains: Mapping[str, str] = {}, device: str | None = None, limit: int = 100,
                  device_cols: Sequence[str] = ("device", "hostname", "source_ip"), newest: Sequence[str] = ("timestamp",), event_id: str | None = None) -> DataFrame:
    """Case-insensitive substring filters, newest first, top ``limit``."""
    if event_id is not None:
        return df.where(F.col("event_id") == event_id)
    has = lambda c, q: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q.lower()))
    out = df
    for c, q in contains.items():
        out = out.where(has(c, q))
    if device:
        cond = F.lit(False)
        for c in device_cols:
            if c in df.columns:
                cond = cond | has(c, device)
        out = out.where(cond)
    return out.orderBy(*[F.desc_nulls_last(c) for c in newest]).limit(limit)


def filter_incidents(df: DataFrame, severities: Sequence[str] = (), rules: Sequence[str] = (), ordinal: str = "ord") -> DataFrame:
    """Incidents of chosen severities and rules, most severe first."""
    out = df
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    if rules:
        out = out.where(F.col("rule_id").isin(*rules))
    return out.withColumn("severity_rank", severity_rank("severity", SEVERITY_RANK)).orderBy("severity_rank", ordinal)


def narrow_types(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Smallest integer type that holds min..max; double to float when every value survives."""
    ints = [f.name for f in df.schema.fields if f.dataType.typeName() in ("short", "integer", "long")]
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    if not ints and not doubles:
        return df, {}
    row = df.agg(
        *[x for c in ints for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))],
        *[F.coalesce(F.bool_and(F.col(c).cast("float").cast("double").eqNullSafe(F.col(c))), F.lit(False)).alias(f"ok_{c}") for c in doubles],
    ).first()
    changed = {}
    for c in ints:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is None:
            continue
        for name, bits in (("byte", 7), ("short", 15), ("int", 31)):
            if -(2**bits) <= lo and hi < 2**bits:
                if {"byte": "byte", "short": "short", "int": "integer"}[name] != df.schema[c].dataType.typeName():
                    changed[c] = name
                break
    changed.update({c: "float" for c in doubles if row[f"ok_{c}"]})
    return df.withColumns({c: F.col(c).cast(t) for c, t in changed.items()}) if changed else df, changed


# ------------------------------------------------------------------ cleaning
def _inf(c: str) -> Column:
    return F.abs(F.col(c)) == float("inf")


def replace_inf(df: DataFrame) -> DataFrame:
    """Infinite cells become null (and NaN with them)."""
    return df.withColumns({c: F.when(~_inf(c) & ~F.isnan(c), F.col(c)) for c in float_columns(df)}) if float_columns(df) else df


def count_inf(df: DataFrame) -> DataFrame:
    cols = float_columns(df)
    row = df.agg(*[F.count_if(_inf(c)).alias(c) for c in cols])
    return unpivot_counts(row, cols).where("n > 0")


def unpivot_counts(row: DataFrame, cols: Sequence[str], name: str = "column", value: str = "n") -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in cols]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def drop_duplicates(df: DataFrame, keep: str = "first") -> DataFrame:
    """Whole-row duplicates; ``none`` drops every member of a repeated group."""
    if keep in ("first", "last"):
        return df.dropDuplicates()
    if keep != "none":
        raise ValueError(f"unknown keep: {keep}")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def _extents(df: DataFrame) -> list[Column]:
    """Smallest, largest and number of known values per column, and the rows: what shows a constant column."""
    kinds = dict(df.dtypes)
    orderable = lambda c: F.to_json(F.col(f"`{c}`")) if "map<" in kinds[c] else F.col(f"`{c}`")  # noqa: E731 - maps have no order
    return [x for i, c in enumerate(df.columns) for x in (
        F.min(orderable(c)).alias(f"lo{i}"), F.max(orderable(c)).alias(f"hi{i}"), F.count(f"`{c}`").alias(f"n{i}"))] + [F.count(F.lit(1)).alias("rows")]


def _constants(row: Row, columns: Sequence[str]) -> list[str]:
    return [c for i, c in enumerate(columns) if row[f"n{i}"] == 0 or (row[f"n{i}"] == row["rows"] and row[f"lo{i}"] == row[f"hi{i}"])]


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, null counted as a value; one min/max aggregate."""
    return _constants(df.agg(*_extents(df)).first(), df.columns) if df.columns else []


def drop_constant(df: DataFrame) -> tuple[DataFrame, list[str]]:
    cols = constant_columns(df)
    return df.drop(*cols), cols


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def _with_missing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    if not cols:
        return []
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"m{i}"]]


def numeric_fills(df: DataFrame, strategy: str, cols: Sequence[str] | None = None, need: Sequence[str] | None = None) -> dict[str, float]:
    """Fill value per numeric column that has missing cells; ``need`` names them if they are known."""
    need = _with_missing(df, numeric_columns(df) if cols is None else cols) if need is None else [c for c in need if c in numeric_columns(df)]
    if not need or strategy in ("none", "drop"):
        return {}
    if strategy == "zero":
        return {c: 0.0 for c in need}
    if strategy == "median":
        return {c: v[0] for c, v in exact_quantiles(df, need, [0.5]).items() if v[0] is not None}
    if strategy == "mean":
        row = df.agg(*[F.avg(F.when(~is_missing(df, c), F.col(c))).alias(f"a{i}") for i, c in enumerate(need)]).first()
        return {c: row[f"a{i}"] for i, c in enumerate(need) if row[f"a{i}"] is not None}
    raise ValueError(f"unknown numeric strategy: {strategy}")


def impute_numeric(df: DataFrame, strategy: str = "median", need: Sequence[str] | None = None) -> DataFrame:
    if strategy == "drop":
        need = _with_missing(df, numeric_columns(df)) if need is None else [c for c in need if c in numeric_columns(df)]
        return df.dropna(subset=need) if need else df
    fills = numeric_fills(df, strategy, need=need)
    return df.withColumns({c: F.when(is_missing(df, c), F.lit(v)).otherwise(F.col(c)) for c, v in fills.items()}) if fills else df


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, Any]:
    """Most frequent value per column, ties to the smallest: one grouped count for all columns, so no single task holds all values."""
    kinds = dict(df.dtypes)
    out: dict[str, Any] = {c: None for c in cols}
    for kind in sorted({kinds[c] for c in cols}):
        own = [c for c in cols if kinds[c] == kind]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in own]))
        counts = df.select(cells.alias("p")).select("p.*").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        out |= {r["c"]: r["v"] for r in best.collect()}  # one row a column
    return out


def impute_categorical(df: DataFrame, strategy: str = "most_frequent", fill: str = "__missing__", need: Sequence[str] | None = None) -> DataFrame:
    numeric = set(numeric_columns(df))
    cols = [c for c in df.columns if c not in numeric]
    if strategy == "none":
        return df
    need = _with_missing(df, cols) if need is None else [c for c in need if c in cols]
    if not need:
        return df
    if strategy == "drop":
        return df.dropna(subset=need)
    if strategy == "most_frequent":
        modes = most_frequent(df, need)
    elif strategy == "constant":
        modes = {}
    else:
        raise ValueError(f"unknown categorical strategy: {strategy}")
    kinds = dict(df.dtypes)
    # the text fill goes into text columns only; other types without a mode stay missing
    values = {c: F.lit(modes[c]) if modes.get(c) is not None else F.lit(fill) for c in need if modes.get(c) is not None or kinds[c] == "string"}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def iqr_bounds(df: DataFrame, factor: float = 1.5, cols: Sequence[str] | None = None) -> dict[str, tuple[float, float]]:
    numeric = numeric_columns(df)
    chosen = [c for c in cols or [] if c in numeric] or numeric
    out = {}
    for c, (q1, q3) in exact_quantiles(df, chosen, [0.25, 0.75]).items():
        if q1 is None or q3 - q1 == 0 or abs(q3 - q1) == float("inf") or q3 != q3:
            continue
        out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def clip_iqr(df: DataFrame, factor: float = 1.5, cols: Sequence[str] | None = None, bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Clip to Q1 - k·IQR .. Q3 + k·IQR, or to the given bounds; null stays null."""
    out = {}
    for c, (lo, hi) in (iqr_bounds(df, factor, cols) if bounds is None else bounds).items():
        e = F.col(c).cast("double")
        out[c] = F.when(e < lo, F.lit(lo)).when(e > hi, F.lit(hi)).otherwise(e)
    return df.withColumns(out) if out else df


@dataclass(frozen=True)
class CleanConfig:
    drop: Sequence[str] = ()
    inf: bool = True
    duplicates: str | None = "first"
    constants: bool = True
    all_null: bool = True
    numeric: str = "median"
    categorical: str = "most_frequent"
    clip_factor: float | None = None
    narrow: bool = True


def clean(df: DataFrame, config: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning job and a report of (step, n) rows.

    Scans: one of the input for all its counts; one that de-duplicates and writes; of what is written, one for constant
    columns, one for empty rows and gaps, those of the exact quantiles, and one for the closing counts.
    """
    work, dropped = drop_present(df, config.drop)
    floats = float_columns(work) if config.inf else []
    seen = df.agg(F.count(F.lit(1)), *[F.count_if(is_missing(df, c)) for c in df.columns], *[F.count_if(_inf(c)) for c in floats]).first()
    rows, missing, infinite = seen[0], seen[1:1 + len(df.columns)], seen[1 + len(df.columns):]
    steps: list[tuple[str, int]] = [("rows_before", rows), ("columns_before", len(df.columns)), ("missing_before", sum(missing)), ("columns_dropped", len(dropped))]
    if config.inf:
        steps.append(("inf_cells", sum(infinite)))
        work = replace_inf(work)
    if config.duplicates:
        work = cut_lineage(drop_duplicates(work, config.duplicates))  # all that follows reads it
    known = work.agg(*_extents(work)).first()
    if config.duplicates:
        steps.append(("duplicate_rows", rows - known["rows"]))
        rows = known["rows"]
    if config.constants:
        gone = _constants(known, work.columns)
        work = work.drop(*gone)
        steps.append(("constant_columns", len(gone)))
    empty = functools.reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in work.columns], F.lit(bool(work.columns))) if config.all_null else F.lit(False)
    gaps = work.agg(F.count_if(empty), *[F.count_if(~empty & is_missing(work, c)) for c in work.columns]).first()
    if config.all_null:
        work = drop_all_null(work) if work.columns else work
        steps.append(("all_null_rows", gaps[0]))
    need = [c for c, n in zip(work.columns, gaps[1:]) if n]
    work = impute_categorical(impute_numeric(work, config.numeric, need), config.categorical, need=None if config.numeric == "drop" else need)
    bounds = iqr_bounds(work, config.clip_factor) if config.clip_factor else {}
    clipped = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in bounds.items()]
    gap = lambda c: F.col(f"`{c}`").isNull() if c in bounds else is_missing(work, c)  # noqa: E731 - clipping leaves no NaN, narrowing no new gap
    end = work.agg(F.count(F.lit(1)), *clipped, *[F.count_if(gap(c)) for c in work.columns]).first()
    if config.clip_factor:
        steps.append(("clipped_cells", sum(end[1:1 + len(clipped)])))
        work = clip_iqr(work, config.clip_factor, bounds=bounds)
    if config.narrow:
        work, changed = narrow_types(work)
        steps.append(("narrowed_columns", len(changed)))
    steps += [("rows_after", end[0]), ("columns_after", len(work.columns)), ("missing_after", sum(end[1 + len(clipped):]))]
    return work, df.sparkSession.createDataFrame(steps, "step string, n long")
