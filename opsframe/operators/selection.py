"""Feature selection: variance, redundancy, scores, top-k and replay."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.quantiles import exact_quantiles
from opsframe.functions.ranking import running_totals
from opsframe.functions.scalars import nan_to_null, pick
from opsframe.session import cut_lineage


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(cols)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("score")) for i, c in enumerate(cols)])).alias("p")).select("p.*")


def variance_filter(df: DataFrame, cols: Sequence[str], limit: float = 0.0) -> tuple[list[str], list[str]]:
    """(kept, dropped): sample variance at most ``limit`` drops a column."""
    v = {r["feature"]: r["score"] for r in variances(df, cols).collect()}  # one value per column
    dropped = [c for c in cols if v[c] is None or v[c] <= limit]
    return [c for c in cols if c not in dropped], dropped


#: Groups that the tasks' partial sums are merged in first, so that no task reads those of all tasks.
MERGE_GROUPS = 64
#: Sums of a pair of columns over the rows where both are known, about the centres ``cx`` and ``cy``.
SUMS = ["n", "x", "y", "xx", "yy", "xy"]
_PARTS = "i int, g int, cx double, cy array<double>, " + ", ".join(f"{k} array<double>" for k in SUMS)


def _gram(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of all column pairs of a task, about the means of its first rows; one row a column with the pairs it leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, n, x, xx, xy = None, *(np.zeros((k, k)) for _ in range(4))
        group = 0
        for b in batches:
            if not b.num_rows:
                continue
            group = int(b.column(k)[0].as_py()) if centre is None else group
            v = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])
            known = ~np.isnan(v)
            if centre is None:
                centre = np.where(known.any(axis=0), np.where(known, v, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), 0.0)
            v, m = np.where(known, v - centre, 0.0), known.astype(float)
            n += m.T @ m
            x += v.T @ m
            xx += (v * v).T @ m
            xy += v.T @ v
        if centre is None:
            return
        rows = {"i": range(k), "g": [group] * k, "cx": centre, "cy": [centre[i + 1:] for i in range(k)]}
        for name, part in (("n", n), ("x", x), ("y", x.T), ("xx", xx), ("yy", xx.T), ("xy", xy)):
            rows[name] = [part[i, i + 1:] for i in range(k)]
        kinds = [pa.int32(), pa.int32(), pa.float64()] + [pa.list_(pa.float64())] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(rows.values(), kinds)], names=list(rows))

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of several partial sums, moved to the first one's centres."""
    cx, cy = pdf["cx"].iloc[0], np.asarray(pdf["cy"].iloc[0], float)
    total = {k: np.zeros(len(cy)) for k in SUMS}
    for r in pdf.to_dict("records"):
        s = {k: np.asarray(r[k], float) for k in SUMS}
        dx, dy = r["cx"] - cx, np.asarray(r["cy"], float) - cy
        s["xy"] = s["xy"] + dx * s["y"] + dy * s["x"] + s["n"] * dx * dy
        s["xx"], s["yy"] = s["xx"] + 2 * dx * s["x"] + s["n"] * dx * dx, s["yy"] + 2 * dy * s["y"] + s["n"] * dy * dy
        s["x"], s["y"] = s["x"] + s["n"] * dx, s["y"] + s["n"] * dy
        for k in SUMS:
            total[k] += s[k]
    return pd.DataFrame([{"i": pdf["i"].iloc[0], "g": pdf["g"].iloc[0], "cx": cx, "cy": cy, **total}])


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) of every column pair over rows where both are known (NaN is not), from one scan.

    A task adds the Gram matrices of its batches; partial sums are merged in two steps by column. Null where a column is constant.
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)], F.spark_partition_id().alias("g"))
    parts = numbers.mapInArrow(_gram(len(cols)), _PARTS)
    once = parts.groupBy("i", F.pmod("g", F.lit(MERGE_GROUPS)).alias("m")).applyInPandas(lambda pdf: _merged(pdf), _PARTS)
    sums = once.groupBy("i").applyInPandas(lambda pdf: _merged(pdf), _PARTS)
    names = F.array(*[F.lit(c) for c in cols])
    cell = F.explode(F.arrays_zip(*SUMS, F.sequence(F.col("i") + 1, F.lit(len(cols) - 1)).alias("j")))
    m = sums.where(F.col("i") < len(cols) - 1).select("i", cell.alias("m")).select("i", "m.*")
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    varies = (F.col("n") > 0) & (vx > 1e-12) & (vy > 1e-12)
    return m.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.when(varies, cov / F.sqrt(vx * vy)).alias("r"))


def ranked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns replaced by tie-averaged ranks, all of them through one long table of (row, column, value)."""
    base = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))  # the numbers must stay the same
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), nan_to_null(F.col(f"`{c}`").cast("double")).alias("v")) for i, c in enumerate(cols)]))
    cells = base.select("_row", cell.alias("p")).select("_row", "p.*")
    known = cells.where("v is not null")
    counts = known.groupBy("j", "v").agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_totals(counts, ["v"], {"_before": "_n"}, ["j"], costly=True).select("j", "v", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("rank"))
    every = known.join(ranks, ["j", "v"]).select("_row", "j", "rank").unionByName(cells.where("v is null").select("_row", "j", F.lit(None).cast("double").alias("rank")))
    rows = every.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("j", "rank"))).alias("_ranks"))  # one entry a column
    out = base.join(rows, "_row")
    at = {c: i for i, c in enumerate(cols)}
    return out.select(*[F.element_at("_ranks", F.lit(at[c])).alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def correlation_filter(df: DataFrame, cols: Sequence[str], limit: float = 0.95, method: str = "pearson") -> tuple[list[str], DataFrame]:
    """Kept columns and the redundant pairs; a column goes when |r| reaches the limit with any earlier one."""
    base = df.select(*cols) if method == "pearson" else ranked(df.select(*cols), cols)
    pairs = correlations(base, cols).where(F.abs("r") >= limit)
    dropped = {r["b"] for r in pairs.select("b").distinct().collect()}  # column names only
    return [c for c in cols if c not in dropped], pairs


def _long(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols]))
    return df.select(F.col(label).cast("string").alias("y"), cells.alias("p")).select("y", "p.*").where("x is not null and not isnan(x)")


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Information between quantile-binned features and the label, from one contingency count."""
    q = exact_quantiles(df, cols, [i / bins for i in range(1, bins)])
    binned = df.select(F.col(label).cast("string").alias("y"), *[
        pick([(F.col(c) <= e, i) for i, e in enumerate(sorted({v for v in q[c] if v is not None}))], len(q[c])).alias(c) if q[c][0] is not None else F.lit(0).alias(c) for c in cols])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bin")) for c in cols]))
    n = binned.select("y", cells.alias("p")).groupBy("p.feature", "p.bin", "y").agg(F.count(F.lit(1)).alias("n"))
    px = n.groupBy("feature", "bin").agg(F.sum("n").alias("nx"))
    py = n.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    tot = n.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = n.join(px, ["feature", "bin"]).join(py, ["feature", "y"]).join(tot, "feature")
    p = F.col("n") / F.col("nt")
    return j.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(p * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny"))))).alias("score"))


def chi2_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Chi-square of min-max scaled sums per class against the class share; non-finite results are 0."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"b{i}"))]).first()
    scaled = df.select(label, *[((F.col(c).cast("double") - F.lit(row[f"a{i}"])) / F.lit((row[f"b{i}"] - row[f"a{i}"]) or 1.0)).alias(c) for i, c in enumerate(cols)])
    g = _long(scaled, cols, label).groupBy("feature", "y").agg(F.sum("x").alias("observed"), F.count(F.lit(1)).alias("n"))
    tot = g.groupBy("feature").agg(F.sum("observed").alias("s"), F.sum("n").alias("nt"))
    e = F.col("s") * F.col("n") / F.col("nt")
    part = g.join(tot, "feature").withColumn("c", F.try_divide((F.col("observed") - e) * (F.col("observed") - e), e))
    return part.groupBy("feature").agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("score"))


def anova_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """F statistic per feature from per-class moments of centred values; non-finite results are 0."""
    mean = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centred = df.select(label, *[(F.col(c).cast("double") - F.lit(mean[f"m{i}"])).alias(c) for i, c in enumerate(cols)])
    g = _long(centred, cols, label).groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    t = g.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return t.select("feature", F.coalesce(score, F.lit(0.0)).alias("score"))


def top_features(scores: DataFrame, cols: Sequence[str], k: int) -> list[str]:
    """Best ``k`` feature names; ties keep column order."""
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    return [r["feature"] for r in scores.orderBy(F.desc("score"), order).limit(k).collect()]


@dataclass(frozen=True)
class FeatureSelection:
    """Fitted selection, replayed on other tables in recorded order."""

    columns: Sequence[str]
    label: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns, *([self.label] if self.label and self.label in df.columns else []))


def select_features(df: DataFrame, cols: Sequence[str], label: str, method: str, k: int) -> FeatureSelection:
    from opsframe.operators import learning

    makers = {
        "mutual_information": mutual_information, "chi2": chi2_scores, "anova": anova_scores, "importance": learning.tree_importance,
        "variance": lambda d, c, _l: variances(d, c),
    }
    if method not in makers:
        raise ValueError(f"unknown method: {method}")
    return FeatureSelection(top_features(makers[method](df, cols, label), cols, k), label)
