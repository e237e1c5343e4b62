"""Weighted instances for trees: rows that no split tells apart are combined, so that fitting depends on bins, not rows.

Every feature is rounded to the nearest of at most ``bins`` levels: its own values if it has no more, else evenly chosen
quantiles of the whole table. Trees split rounded features half way between two levels, so a raw row takes the path of
its rounded one. Rows that are alike in all levels and the label become one or more instances whose weights add up to
their number; none outweighs ``1 / ROWS`` of the table, which keeps bootstrap samples as varied as those of ``ROWS`` rows.
Tables of up to ``ROWS`` rows, and those that combining does not make at least ``GAIN`` times smaller, stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.session import cut_lineage

ROWS = 100_000
CELLS = 1_000_000
GAIN = 2
#: Column of the instances' weights.
WEIGHT = "_w"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def levels(df: DataFrame, features_col: str, bins: int = 32) -> dict[int, np.ndarray]:
    """Sorted levels of every feature that has a value; NaN is none."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for i, x in enumerate(_matrix(b.column(0)).T):
                if len(seen.get(i, ())) <= bins:
                    found = np.union1d(seen.get(i, np.zeros(0)), x)
                    seen[i] = found[~np.isnan(found)][: bins + 1]
        rows = [(i, v) for i, vs in seen.items() for v in vs]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.float64())], names=["i", "v"])

    arrays = df.select(vector_to_array(features_col).alias("a"))
    values = arrays.mapInArrow(few, "i int, v double").groupBy("i").agg(F.collect_set("v").alias("v"))  # at most bins + 1 a task
    found = values.select("i", F.size("v").alias("n"), F.slice("v", 1, bins + 1).alias("v")).collect()
    out = {r["i"]: np.unique(r["v"]) for r in found if r["n"] <= bins}
    many = sorted(r["i"] for r in found if r["n"] > bins)
    if many:
        wide = arrays.select(*[F.get("a", F.lit(i)).alias(f"f{i}") for i in many])
        shares = [(j + 0.5) / (4 * bins) for j in range(4 * bins)]
        for i, q in zip(many, wide.approxQuantile([f"f{i}" for i in many], shares, 1 / (16 * bins))):
            q = np.unique(q)
            out[i] = q[np.unique(np.linspace(0, len(q) - 1, min(bins, len(q))).round().astype(int))]
    return out


@dataclass(frozen=True)
class Binning:
    """Levels of the features and the weight that an instance may have."""

    levels: Mapping[int, np.ndarray]
    heaviest: float

    def cells(self, df: DataFrame, features_col: str, label: str) -> DataFrame:
        """``cell, label, n``: rows by their levels' numbers, a byte a feature (255: NaN)."""
        known = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(0))
                codes = np.full(x.shape, 255, np.uint8)
                for i, own in known.items():
                    at = np.searchsorted((own[:-1] + own[1:]) / 2, x[:, i])
                    codes[:, i] = np.where(np.isnan(x[:, i]), 255, at)
                cell = pa.Array.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([cell, b.column(1)], names=["cell", label])

        rows = df.select(vector_to_array(features_col).alias("a"), F.col(label).cast("double").alias(label)).mapInArrow(run, f"cell binary, `{label}` double")
        return cut_lineage(rows.groupBy("cell", label).agg(F.count(F.lit(1)).alias("n")))

    def instances(self, cells: DataFrame, features_col: str, label: str, metadata: Mapping = {}) -> DataFrame:
        """``features_col, label, WEIGHT`` of the cells; heavy ones several times with a part of their weight."""
        known = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                x = np.full(codes.shape, np.nan)
                for i, own in known.items():
                    x[:, i] = np.append(own, np.full(256 - len(own), np.nan))[codes[:, i]]
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())), b.column(1), b.column(2)], names=["a", label, WEIGHT])

        parts = F.ceil(F.col("n") / self.heaviest).cast("int")
        tasks = max(2, cells.sparkSession.sparkContext.defaultParallelism)
        split = cells.select("cell", label, (F.col("n") / parts).alias(WEIGHT), F.explode(F.sequence(F.lit(1), parts)).alias("part"))
        dealt = split.repartition(tasks, "cell", label, "part").sortWithinPartitions("cell", label, "part")  # equal rows give equal bootstrap samples
        made = dealt.select("cell", label, WEIGHT).mapInArrow(run, f"a array<double>, `{label}` double, {WEIGHT} double")
        return cut_lineage(made.select(array_to_vector("a").alias(features_col, metadata=dict(metadata)), label, WEIGHT))


@dataclass(frozen=True)
class Instances:
    """Training and validation tables with ``WEIGHT``, and the number of bins with which Spark's trees take every level."""

    fit: DataFrame
    valid: DataFrame | None
    bins: int


def combine(df: DataFrame, features_col: str, label: str, valid: DataFrame | None = None, bins: int = 32) -> Instances:
    """Instances of a table of vectors ``features_col`` and numbers ``label``; ``valid`` gets the same levels."""
    one = lambda d: None if d is None else d.select(features_col, label, F.lit(1.0).alias(WEIGHT))
    n = df.count()
    if n <= ROWS or not 2 <= bins <= 250:
        return Instances(one(df), one(valid), bins)
    binning = Binning(levels(df, features_col, bins), n / ROWS)
    cells = binning.cells(df, features_col, label)
    n_cells = cells.count()
    if n_cells * GAIN > n or n_cells > CELLS:
        return Instances(one(df), one(valid), bins)
    metadata = df.schema[features_col].metadata
    made = binning.instances(cells, features_col, label, metadata)
    held = None if valid is None else binning.instances(binning.cells(valid, features_col, label), features_col, label, metadata)
    return Instances(made, held, max(bins, math.isqrt(made.count() + (held.count() if held is not None else 0)) + 1))  # Spark samples rows for splits beyond bins ** 2
