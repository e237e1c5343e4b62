"""Encoders and scalers fitted on one table and replayed on others.

Encoders keep their values as a dictionary table, of any size, and look all columns up by key. Values that a large
share of the rows has are found when the encoder is fitted; they are at most ``1 / HOT`` a column and always broadcast.
A dictionary whose counted bytes stay under ``SMALL_BYTES`` is broadcast as a whole. Otherwise the rest is a shuffled
join in which rows that are already resolved, or have no value, carry keys of their own, so that no task gets them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.quantiles import exact_quantiles

#: Share of the rows from which a value is hot.
HOT = 0.001
SMALL_BYTES = 16 << 20
#: Keys that rows without an open value are dealt to.
SPREAD = 4096


def categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n, idx) of the sorted distinct values; stays a table, whatever its size."""
    from opsframe.functions.ranking import global_rank

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counted = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return global_rank(counted, ["value"], ["column"], "idx", costly=True).withColumn("idx", F.col("idx") - 1)


@dataclass(frozen=True)
class Dictionary:
    """Values of several columns; ``sizes`` has entries, bytes and rows by column."""

    table: DataFrame
    sizes: Mapping[str, tuple[int, int, int]]

    def lookup(self, df: DataFrame, names: Mapping[str, str]) -> DataFrame:
        """``df`` with the index of each column's value as ``names[column]``; null where the value is null or unknown."""
        out = df
        for c, name in names.items():
            entries, size, rows = self.sizes.get(c, (0, 0, 0))
            value = F.col(f"`{c}`").cast("string")
            if not entries:
                out = out.withColumn(name, F.lit(None).cast("long"))
                continue
            own = self.table.where(F.col("column") == c)
            if size <= SMALL_BYTES:
                t = own.select(F.col("value").alias("_v"), F.col("idx").alias(name))
                out = out.join(F.broadcast(t), value == F.col("_v"), "left").drop("_v")
                continue
            is_hot = F.col("n") >= HOT * rows
            hot = own.where(is_hot).select(F.col("value").alias("_v"), F.col("idx").alias("_hot"))
            rest = own.where(~is_hot).select(F.col("value").alias("_v"), F.lit(0).alias("_s"), F.col("idx").alias("_rest"))
            out = out.join(F.broadcast(hot), value == F.col("_v"), "left").drop("_v")
            closed = F.col("_hot").isNotNull() | value.isNull()
            salt = F.when(closed, 1 + F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(SPREAD))).otherwise(0).cast("int")
            out = out.withColumn("_s1", salt).withColumn("_v1", F.when(F.col("_s1") == 0, value).otherwise(F.lit("")))
            out = out.join(rest, (F.col("_v1") == F.col("_v")) & (F.col("_s1") == F.col("_s")), "left")
            out = out.withColumn(name, F.coalesce("_hot", "_rest")).drop("_v", "_s", "_v1", "_s1", "_hot", "_rest")
        return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in names.values()], *names.values())


def fit_dictionary(df: DataFrame, cols: Sequence[str]) -> Dictionary:
    """Distinct values of ``cols`` with their places; one row a column goes to the driver."""
    table = categories(df, cols)
    sums = table.groupBy("column").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("value") + 32).alias("size"), F.sum("n").alias("rows")).collect()
    return Dictionary(table, {r["column"]: (r["entries"], r["size"], r["rows"]) for r in sums})


@dataclass(frozen=True)
class OneHot:
    """Dense columns by ``transform``, one sparse vector by ``vectors``."""

    dictionary: Dictionary
    cols: Sequence[str]
    named: dict[str, list[str]] = field(default_factory=dict)

    @property
    def values(self) -> Mapping[str, Sequence[str]]:
        """Values by column, read when dense columns are asked for: their names are part of the plan anyway."""
        if not self.named:
            rows = self.dictionary.table.select("column", "value").orderBy("column", "idx").collect()
            self.named.update({c: [r["value"] for r in rows if r["column"] == c] for c in self.cols})
        return self.named

    def transform(self, df: DataFrame) -> DataFrame:
        """Other columns first, then one 0/1 column per value; unseen values give all zeros."""
        passed = [c for c in df.columns if c not in self.cols]
        hot = [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, vs in self.values.items() for v in vs]
        return df.select(*passed, *hot)

    def vectors(self, df: DataFrame, out: str = "onehot") -> DataFrame:
        """Other columns first, then one sparse vector over all values of all columns, whatever their number; unseen values give all zeros."""
        passed = [c for c in df.columns if c not in self.cols]
        sizes = {c: self.dictionary.sizes.get(c, (0, 0, 0))[0] for c in self.cols}
        found = self.dictionary.lookup(df, {c: f"_i_{i}" for i, c in enumerate(self.cols)})
        found = found.withColumns({f"_i_{i}": F.coalesce(F.col(f"_i_{i}"), F.lit(sizes[c])).cast("double") for i, c in enumerate(self.cols)})
        # the model's sizes come from one row with each column's highest index; a kept invalid index is the one past it, dropped as the last
        top = df.sparkSession.createDataFrame([tuple(float(max(0, sizes[c] - 1)) for c in self.cols)], [f"_i_{i}" for i in range(len(self.cols))])
        coder = OneHotEncoder(inputCols=top.columns, outputCols=[f"_h_{i}" for i in range(len(self.cols))], handleInvalid="keep", dropLast=True)
        hot = coder.fit(top).transform(found)
        return VectorAssembler(inputCols=[f"_h_{i}" for i in range(len(self.cols))], outputCol=out).transform(hot).select(*passed, out)


def fit_onehot(df: DataFrame, cols: Sequence[str]) -> OneHot:
    """Any number of values; ``transform`` names one column each, so many of them belong in ``vectors``."""
    return OneHot(fit_dictionary(df, cols), tuple(cols))


@dataclass(frozen=True)
class Ordinal:
    dictionary: Dictionary
    cols: Sequence[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Index of the sorted value under the same column name; unseen and null give -1."""
        found = self.dictionary.lookup(df, {c: f"_i_{i}" for i, c in enumerate(self.cols)})
        at = {c: i for i, c in enumerate(self.cols)}
        return found.select(*[
            F.coalesce(F.col(f"_i_{at[c]}"), F.lit(-1)).cast("long").alias(c) if c in at else F.col(f"`{c}`") for c in df.columns])


def fit_ordinal(df: DataFrame, cols: Sequence[str]) -> Ordinal:
    return Ordinal(fit_dictionary(df, cols), tuple(cols))


def fit_labels(df: DataFrame, label: str) -> Ordinal:
    return fit_ordinal(df, [label])


def decode_labels(df: DataFrame, classes: Sequence[str], column: str, out: str) -> DataFrame:
    """Class text of an index; values outside the list pass through as text."""
    i = F.col(column)
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.when((i >= 0) & (i < len(classes)), F.get(names, i.cast("int"))).otherwise(i.cast("string")))


@dataclass(frozen=True)
class Scaler:
    """(x - center) / scale per column; a zero scale counts as 1."""

    kind: str
    params: Mapping[str, tuple[float, float]]

    def expression(self, c: str) -> Column:
        center, scale = self.params[c]
        return (F.col(c).cast("double") - F.lit(center)) / F.lit(scale)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expression(c) for c in self.params if c in df.columns})


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> Scaler:
    if kind == "robust":
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        raw = {c: (v[1], v[2] - v[0]) for c, v in q.items() if v[0] is not None}
    else:
        v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
        if kind == "standard":
            aggs = [x for i, c in enumerate(cols) for x in (F.avg(v[c]).alias(f"a{i}"), F.stddev_pop(v[c]).alias(f"b{i}"))]
        elif kind == "minmax":
            aggs = [x for i, c in enumerate(cols) for x in (F.min(v[c]).alias(f"a{i}"), (F.max(v[c]) - F.min(v[c])).alias(f"b{i}"))]
        else:
            raise ValueError(f"unknown scaler: {kind}")
        row = df.agg(*aggs).first()
        raw = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols) if row[f"a{i}"] is not None}
    return Scaler(kind, {c: (float(a), float(b) if b else 1.0) for c, (a, b) in raw.items()})
