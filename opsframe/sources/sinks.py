"""Sinks: tables, append-only event stores and flat CSV exports."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", compression).parquet(path)
    elif fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def append_events(df: DataFrame, path: str, partition_by: str = "source_key", fmt: str = "parquet") -> None:
    """Append to an event store with one sub-directory per source."""
    df.write.mode("append").partitionBy(partition_by).format(fmt).save(path)


def _flat(c: Column, t: T.DataType, name: str) -> list[Column]:
    if isinstance(t, T.StructType):
        return [x for f in t.fields for x in _flat(c[f.name], f.dataType, f"{name}_{f.name}")]
    if isinstance(t, T.ArrayType):
        text = F.array_join(F.transform(c, lambda v: v.cast("string")), ";")
    elif isinstance(t, T.MapType):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return [F.coalesce(text, F.lit("")).alias(name)]


def flatten_for_csv(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Nested rows as flat text: lists joined with ``;``, structs prefixed, missing cells empty, fixed order."""
    cols = [x for f in df.schema.fields for x in _flat(F.col(f"`{f.name}`"), f.dataType, f.name)]
    flat = df.select(*cols)
    return flat if fields is None else flat.select(*[F.col(f) if f in flat.columns else F.lit("").alias(f) for f in fields])
