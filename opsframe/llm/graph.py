"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import written


def _starred(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) joined with the smallest neighbour ``m`` of each u.

    The minima are written first: both join sides then are plain shuffles, which Spark splits where one
    node has very many edges.
    """
    return edges.join(written(edges.groupBy("u").agg(F.min("v").alias("m"))), "u")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node with an edge; ``root`` is the smallest node reachable.

    Each step is written to the shared folder, so no plan grows with the steps. Self loops and repeated
    edges have no effect; an empty table gives no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now)
    state = _state(now)
    while True:
        both = written(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _starred(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = written(large)
        hub = _starred(large)
        small = hub.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hub.select("u", F.col("m").alias("v")))
        now = written(small.distinct())
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
