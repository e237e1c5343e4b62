"""Total orders, ranks and running totals without a single-task window.

A global window would pull the table into one task. Here rows are first dealt
into key ranges of near-equal size, as many as the session's shuffles have
partitions; per-range totals are summed on a table of one row per range and
group, and ranks are finished inside each range.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.session import cut_lineage


def in_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``_bucket``, the number of their range of ``keys``, ascending with them (null first).

    Written to the checkpoint folder: a plan that ran twice could sample other bounds.
    """
    return cut_lineage(df.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()))


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = (), costly: bool = False) -> DataFrame:
    """Add, for each ``{out: source}``, the total of ``source`` over all earlier rows.

    ``order`` must be unique inside ``by``. The input is read twice, to find the ranges and to deal the
    rows; ``costly`` writes it to the checkpoint folder first.
    """
    cut = in_ranges(cut_lineage(df) if costly else df, [*by, *order])
    part = cut.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_b_{o}") for o, s in sums.items()])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select(*by, "_bucket", *[F.coalesce(F.sum(f"_b_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    if not by:
        base = F.broadcast(base)  # one row per range
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [cut[c].eqNullSafe(base[c]) for c in [*by, "_bucket"]]  # a null group is a group
    out = cut.join(base, same).select(cut["*"], *[base[f"_b_{o}"] for o in sums])
    for o, s in sums.items():
        out = out.withColumn(o, F.col(f"_b_{o}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("_bucket", *[f"_b_{o}" for o in sums])


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "rank", costly: bool = False) -> DataFrame:
    """1-based position in a total order over the whole table or inside ``by``."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}, by, costly)
    return ranked.withColumn(out, (F.col(out) + 1).cast("long")).drop("_one")


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), out: str = "rank", bits: int | None = None) -> DataFrame:
    """Seeded pseudo-random position inside ``by``; ``key`` must be unique.

    Hash prefixes are uniform, so each (group, prefix) range stays even however large one group is. There
    are at least four prefixes for each partition of the session's shuffles.
    """
    bits = bits or max(10, math.ceil(math.log2(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    h = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    h = h.withColumn("_p", F.shiftright("_h", 64 - bits))
    part = h.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select(*by, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if not by:
        base = F.broadcast(base)  # at most 2**bits rows
    cond = [h[c].eqNullSafe(base[c]) for c in [*by, "_p"]]
    joined = h.join(base, cond).select(h["*"], base["_base"])
    w = Window.partitionBy(*by, "_p").orderBy("_h", key)
    return joined.withColumn(out, F.col("_base") + F.row_number().over(w)).drop("_h", "_p", "_base")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Distinct values of one column with their tie-averaged rank (nulls left out)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    tot = running_totals(counts, [value], {"_before": "_n"}, costly=True)
    return tot.select(value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
