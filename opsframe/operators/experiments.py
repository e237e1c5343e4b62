"""Experiment tables: index, leaderboards, comparisons, best runs and registry steps."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.scalars import lookup, pick

# Model families.
FAMILIES = {"xgboost": "tree", "lightgbm": "tree", "gbt": "tree", "forest": "tree", "mlp": "deep", "cnn1d": "deep", "lstm": "deep", "transformer": "deep"}
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
MIN_BETTER = ["train_seconds", "size_mb", "inference_seconds"]


def experiment_index(manifests: DataFrame, digits: int = 6) -> DataFrame:
    """Index rows: metrics of the preferred split (test, validation, train), ``k=v`` parameters; order by created_at.

    ``manifests``: experiment_id, dataset, model_type, created_at, params map, metrics map(split → map(metric → double)).
    """
    m = F.coalesce(*[F.element_at("metrics", s) for s in ("test", "validation", "train")])
    split = pick([(F.element_at("metrics", s).isNotNull(), s) for s in ("test", "validation", "train")])
    params = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return manifests.select("experiment_id", "dataset", "model_type", "created_at", split.alias("split"), *[F.round(F.element_at(m, k), digits).alias(k) for k in METRICS], params.alias("params"))


def latest_runs(df: DataFrame) -> DataFrame:
    """Latest run per (dataset, model) with the number of runs; a combined aggregate, not a window."""
    rest = [c for c in df.columns if c not in ("dataset", "model_type")]
    g = df.groupBy("dataset", "model_type").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("created_at", F.lit("")), "experiment_id")).alias("r"), F.count(F.lit(1)).alias("runs"))
    return g.select("dataset", "model_type", "r.*", "runs")


def leaderboard(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("dataset").orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("accuracy"), F.desc_nulls_last("roc_auc"), "model_type")
    return df.withColumn("rank", F.row_number().over(w)).withColumn("winner", F.col("rank") == 1)


def model_means(df: DataFrame) -> DataFrame:
    return df.groupBy("model_type").agg(*[F.avg(c).alias(c) for c in ("f1", "accuracy", "roc_auc", "train_seconds") if c in df.columns], F.count_distinct("dataset").alias("datasets"))


def family_means(df: DataFrame) -> DataFrame:
    fam = lookup("model_type", FAMILIES, "other")
    best = F.struct(F.coalesce("f1", F.lit(-1.0)), "model_type", "dataset")
    return df.groupBy(fam.alias("family")).agg(
        F.avg("f1").alias("f1"), F.avg("accuracy").alias("accuracy"), F.avg("train_seconds").alias("train_seconds"),
        F.min_by("model_type", F.struct("train_seconds", "model_type", "dataset")).alias("fastest"), F.max_by("model_type", best).alias("top_f1_model"))


def efficiency_leaders(df: DataFrame) -> DataFrame:
    """Leader per criterion: fastest training, smallest, fastest inference, F1 per minute, F1 per MB."""
    crit = {
        "train_seconds": -F.col("train_seconds"), "size_mb": -F.col("size_mb"), "inference_seconds": -F.col("inference_seconds"),
        "f1_per_minute": F.try_divide(F.col("f1").cast("double"), F.col("train_seconds").cast("double") / 60), "f1_per_mb": F.try_divide(F.col("f1").cast("double"), F.col("size_mb").cast("double")),
    }
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), e.cast("double").alias("v")) for k, e in crit.items()]))
    d = df.select("dataset", "model_type", slots.alias("p")).select("dataset", "model_type", "p.*").where("v is not null")
    top = d.groupBy("criterion").agg(F.min(F.struct(-F.col("v"), "model_type", "dataset")).alias("b"), F.max("v").alias("v"))
    return top.select("criterion", "b.model_type", "b.dataset", F.when(F.col("criterion").isin(*MIN_BETTER), -F.col("v")).otherwise(F.col("v")).alias("value"))


def headline_facts(board: DataFrame, gap: float = 0.002) -> DataFrame:
    """(fact, value) rows: same winner everywhere, family sweep, datasets with a close second place."""
    first = board.where("rank = 1").select("dataset", "model_type", F.col("f1").alias("a"))
    second = board.where("rank = 2").select("dataset", F.col("f1").alias("b"))
    j = first.join(second, "dataset", "left").withColumn("family", lookup("model_type", FAMILIES, "other"))
    row = j.agg(
        F.when(F.count_distinct("model_type") == 1, F.max("model_type")).alias("same_winner"), F.when(F.count_distinct("family") == 1, F.max("family")).alias("family_sweep"),
        F.count_if(F.round(F.col("a") - F.col("b"), 9) <= gap).cast("string").alias("close_datasets"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).alias("value")) for k in row.columns])).alias("p")).select("p.*")


def best_runs(df: DataFrame, metric: str = "f1", higher: bool = True, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Best non-archived run per group; equal values go to the smaller id."""
    d = df.where(F.coalesce("stage", F.lit("")) != "archived").where(F.col(metric).isNotNull())
    v = -F.col(metric) if higher else F.col(metric)
    rest = [c for c in df.columns if c not in by]
    return d.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(v, "experiment_id")).alias("r")).select(*by, "r.*")


def register(runs: DataFrame, min_value: float | None = None, metric: str = "f1", datasets: Sequence[str] | None = None) -> DataFrame:
    """Runs that pass the registration policy, as new ``candidate`` entries."""
    d = runs.where(F.col(metric).isNotNull())
    if min_value is not None:
        d = d.where(F.col(metric) >= min_value)
    if datasets is not None:
        d = d.where(F.col("dataset").isin(*datasets))
    return d.withColumn("stage", F.lit("candidate"))


def promote(registry: DataFrame, chosen: DataFrame, reason: str, at: str) -> DataFrame:
    """New registry version: chosen (dataset, experiment_id) go to production, the previous production row is demoted with the reason."""
    c = chosen.select("dataset", F.col("experiment_id").alias("_new"))
    j = registry.join(c, "dataset", "left")
    up = F.col("experiment_id") == F.col("_new")
    down = F.col("_new").isNotNull() & ~up & (F.col("stage") == "production")
    return j.withColumns({
        "stage": F.when(up, "production").when(down, "archived").otherwise(F.col("stage")), "reason": F.when(up | down, reason),
        "changed_at": F.when(up | down, at)}).drop("_new")


def resolve(registry: DataFrame, stage: str = "production") -> DataFrame:
    """Entry per dataset at a stage, else the best registered run."""
    at = registry.where(F.col("stage") == stage).groupBy("dataset").agg(F.max("experiment_id").alias("staged"))
    best = best_runs(registry.select("dataset", "experiment_id", "f1", "stage")).select("dataset", F.col("experiment_id").alias("best"))
    return best.join(at, "dataset", "full_outer").select("dataset", F.coalesce("staged", "best").alias("experiment_id"), F.when(F.col("staged").isNotNull(), stage).otherwise("best").alias("via"))
