"""Multi-class boosted trees: one tree per class and round, all classes share the softmax of their margins.

Every round fits Spark's regression trees to the Newton step of the log loss: the target is gradient / hessian and
the weight is the hessian, so a leaf's mean is sum(gradient) / sum(hessian), with each row's step bounded by ``LARGEST``. Rows are combined
to weighted instances first (``instances``), and margins are written every round. The trees of a class end up in one
``GBTRegressionModel``, which Spark scores in one pass and saves by itself. A validation table, or a flag column of
the training table, stops the rounds early at the best log loss.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any, Sequence

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.instances import WEIGHT, combine
from opsframe.session import cut_lineage

#: Smallest hessian of a row, so that targets stay finite for rows that are all but certain.
LEAST = 1e-6
#: Largest Newton step of a row; steps of rows that are all but certain would overshoot.
LARGEST = 4.0
#: Trees of a round that are fitted at a time.
PARALLEL = 4


def softmax(margins: Column) -> Column:
    """Probabilities of an array of margins."""
    raised = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def log_loss(df: DataFrame, p: str, label: str) -> float | None:
    """Mean negative log-probability of the true class, weighted; labels outside the classes count as the least probability."""
    own = F.coalesce(F.try_element_at(F.col(p), F.col(label).cast("int") + 1), F.lit(0.0))
    loss = -F.log(F.greatest(own, F.lit(1e-15)))
    return df.agg(F.try_divide(F.sum(loss * F.col(WEIGHT)), F.sum(WEIGHT))).first()[0]


@dataclass
class BoostedClasses:
    """Boosted ensemble of every class, their start margins and the log loss of each round."""

    ensembles: Sequence[GBTRegressionModel]
    start: Sequence[float]
    rounds: int
    features_col: str = "features_vec"
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """``probability`` of every class as a vector and the ``prediction``, the first of the likeliest classes."""
        out = df
        for k, model in enumerate(self.ensembles):
            out = model.setFeaturesCol(self.features_col).setPredictionCol(f"_m{k}").transform(out)
        margins = F.array(*[F.lit(float(s)) + F.col(f"_m{k}") for k, s in enumerate(self.start)])
        out = out.withColumn("_p", softmax(margins)).drop(*[f"_m{k}" for k in range(len(self.ensembles))])
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_p")

    def rounds_table(self, spark: Any) -> DataFrame:
        return spark.createDataFrame(self.history, "round int, train_loss double, validation_loss double")


def _ensemble(trees: Sequence[DecisionTreeRegressionModel], weight: float, spark: Any) -> GBTRegressionModel:
    """Trees of one class as Spark's own ensemble."""
    jvm = spark.sparkContext._jvm
    gateway = spark.sparkContext._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, t in enumerate(trees):
        array[i], weights[i] = t._java_obj, float(weight)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("boosted")
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, array, weights))


def fit_boosted(df: DataFrame, label: str, classes: int, rounds: int = 20, depth: int = 4, rate: float = 0.3, valid: DataFrame | None = None,
                patience: int = 3, least_gain: float = 1e-4, seed: int = 42, features_col: str = "features_vec", bins: int = 32) -> BoostedClasses:
    """Fit on ``features_col`` and the class index ``label``; needs at least two classes.

    With ``valid`` the rounds end once ``patience`` rounds bring no gain of ``least_gain`` in its log loss, and those
    after the best round are dropped.
    """
    spark = df.sparkSession
    known = lambda d: None if d is None else d.where(F.col(label).isNotNull()).select(features_col, label)
    rows = combine(known(df), features_col, label, known(valid), bins)
    counts = {int(r[0]): r[1] for r in rows.fit.groupBy(label).agg(F.sum(WEIGHT)).collect()}  # one row per class
    total = sum(counts.values())
    if classes < 2 or not total:
        raise ValueError("boosting needs rows of two classes at least")
    start = [math.log((counts.get(k, 0) + 1) / (total + classes)) for k in range(classes)]
    margins = F.array(*[F.lit(s) for s in start])
    work, held = (None if d is None else _written(d, margins) for d in (rows.fit, rows.valid))
    trees: list[list[DecisionTreeRegressionModel]] = [[] for _ in range(classes)]
    history, best, best_round, gained, gained_round = [], math.inf, 0, math.inf, 0
    for round_ in range(1, rounds + 1):
        steps = work

        def fit_class(k: int) -> DecisionTreeRegressionModel:
            pk = F.get("_p", F.lit(k))
            hessian = F.greatest(pk * (1 - pk), F.lit(LEAST))
            gradient = F.when(F.col(label) == k, 1.0).otherwise(0.0) - pk
            target = F.greatest(F.least(gradient / hessian, F.lit(LARGEST)), F.lit(-LARGEST))
            data = steps.select(features_col, target.alias("_t"), (hessian * F.col(WEIGHT)).alias("_h"))
            tree = DecisionTreeRegressor(featuresCol=features_col, labelCol="_t", weightCol="_h", predictionCol=f"_s{k}", maxDepth=depth, maxBins=rows.bins, seed=seed + round_)
            return tree.fit(data)

        with ThreadPool(min(classes, PARALLEL)) as pool:  # a round's trees don't depend on each other
            fitted = pool.map(inheritable_thread_target(spark)(fit_class), range(classes))
        for own, tree in zip(trees, fitted):
            own.append(tree)
        work, held = (None if d is None else _advance(d, fitted, rate) for d in (work, held))
        loss = log_loss(work, "_p", label)
        checked = None if held is None else log_loss(held, "_p", label)
        history.append((round_, loss, checked))
        if checked is None or checked < best:
            best, best_round = checked if checked is not None else loss, round_
        if checked is None or checked < gained - least_gain:
            gained, gained_round = best, round_
        elif round_ - gained_round >= patience:
            break
    return BoostedClasses([_ensemble(t[:best_round], rate, spark) for t in trees], start, best_round, features_col, history)


def _written(df: DataFrame, margins: Column) -> DataFrame:
    """``df`` with its margins and the classes' probabilities, as the trees of a round read them several times each."""
    rows = df.withColumn("_margins", margins)
    return cut_lineage(rows.withColumn("_p", softmax(F.col("_margins"))))


def _advance(df: DataFrame, fitted: Sequence[DecisionTreeRegressionModel], rate: float) -> DataFrame:
    """Margins after one more tree of every class."""
    out = df
    for t in fitted:
        out = t.transform(out)
    moved = F.array(*[F.get("_margins", F.lit(k)) + rate * F.col(f"_s{k}") for k in range(len(fitted))])
    return _written(out.withColumn("_moved", moved).select(*[c for c in df.columns if c not in ("_margins", "_p")], F.col("_moved")), F.col("_moved")).drop("_moved")
