"""Training and scoring on Spark ML, plus a distributed isolation forest."""

from __future__ import annotations

import functools
import itertools
import math
import random
import time
from dataclasses import dataclass
from typing import Any, Iterator, Mapping, NamedTuple, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.operators import metrics as met
from opsframe.operators.boosting import BoostedClasses, fit_boosted
from opsframe.operators.encoding import decode_labels
from opsframe.operators.instances import WEIGHT, combine
from opsframe.operators.profiling import audit_matrix
from opsframe.operators.tables import require_columns
from opsframe.session import cut_lineage

MIN_TRAIN_ROWS = 10
#: Parameters of Spark's trees that are about single rows.
BY_ROWS = {"minInstancesPerNode", "weightCol"}


@dataclass(frozen=True)
class Boosted:
    """Boosted classes behind the interface of a pipeline model."""

    assembler: VectorAssembler
    boosted: BoostedClasses

    def transform(self, df: DataFrame) -> DataFrame:
        return self.boosted.transform(self.assembler.transform(df))


@dataclass(frozen=True)
class Classifier:
    """Fitted model with its features and class names."""

    kind: str
    model: PipelineModel | Boosted
    features: Sequence[str]
    classes: Sequence[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Contract check, then ``y_pred`` and, where the model gives them, class probabilities."""
        require_columns(df, self.features)
        out = self.model.transform(df)
        out = decode_labels(out, self.classes, "prediction", "y_pred")
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
            out = out.withColumn("score", F.array_max("probabilities"))
        return out.drop("features_vec", "scaled_vec", "rawPrediction", "probability", "prediction", "_y")


def _indexed(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string"))
    return df.withColumn("_y", (pos - 1).cast("double"))


def class_names(df: DataFrame, label: str) -> list[str]:
    """Classes in order; a model holds them by name, so the driver does too."""
    return [r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def train(df: DataFrame, label: str, features: Sequence[str], kind: str = "forest", seed: int = 42, valid: DataFrame | None = None, **params: Any) -> Classifier:
    """Forest, boosted trees or a feed-forward network, each with class probabilities.

    ``valid`` ends the rounds of boosted trees early; the other kinds don't use it. Boosted trees are Spark's for two
    classes; for more of them one tree per class and round shares the classes' margins. Trees are fitted to combined rows
    (``instances``), unless ``params`` count or weigh rows.
    """
    classes = class_names(df, label)
    data = _indexed(df, label, classes).where("_y is not null")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features_vec", handleInvalid="keep" if kind != "mlp" else "error")
    common = dict(featuresCol="features_vec", labelCol="_y")
    stages: list[Any] = [assembler]
    vectors = lambda d: assembler.transform(d.select("_y", *features))
    if kind == "forest":
        given = {"numTrees": 20, "maxDepth": 5, **params}
        if not BY_ROWS & set(given):
            rows = combine(vectors(data), "features_vec", "_y", bins=given.get("maxBins", 32))
            model = RandomForestClassifier(seed=seed, weightCol=WEIGHT, **common, **given | {"maxBins": rows.bins}).fit(rows.fit).copy()  # copies lack the summary, which holds the session
            return Classifier(kind, PipelineModel([assembler, model]), tuple(features), tuple(classes))
        stages.append(RandomForestClassifier(seed=seed, **common, **given))
    elif kind == "gbt":
        held = _indexed(valid, label, classes).where("_y is not null") if valid is not None else None
        given = {"maxIter": 10, "maxDepth": 4, **params}
        if len(classes) > 2:
            rest = {k: given[v] for k, v in (("rate", "stepSize"), ("bins", "maxBins"), ("patience", "patience"), ("least_gain", "least_gain")) if v in given}
            fitted = fit_boosted(vectors(data), "_y", len(classes), given["maxIter"], given["maxDepth"], valid=vectors(held) if held is not None else None, seed=seed, **rest)
            return Classifier(kind, Boosted(assembler, fitted), tuple(features), tuple(classes))
        if not BY_ROWS & set(given):
            rows = combine(vectors(data), "features_vec", "_y", vectors(held) if held is not None else None, given.get("maxBins", 32))
            fit = rows.fit
            if rows.valid is not None:
                fit = fit.withColumn("_held", F.lit(False)).unionByName(rows.valid.withColumn("_held", F.lit(True)))
                given["validationIndicatorCol"] = "_held"
            model = GBTClassifier(seed=seed, weightCol=WEIGHT, **common, **given | {"maxBins": rows.bins}).fit(fit)
            return Classifier(kind, PipelineModel([assembler, model]), tuple(features), tuple(classes))
        if held is not None:
            data = data.select("_y", *features, F.lit(False).alias("_held")).unionByName(held.select("_y", *features, F.lit(True).alias("_held")))
            given["validationIndicatorCol"] = "_held"
        stages.append(GBTClassifier(seed=seed, **common, **given))
    elif kind == "mlp":
        stages.append(StandardScaler(inputCol="features_vec", outputCol="scaled_vec", withMean=True, withStd=True))
        layers = [len(features), *params.pop("hidden", [16]), len(classes)]
        stages.append(MultilayerPerceptronClassifier(featuresCol="scaled_vec", labelCol="_y", layers=layers, seed=seed, **{"maxIter": 30, **params}))
    else:
        raise ValueError(f"unknown model kind: {kind}")
    fitted = Pipeline(stages=stages).fit(data)
    return Classifier(kind, fitted.copy() if kind == "forest" else fitted, tuple(features), tuple(classes))


def tree_importance(df: DataFrame, cols: Sequence[str], label: str, n: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Impurity importance per feature of a random forest."""
    c = train(df, label, cols, "forest", seed, numTrees=n, maxDepth=depth)
    values = c.model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(cols, values)], "feature string, score double")


def rfe(df: DataFrame, cols: Sequence[str], label: str, k: int | None = None, step: int = 1, seed: int = 42) -> DataFrame:
    """Recursive elimination with forest fits; score is 1 / rank, kept features rank 1."""
    left = list(cols)
    k = k or max(1, len(left) // 2)
    rank: dict[str, int] = {}
    while len(left) > k:
        scores = {r["feature"]: r["score"] for r in tree_importance(df, left, label, seed=seed).collect()}  # one value per feature
        worst = sorted(left, key=lambda c: (scores[c], -left.index(c)))[: min(step, len(left) - k)]
        left = [c for c in left if c not in worst]
        for c in worst:
            rank[c] = len(left) - k + 2
    rank.update({c: 1 for c in left})
    return df.sparkSession.createDataFrame([(c, rank[c], 1.0 / rank[c]) for c in cols], "feature string, rank int, score double")


@dataclass(frozen=True)
class FittedPca:
    model: PipelineModel
    k: int
    explained: Sequence[float]

    def transform(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(F.col("_pc"))
        out = self.model.transform(df).withColumn("_arr", arr)
        return out.select(*df.columns, *[F.get("_arr", F.lit(i)).alias(f"pc_{i + 1}") for i in range(self.k)])


def fit_pca(df: DataFrame, cols: Sequence[str], fraction: float = 0.95) -> FittedPca:
    """Fewest components whose explained variance reaches ``fraction``; centred, signs are arbitrary."""
    stages = [VectorAssembler(inputCols=list(cols), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False), PCA(k=len(cols), inputCol="_centred", outputCol="_pc")]
    model = Pipeline(stages=stages).fit(df)
    shares = list(model.stages[-1].explainedVariance.toArray())
    total, k = 0.0, 0
    while k < len(shares) and total < fraction - 1e-12:
        total += shares[k]
        k += 1
    return FittedPca(model, k, shares)


def evaluate(scored: DataFrame, label: str) -> DataFrame:
    return met.classification_metrics(scored.withColumn("y_true", F.col(label).cast("string")))


class Experiment(NamedTuple):
    """Fitted model, one row of metrics per split, confusion counts per split, and the audit of the feature matrix."""

    model: Classifier
    metrics: DataFrame
    confusion: DataFrame
    audit: DataFrame


def _split_metrics(scored: DataFrame, classes: Sequence[str], average: str) -> DataFrame:
    """One row: averages, AUC (second class, or one-vs-rest over all classes), headline false-positive rate."""
    out = met.classification_metrics(scored, average).withColumn("n_classes", F.lit(len(classes)))
    rate = met.fpr(scored).where("label = '__headline__'").select(F.col("fpr").alias("false_positive_rate"))
    if "probabilities" not in scored.columns:
        auc = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("roc_auc"))
    elif len(classes) == 2:
        auc = met.roc_auc(scored.select((F.col("y_true") == classes[1]).alias("positive"), F.get("probabilities", F.lit(1)).alias("p")), "positive", "p").select(F.col("auc").alias("roc_auc"))
    else:
        by_class = scored.select("y_true", *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(len(classes))])
        auc = met.roc_auc_ovr(by_class, {c: f"p{i}" for i, c in enumerate(classes)}, weighted=average == "weighted").select(F.col("auc").alias("roc_auc"))
    return out.join(F.broadcast(rate)).join(F.broadcast(auc))  # one row each


def run_experiment(splits: Mapping[str, DataFrame], label: str, features: Sequence[str], kind: str, average: str = "weighted",
                   min_rows: int = MIN_TRAIN_ROWS, strict: bool = True, **params: Any) -> Experiment:
    """Audit the features (``strict``: findings stop the job), fit on ``train`` (with ``validation``, if given), evaluate every split over all classes.

    Every split is scored once and written, which is what its ``predict_seconds`` time; metrics read the written scores.
    """
    rows = splits["train"].limit(min_rows).count()
    if rows < min_rows:
        raise ValueError(f"only {rows} training rows; {min_rows} are needed")
    if not features:
        raise ValueError("no feature columns to train on")
    audit = audit_matrix({n: d.select(*features, label) for n, d in splits.items()}, label, features)
    found = audit.limit(10).collect() if strict else []
    if found:
        raise ValueError("; ".join(f"{r['split']}: {r['problem']} {r['columns']}" for r in found))
    t0 = time.time()
    model = train(splits["train"], label, features, kind, valid=splits.get("validation") if kind == "gbt" else None, **params)
    seconds = time.time() - t0
    metrics, confusions = [], []
    for name, d in splits.items():
        t0 = time.time()
        scored = model.predict(d)
        kept = [c for c in ("probabilities",) if c in scored.columns]
        scored = cut_lineage(scored.select(F.col(label).cast("string").alias("y_true"), "y_pred", *kept))
        took = time.time() - t0
        metrics.append(_split_metrics(scored, model.classes, average).select(
            F.lit(name).alias("split"), "*", F.lit(seconds).alias("train_seconds"), F.lit(took).alias("predict_seconds")))
        confusions.append(met.confusion(scored, model.classes).withColumn("split", F.lit(name)))
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    return Experiment(model, union(metrics), union(confusions), audit)


def tune(train_df: DataFrame, valid: DataFrame, label: str, features: Sequence[str], kind: str, space: Mapping[str, Sequence[Any]], n: int = 5, metric: str = "f1", seed: int = 42) -> DataFrame:
    """Seeded random search scored on the validation split only; one row per trial, best first."""
    grid = [dict(zip(space, combo)) for combo in itertools.product(*space.values())]
    trials = random.Random(seed).sample(grid, min(n, len(grid)))
    rows = []
    for i, params in enumerate(trials):
        score = evaluate(train(train_df, label, features, kind, seed, **params).predict(valid), label).first()[metric]
        rows.append((i, ";".join(f"{k}={v}" for k, v in sorted(params.items())), float(score)))
    return train_df.sparkSession.createDataFrame(rows, "trial int, params string, value double").orderBy(F.desc("value"), "trial")


# ---------------------------------------------------------- isolation forest
def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: (node, feature, cut, left, right, depth credit)."""
    nodes: list[tuple] = []
    work = [(0, np.arange(len(x)), 0)]
    free = itertools.count(1)
    while work:
        node, idx, depth = work.pop()
        part = x[idx]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(idx) > 1 else np.array([], dtype=int)
        if depth >= limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + _average_path(len(idx))))
            continue
        f = int(rng.choice(spread))
        lo, hi = part[:, f].min(), part[:, f].max()
        cut = float(rng.uniform(lo, hi))
        below = part[:, f] < cut
        if below.all() or not below.any():
            below = part[:, f] <= lo
            cut = float(np.nextafter(lo, np.inf))
        left, right = next(free), next(free)
        nodes.append((node, f, cut, left, right, 0.0))
        work += [(left, idx[below], depth + 1), (right, idx[~below], depth + 1)]
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    """Node table of all trees (at most trees × 2·sample rows) and its settings."""

    features: Sequence[str]
    nodes: pd.DataFrame
    sample: int

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Anomaly score 2^(−mean path / c(sample)); higher is worse."""
        names, c = list(self.features), _average_path(self.sample)
        trees = []
        for _, t in self.nodes.groupby("tree"):
            t = t.sort_values("node")
            trees.append(tuple(t[k].to_numpy() for k in ("feature", "cut", "left", "right", "credit")))
        shared = df.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf("double")
        def path_score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for b in batches:
                x = b.to_numpy(dtype=float)
                total = np.zeros(len(x))
                for feature, cut, left, right, credit in shared.value:
                    at = np.zeros(len(x), dtype=int)
                    while True:
                        f = feature[at]
                        inner = f >= 0
                        if not inner.any():
                            break
                        rows = np.flatnonzero(inner)
                        go = x[rows, f[rows]] < cut[at[rows]]
                        at[rows] = np.where(go, left[at[rows]], right[at[rows]])
                    total += credit[at]
                yield pd.Series(np.power(2.0, -total / (len(shared.value) * c)))

        return df.withColumn(out, path_score(F.struct(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])))


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str, trees: int = 50, sample: int = 256, seed: int = 42, label: str | None = None) -> IsolationForest:
    """Grow every tree in its own task from about ``sample`` hash-chosen rows; healthy rows only when labels exist.

    A row joins tree t when its hash falls under a threshold, so one shuffle of trees × sample rows feeds all trees
    and no table-sized group exists.
    """
    d = df if label is None else df.where(F.coalesce(F.col(label), F.lit(0)) == 0)
    n = d.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    psi = min(sample, n)
    share = min(1.0, 1.5 * psi / n + 10.0 / n)
    span = 1 << 30
    h = lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col(key), t), F.lit(span))
    member = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), h(t).alias("h"))), lambda s: s["h"] < int(share * span))
    picked = d.select(F.explode(member).alias("m"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).select("m.tree", "m.h", *features)
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["h", *names]).head(psi)[names].to_numpy(dtype=float)
        rows = _grow(x, np.random.default_rng(seed + tree), max(1, math.ceil(math.log2(max(2, psi)))))
        return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "cut", "left", "right", "credit"])

    table = picked.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, credit double")
    return IsolationForest(tuple(features), table.toPandas(), psi)
