"""Evaluation tables over predictions (true class, predicted class, scores)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions.quantiles import exact_quantiles
from opsframe.functions.ranking import running_totals
from opsframe.functions.scalars import pick


def pair_counts(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """The one grouped count every class metric is built from."""
    return df.groupBy(F.col(true).cast("string").alias("y_true"), F.col(pred).cast("string").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def _labels(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("y_true").alias("label")).unionByName(counts.select(F.col("y_pred").alias("label"))).distinct()


def confusion(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Every (true, predicted) pair of the label list, zeros kept.

    The grid is built from the label vocabulary alone; the counts join it by key.
    """
    counts = pair_counts(df)
    if labels is None:
        names = _labels(counts).agg(F.array_sort(F.collect_list("label")).alias("v"))  # the class list, which the matrix spells out anyway
    else:
        names = df.sparkSession.range(1).select(F.array(*[F.lit(x) for x in labels]).alias("v"))
    grid = names.select(F.explode("v").alias("y_true"), "v").select("y_true", F.explode("v").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def class_metrics(df: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1, support, FP, FN, false-positive rate."""
    c = pair_counts(df)
    t = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    total = c.agg(F.sum("n").alias("total"))
    d = t.join(p, "label", "full_outer").fillna(0, ["support", "tp", "predicted"]).join(F.broadcast(total))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, sup, pr = F.col("tp"), F.col("support"), F.col("predicted")
    return d.select(
        "label", "support", ratio(tp, pr).alias("precision"), ratio(tp, sup).alias("recall"), ratio(2 * tp, sup + pr).alias("f1"),
        (pr - tp).alias("fp"), (sup - tp).alias("fn"), ratio(pr - tp, F.col("total") - sup).alias("fpr"), "tp", "total")


def classification_metrics(df: DataFrame, average: str = "weighted") -> DataFrame:
    """Accuracy and averaged precision, recall, F1; undefined parts count as 0."""
    m = class_metrics(df)
    if average == "weighted":
        avg = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    else:
        avg = lambda c: F.avg(c).alias(c)
    return m.agg((F.sum("tp") / F.max("total")).alias("accuracy"), avg("precision"), avg("recall"), avg("f1"))


def fpr(df: DataFrame) -> DataFrame:
    """False-positive rate per class and the macro mean; with two classes the headline is the larger label's."""
    m = class_metrics(df).select("label", "fpr")
    row = m.agg(F.avg("fpr").alias("macro"), F.count(F.lit(1)).alias("k"), F.max_by("fpr", "label").alias("last"))
    macro = row.select(F.lit("__macro__").alias("label"), F.col("macro").alias("fpr"))
    head = row.select(F.lit("__headline__").alias("label"), F.when(F.col("k") == 2, F.col("last")).otherwise(F.col("macro")).alias("fpr"))
    return m.unionByName(macro).unionByName(head)


def roc_auc(df: DataFrame, positive: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank statistic with ties at one half, from running totals over distinct scores."""
    d = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    g = d.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    r = running_totals(g, ["_s"], {"below": "neg"}, by, costly=True)
    parts = r.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return parts.select(*by, F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def roc_auc_ovr(df: DataFrame, scores: dict[str, str], true: str = "y_true", weighted: bool = True) -> DataFrame:
    """One-vs-rest AUC over the classes present; null with fewer than two classes."""
    slots = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(s).cast("double").alias("score")) for c, s in scores.items()]))
    long = df.select(F.col(true).cast("string").alias("t"), slots.alias("p")).select((F.col("t") == F.col("p.cls")).alias("is_pos"), "p.*")
    per = roc_auc(long, "is_pos", "score", ["cls"]).where("positives > 0 and negatives > 0")
    value = F.sum(F.col("auc") * F.col("positives")) / F.sum("positives") if weighted else F.avg("auc")
    return per.agg(F.when(F.count(F.lit(1)) >= 2, value).alias("auc"), F.count(F.lit(1)).alias("classes"))


def anomaly_metrics(df: DataFrame, label: str = "label", flag: str = "flag", score: str = "score") -> DataFrame:
    y, f = F.col(label) == 1, F.col(flag) == 1
    c = df.agg(F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    auc = roc_auc(df.select(y.alias("is_pos"), score), "is_pos", score).select("auc")
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")).join(F.broadcast(auc))


def score_summary(df: DataFrame, score: str = "score", flag: str = "flag") -> DataFrame:
    """Anomaly rate and score distribution without labels."""
    q = exact_quantiles(df, [score], [0.5, 0.95, 0.99])[score]
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(flag) == 1).cast("double")).alias("anomaly_rate"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
        *[F.lit(v).cast("double").alias(k) for k, v in zip(("p50", "p95", "p99"), q)], F.max(score).alias("max"))


def hardest_classes(df: DataFrame, n: int | None = None) -> DataFrame:
    w = Window.orderBy("f1", F.desc("support"), "label")  # one row per class
    ranked = class_metrics(df).where("support > 0").withColumn("rank", F.row_number().over(w)).select("rank", "label", "f1", "support")
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def misclassified(df: DataFrame, n: int, score: str = "score", keys: Sequence[str] = (), positive: str | None = None) -> DataFrame:
    """Most confident errors first, top ``n``; with a positive class the error kind is named."""
    d = df.where(F.col("y_true") != F.col("y_pred"))
    if positive is not None:
        d = d.withColumn("kind", F.when(F.col("y_pred") == positive, "false_positive").otherwise("false_negative"))
    return d.orderBy(F.desc_nulls_last(score), *keys).limit(n)


def analyze_errors(df: DataFrame) -> DataFrame:
    """One summary row: rows, misclassified, accuracy, macro and weighted F1."""
    m = class_metrics(df)
    return m.agg(
        F.max("total").alias("rows"), (F.max("total") - F.sum("tp")).alias("misclassified"), (F.sum("tp") / F.max("total")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def rank_contributions(df: DataFrame) -> DataFrame:
    """(row_id, feature, output, value): outputs averaged per row, then mean and deviation of |value|, percent, cumulative percent and rank per feature."""
    per = df.groupBy("row_id", "feature").agg(F.avg(F.abs("value")).alias("a"))
    g = per.groupBy("feature").agg(F.avg("a").alias("mean_abs"), F.stddev_pop("a").alias("std_abs"))
    total = g.agg(F.sum("mean_abs").alias("_t"))
    g = g.join(F.broadcast(total)).withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("mean_abs"), F.col("_t")), F.lit(0.0))).drop("_t")
    w = Window.orderBy(F.desc("mean_abs"), "feature")  # one row per feature
    return g.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum("percent").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rank_row_contributions(df: DataFrame, top: int = 10) -> DataFrame:
    w = Window.partitionBy("row_id").orderBy(F.desc(F.abs("value")), "feature", "output")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def threshold(df: DataFrame, score: str, q: float) -> float:
    """Decision threshold: exact quantile of all training scores; rows strictly above are flagged."""
    return exact_quantiles(df, [score], [q])[score][0]


def flag_above(df: DataFrame, score: str, cut: float, out: str = "flag") -> DataFrame:
    return df.withColumn(out, pick([(F.col(score) > cut, 1)], 0))
