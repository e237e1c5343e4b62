"""Profiles, contract checks and quality rules over a table."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.quantiles import exact_quantiles
from opsframe.operators.tables import count_inf, float_columns, is_missing, numeric_columns, unpivot_counts

# Imbalance ratios that raise a warning and a recommendation.
SEVERE_IMBALANCE = 10.0
IMBALANCE_FLAG = 3.0
ISSUE = "severity string, code string, message string"


def missing_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    return unpivot_counts(row, df.columns).where("n > 0")


inf_counts = count_inf


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group; grouped counts combine before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_imbalance(dist: DataFrame) -> DataFrame:
    """One row; equal counts go to the smaller label."""
    named = dist.where("label is not null")
    return named.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.max("n").alias("majority_count"), F.min("n").alias("minority_count"), F.sum("n").alias("total"),
        F.min(F.struct(-F.col("n"), "label")).alias("_hi"), F.min(F.struct("n", "label")).alias("_lo"),
    ).select(
        "n_classes", F.col("_hi.label").alias("majority_class"), "majority_count", F.col("_lo.label").alias("minority_class"), "minority_count",
        F.try_divide(F.col("majority_count").cast("double"), F.col("minority_count")).alias("imbalance_ratio"),
        (F.col("majority_count") / F.col("total")).alias("majority_share"),
    )


def numeric_summary(df: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles, max per numeric column; non-finite results are null."""
    cols = numeric_columns(df)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    v = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    row = df.agg(*[F.struct(
        F.count(v[c]).alias("count"), F.avg(v[c]).alias("mean"), F.stddev_samp(v[c]).alias("std"), F.min(v[c]).alias("min"), F.max(v[c]).alias("max")).alias(f"s{i}")
        for i, c in enumerate(cols)])
    finite = lambda e: F.when((F.abs(e) != float("inf")) & ~F.isnan(e), e)
    parts = [F.struct(
        F.lit(c).alias("column"), F.col(f"s{i}.count").alias("count"),
        *[finite(F.col(f"s{i}.{k}")).alias(k) for k in ("mean", "std", "min")],
        *[finite(F.lit(q[c][j]).cast("double")).alias(k) for j, k in enumerate(("q25", "q50", "q75"))],
        finite(F.col(f"s{i}.max")).alias("max")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, distinct, top value, its frequency, missing; ties go to the smallest value."""
    cols = [c for c in df.columns if c not in numeric_columns(df)] if cols is None else list(cols)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"),
        F.min(F.when(seen, F.struct(-F.col("n"), "value"))).alias("_t"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("missing"),
    ).select("column", "count", "unique", F.col("_t.value").alias("top"), F.coalesce(-F.col("_t.col1"), F.lit(0)).alias("top_freq"), "missing")


def profile(df: DataFrame, label: str | None = None, categorical: Sequence[str] = ()) -> DataFrame:
    """Long table (section, column, key, value) of every part of a profile."""
    def long(d: DataFrame, section: str, key_col: str | None, values: Sequence[str]) -> DataFrame:
        k = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
        parts = F.array(*[F.struct(F.lit(v).alias("key"), F.col(v).cast("string").alias("value")) for v in values])
        return d.select(F.lit(section).alias("section"), k.alias("column"), F.explode(parts).alias("p")).select("section", "column", "p.key", "p.value")

    out = long(missing_counts(df), "missing", "column", ["n"]).unionByName(long(duplicate_count(df), "duplicates", None, ["duplicate_rows"]))
    if float_columns(df):
        out = out.unionByName(long(count_inf(df), "infinite", "column", ["n"]))
    out = out.unionByName(long(numeric_summary(df), "numeric", "column", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
    cats = list(categorical) or [c for c in df.columns if c not in numeric_columns(df)]
    if cats:
        out = out.unionByName(long(categorical_summary(df, cats), "categorical", "column", ["count", "unique", "top", "top_freq", "missing"]))
    if label:
        dist = label_distribution(df, label)
        out = out.unionByName(long(dist, "label", "label", ["n"])).unionByName(long(class_imbalance(dist), "imbalance", None, ["n_classes", "majority_class", "minority_class", "imbalance_ratio"]))
    return out


def check_schema(df: DataFrame, expected: Sequence[str] = (), label: str | None = None, categorical: Sequence[str] = ()) -> DataFrame:
    numeric = set(numeric_columns(df))
    rows = [("warning", "missing_expected_column", f"expected column '{c}' not found") for c in expected if c not in df.columns]
    if label and label not in df.columns:
        rows.append(("error", "missing_label", f"label column '{label}' not found"))
    for c in categorical:
        if c not in df.columns:
            rows.append(("warning", "missing_categorical", f"categorical column '{c}' not found"))
        elif c in numeric:
            rows.append(("warning", "categorical_is_numeric", f"categorical column '{c}' is stored as a number"))
    return df.sparkSession.createDataFrame(rows, ISSUE)


def check_quality(df: DataFrame, label: str | None = None, severe: float = SEVERE_IMBALANCE) -> DataFrame:
    """Issue rows (severity, code, subject, n) from small profile tables."""
    miss = missing_counts(df)
    issue = lambda d, sev, code, subject, n: d.select(F.lit(sev).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"), n.cast("double").alias("n"))
    none = F.lit(None).cast("string")
    out = issue(duplicate_count(df).where("duplicate_rows > 0"), "warning", "duplicate_rows", none, F.col("duplicate_rows"))
    out = out.unionByName(issue(miss.agg(F.sum("n").alias("n")).where("n > 0"), "warning", "missing_values", none, F.col("n")))
    if float_columns(df):
        out = out.unionByName(issue(count_inf(df), "warning", "infinite_values", F.col("column"), F.col("n")))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    out = out.unionByName(issue(miss.join(F.broadcast(total), F.col("n") == F.col("rows")), "error", "all_null_column", F.col("column"), F.col("n")))
    if label:
        imb = class_imbalance(label_distribution(df, label)).where(F.col("imbalance_ratio") >= severe)
        out = out.unionByName(issue(imb, "warning", "severe_class_imbalance", F.lit(label), F.col("imbalance_ratio")))
    return out


# Recommendation codes and when they apply.
ACTIONS = {
    "infinite_values": "replace_infinite",
    "missing_values": "impute_missing",
    "duplicate_rows": "drop_duplicates",
    "class_imbalance": "mitigate_imbalance",
}


def recommend(df: DataFrame, label: str | None = None, flag: float = IMBALANCE_FLAG) -> DataFrame:
    """(kind, text) rows: actions, risks and notes that follow from the quality issues."""
    issues = check_quality(df, label, flag)
    code = F.when(F.col("code") == "severe_class_imbalance", "class_imbalance").otherwise(F.col("code"))
    named = issues.withColumn("code", code)
    pairs = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    actions = named.where(F.col("code").isin(*ACTIONS)).select(F.lit("action").alias("kind"), F.element_at(pairs, F.col("code")).alias("text")).distinct()
    risks = named.where("severity in ('error', 'warning')").select(F.lit("risk").alias("kind"), F.concat_ws(":", "severity", "code").alias("text")).distinct()
    out = actions.unionByName(risks)
    static = [("action", "encode_categorical")] if [c for c in df.columns if c not in numeric_columns(df)] else []
    static += [("action", "scale_numeric")] if numeric_columns(df) else []
    static += [("note", "stratify_split"), ("note", "fit_on_train_only"), ("note", "report_more_than_accuracy")]
    out = out.unionByName(df.sparkSession.createDataFrame(static, "kind string, text string"))
    if label:
        many = class_imbalance(label_distribution(df, label)).where("n_classes > 2")
        out = out.unionByName(many.select(F.lit("note").alias("kind"), F.lit("choose_multiclass_or_binary").alias("text")))
    return out


def audit_matrix(splits: Mapping[str, DataFrame], label: str, expected: Sequence[str] | None = None) -> DataFrame:
    """Issue rows: every split must carry the training columns, in order, numeric and complete."""
    names = list(splits)
    spark = splits[names[0]].sparkSession
    train = [c for c in splits[names[0]].columns if c != label]
    rows: list[tuple[str, str, str]] = []
    if expected is not None and list(expected) != train:
        rows.append((names[0], "differs_from_recorded", ",".join(sorted(set(expected) ^ set(train)))))
    for name, d in splits.items():
        cols = [c for c in d.columns if c != label]
        if len(set(cols)) != len(cols):
            rows.append((name, "duplicate_names", ",".join(sorted({c for c in cols if cols.count(c) > 1}))))
        elif cols != train:
            rows.append((name, "order" if sorted(cols) == sorted(train) else "columns", ",".join(sorted(set(cols) ^ set(train)))))
        text = [c for c in cols if c not in numeric_columns(d)]
        if text:
            rows.append((name, "not_numeric", ",".join(text)))
    fixed = spark.createDataFrame(rows, "split string, problem string, columns string")
    for name, d in splits.items():
        cols = [c for c in d.columns if c != label]
        if cols and len(set(cols)) == len(cols):
            m = missing_counts(d.select(*cols))
            fixed = fixed.unionByName(m.select(F.lit(name).alias("split"), F.lit("missing").alias("problem"), F.col("column").alias("columns")))
    return fixed
