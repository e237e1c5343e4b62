"""Boosted classes, experiments, encoders and saved scoring bundles."""

import pytest
from pyspark.sql import functions as F

from opsframe.operators import boosting, bundles, encoding, learning


@pytest.fixture(scope="module")
def flows(spark):
    """Three classes that two columns decide, a text column and noise that only memory can fit."""
    d = spark.range(900).select(
        "id", (F.col("id") % 30).cast("double").alias("a"), (F.xxhash64("id") % 17).cast("double").alias("b"), F.concat(F.lit("p"), F.col("id") % 4).alias("proto"))
    kind = F.when(F.col("a") < 10, "dos").when(F.col("proto") == "p1", "scan").otherwise("normal")
    return d.withColumn("label", F.when(F.abs(F.xxhash64("id", F.lit(1))) % 10 == 0, "scan").otherwise(kind))


def test_boosted_classes_share_their_margins_and_stop_early(spark, flows):
    fit, held = flows.where("id % 3 <> 0"), flows.where("id % 3 = 0")
    model = learning.train(fit, "label", ["a", "b"], "gbt", valid=held, maxIter=12, maxDepth=5, stepSize=0.8, patience=2)
    boosted = model.model.boosted
    assert boosted.rounds < 12 and len(boosted.history) < 12 and boosted.rounds == min(boosted.history, key=lambda h: h[2])[0]
    out = model.predict(held)
    assert "features_vec" not in out.columns and model.classes == ("dos", "normal", "scan")
    rows = out.select("y_pred", "probabilities", "score").collect()
    assert len(rows) == held.count()
    for r in rows:
        assert abs(sum(r["probabilities"]) - 1) < 1e-9 and r["y_pred"] == model.classes[r["probabilities"].index(r["score"])]
    good = out.where("y_pred = label").count() / len(rows)
    assert good > 0.6


def test_boosted_margins_are_those_of_the_rounds(spark, flows):
    """The ensembles' margins equal start plus rate times every round's trees."""
    fit = learning.VectorAssembler(inputCols=["a"], outputCol="features_vec").transform(flows.withColumn("_y", F.when(F.col("a") < 10, 0.0).when(F.col("a") < 20, 1.0).otherwise(2.0)))
    m = boosting.fit_boosted(fit, "_y", 3, rounds=2, depth=2, rate=0.5)
    row = m.transform(fit.where("a = 3")).first()
    margins = [s + 0.5 * sum(t.predict(row["features_vec"]) for t in e.trees) for s, e in zip(m.start, m.ensembles)]
    top = max(margins)
    raised = [2.718281828459045 ** (x - top) for x in margins]
    assert [round(p, 9) for p in row["probability"]] == [round(x / sum(raised), 9) for x in raised] and row["prediction"] == 0.0
    assert m.history[1][1] < m.history[0][1]
    with pytest.raises(ValueError):
        boosting.fit_boosted(fit.limit(0), "_y", 3)


@pytest.mark.parametrize("kind", ["forest", "gbt"])
def test_saved_bundle_scores_raw_rows_like_the_fitted_one(spark, flows, tmp_path, kind):
    fit = flows.where("id % 3 <> 0")
    b = bundles.fit_bundle(fit, "label", ["a", "b"], ["proto"], kind=kind, **({"maxIter": 2} if kind == "gbt" else {"numTrees": 3}), facts={"dataset": "flows"})
    first = bundles.save_bundle(b, f"{tmp_path}/m")
    again = bundles.load_bundle(spark.newSession(), f"{tmp_path}/m", first)
    raw = flows.where("id % 3 = 0").select("id", "a", "b", "proto", F.lit("kept").alias("note"))
    one, two = (x.score(raw).select("id", "note", "y_pred", "class_probabilities").orderBy("id").collect() for x in (b, again))
    assert [tuple(r) for r in one] == [tuple(r) for r in two] and len(one) == 300
    assert set(one[0]["class_probabilities"]) == {"dos", "normal", "scan"} and again.facts == {"kind": kind, "dataset": "flows"} and again.version == first


def test_newest_complete_version_is_served(spark, flows, tmp_path):
    root = f"{tmp_path}/m"
    b = bundles.fit_bundle(flows, "label", ["a"], encoder="ordinal", categorical=["proto"], numTrees=2)
    versions = [bundles.save_bundle(b, root) for _ in range(2)]
    spark.range(1).write.parquet(f"{root}/v-99999999T000000-half/facts")  # a writer that has not come to its end
    assert bundles.load_bundle(spark, root).version == versions[1] and bundles.bundle_versions(spark, root).count() == 2
    with pytest.raises(ValueError):
        bundles.load_bundle(spark, root, "99999999T000000-half")


def test_contract_and_incomplete_rows(spark, flows):
    b = bundles.fit_bundle(flows, "label", ["a", "b"], ["proto"], numTrees=2)
    assert b.required == ["proto", "a", "b"]
    with pytest.raises(ValueError, match="missing required columns: b"):
        b.score(flows.drop("b"))
    assert {r["column"]: r["state"] for r in b.contract(flows.drop("b", "label")).collect()} == {"proto": "required", "a": "required", "b": "missing", "id": "ignored"}
    raw = spark.createDataFrame([(1, "3.5", 2.0, "p1"), (2, "x", 1.0, "p1"), (3, "4", float("nan"), "new"), (4, "5", 1.0, None)], "id int, a string, b double, proto string")
    with pytest.raises(ValueError, match="missing values"):
        b.score(raw)
    got = {r["id"]: r for r in b.score(raw, "flag").collect()}
    assert {i: r["complete"] for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert got[2]["y_pred"] is None and got[2]["class_probabilities"] is None and got[1]["y_pred"] in b.model.classes
    assert {r["feature"]: r["missing"] for r in b.audit(raw).where("missing > 0").collect()} == {"a": 1, "b": 1}
    assert b.score(raw.limit(0)).count() == 0


def test_experiment_reports_every_split_over_all_classes(spark, flows):
    parts = {"train": flows.where("id % 3 <> 0").select("a", "b", "label"), "test": flows.where("id % 3 = 0 and label <> 'dos'").select("a", "b", "label")}
    e = learning.run_experiment(parts, "label", ["a", "b"], "forest", numTrees=3)
    rows = {r["split"]: r for r in e.metrics.collect()}
    assert set(rows) == {"train", "test"} and rows["test"]["n_classes"] == 3
    assert all(0 <= rows[s][c] <= 1 for s in rows for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "false_positive_rate"))
    assert all(rows[s]["predict_seconds"] > 0 for s in rows) and e.audit.count() == 0
    cells = e.confusion.where("split = 'test'").collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == parts["test"].count()
    with pytest.raises(ValueError, match="training rows"):
        learning.run_experiment(parts, "label", ["a"], "forest", min_rows=10_000)
    with pytest.raises(ValueError, match="missing"):
        learning.run_experiment({"train": parts["train"].withColumn("a", F.when(F.col("a") > 3, F.col("a")))}, "label", ["a"], "forest")


def test_onehot_of_a_hundred_thousand_values(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), (F.col("id") % 3).cast("string").alias("w"))
    enc = encoding.fit_onehot(df, ["v", "w"])
    raw = df.unionByName(spark.createDataFrame([(-1, "never seen", "0"), (-2, None, None)], "id long, v string, w string"))
    got = enc.vectors(raw)
    assert got.columns == ["id", "onehot"]
    places = got.where("id < 0 or id in (0, 7)").orderBy("id").collect()
    assert [(r["id"], r["onehot"].size, len(r["onehot"].indices)) for r in places] == [(-2, 100_003, 0), (-1, 100_003, 1), (0, 100_003, 2), (7, 100_003, 2)]
    order = sorted(f"v{i}" for i in range(100_000))
    assert places[3]["onehot"].indices.tolist() == [order.index("v7"), 100_000 + 1]
    assert got.count() == 100_002


def test_lookup_beyond_broadcast_size_keeps_hot_and_rare_values(spark, monkeypatch):
    monkeypatch.setattr(encoding, "SMALL_BYTES", 0)
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("r"), F.col("id") % 900)).alias("v"))
    enc = encoding.fit_ordinal(df, ["v"])
    order = {v: i for i, v in enumerate(sorted({r["v"] for r in df.select("v").distinct().collect() if r["v"]}))}
    want = {r["id"]: order.get(r["v"], -1) for r in df.collect()}
    out = enc.transform(df.unionByName(spark.createDataFrame([(-5, "unknown")], "id long, v string")))
    assert out.columns == ["id", "v"] and {r["id"]: r["v"] for r in out.collect()} == want | {-5: -1}
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
