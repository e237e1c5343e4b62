"""Rows combined to weighted instances before trees are fitted."""

import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from opsframe.operators import boosting, instances, learning


@pytest.fixture(scope="module")
def rows(spark):
    """A column of many values, one of few and one with NaN; two thirds of the labels follow from them."""
    u = (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 1000.0).alias("u")
    d = spark.range(6000).select("id", u, (F.col("id") % 5).cast("double").alias("v"), F.when(F.col("id") % 40 != 3, F.col("id") % 2).otherwise(float("nan")).cast("double").alias("w"))
    kind = F.when(F.col("u") < 30, "low").when(F.col("v") > 2, "high").otherwise("mid")
    return d.withColumn("y", F.when(F.col("id") % 3 == 0, "mid").otherwise(kind)).withColumn("_y", F.when(F.col("y") == "low", 0.0).when(F.col("y") == "mid", 1.0).otherwise(2.0))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(instances, "ROWS", 500)


def vectors(d, *cols):
    return VectorAssembler(inputCols=list(cols), outputCol="x", handleInvalid="keep").transform(d)


def test_every_row_counts_once_and_no_instance_is_heavy(rows, small):
    got = instances.combine(vectors(rows, "u", "v", "w"), "x", "_y", vectors(rows.where("id < 700"), "u", "v", "w"), bins=16)
    sums = lambda t: {r[0]: round(r[1], 6) for r in t.groupBy("_y").agg(F.sum("_w")).collect()}
    assert sums(got.fit) == {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    assert sums(got.valid) == {r[0]: r[1] for r in rows.where("id < 700").groupBy("_y").count().collect()}
    assert got.fit.count() < 3000 and got.fit.agg(F.max("_w")).first()[0] <= 6000 / 500
    known = [r["x"].toArray() for r in got.fit.collect()]
    assert len({x[0] for x in known}) <= 16 and {x[1] for x in known} == {0.0, 1.0, 2.0, 3.0, 4.0}
    assert {x[2] for x in known if not math.isnan(x[2])} == {0.0, 1.0} and any(math.isnan(x[2]) for x in known)


def test_small_tables_and_those_without_alike_rows_stay_as_they_are(rows, monkeypatch):
    x = vectors(rows, "u", "v")
    assert instances.combine(x, "x", "_y").fit.count() == 6000
    monkeypatch.setattr(instances, "ROWS", 500)
    monkeypatch.setattr(instances, "CELLS", 10)
    got = instances.combine(x, "x", "_y")
    assert got.fit.count() == 6000 and got.bins == 32 and got.fit.select("x").distinct().count() > 3000


def test_raw_rows_take_the_path_of_their_instances(rows, small):
    """The loss that the rounds saw on instances is that of the finished ensemble on raw rows."""
    x = vectors(rows, "u", "v")
    m = boosting.fit_boosted(x.where("id % 4 <> 0"), "_y", 3, rounds=3, depth=4, valid=x.where("id % 4 = 0"), features_col="x")
    p = F.get(F.col("p"), F.col("_y").cast("int"))
    scored = m.transform(x).withColumn("p", learning.vector_to_array("probability"))
    train, held = (scored.where(c).agg(F.avg(-F.log(p))).first()[0] for c in ("id % 4 <> 0", "id % 4 = 0"))
    assert m.rounds == 3 and train == pytest.approx(m.history[2][1], abs=1e-9) and held == pytest.approx(m.history[2][2], abs=1e-9)


def test_best_round_is_kept_when_its_gain_is_small(rows):
    x = vectors(rows, "u", "v")
    m = boosting.fit_boosted(x.where("id % 4 <> 0"), "_y", 3, rounds=6, depth=2, valid=x.where("id % 4 = 0"), features_col="x", patience=2, least_gain=0.5)
    assert len(m.history) == 3 and m.rounds == min(m.history, key=lambda h: h[2])[0] == 3


@pytest.mark.parametrize("kind", ["forest", "gbt"])
def test_forests_and_two_class_trees_are_fitted_to_instances(rows, small, kind, monkeypatch):
    sizes = []
    combine = learning.combine
    monkeypatch.setattr(learning, "combine", lambda *a, **k: sizes.append(combine(*a, **k)) or sizes[-1])
    two = rows.withColumn("y", F.when(F.col("u") < 30, "low").otherwise("other"))
    c = learning.train(two, "y", ["u", "v"], kind, valid=two.where("id < 900") if kind == "gbt" else None)
    assert sizes[0].fit.count() < 3000
    assert c.model.stages[-1].getOrDefault("weightCol") == "_w"
    got = c.predict(two)
    assert got.count() == 6000 and got.where("y = y_pred").count() > 5700
    by_rows = learning.train(two, "y", ["u"], kind, minInstancesPerNode=5)
    assert len(sizes) == 1 and by_rows.predict(two).count() == 6000
