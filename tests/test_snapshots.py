"""Presence of keys is compared in one pass over both sides."""

from opsframe.operators import snapshots as sn


def test_presence_takes_one_shuffle(spark):
    before = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 3)], "d string, k int")
    after = spark.createDataFrame([("a", 1), ("c", 2), ("c", 2), ("b", None)], "d string, k int")
    out = sn.diff_presence(before, after, ["d", "k"], "vlan")
    assert {tuple(r) for r in out.collect()} == {(None, "3", "removed", "vlan", "low"), ("c", "2", "added", "vlan", "info")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # every side was grouped several times
