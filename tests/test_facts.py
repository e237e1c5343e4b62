"""Counts and digests that come along with a job: file digests, rows lost by filling."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opsframe.operators import selection
from opsframe.operators import telemetry as tl
from opsframe.plans import flows
from opsframe.sources import readers


def test_file_digests_equal_hashlib_in_any_order(spark, tmp_path, monkeypatch):
    content = {"a.bin": bytes(range(256)) * 50, "b.txt": b"line\r\nother\n", "empty": b"", "sub/c+d e.csv": "é,1\n".encode()}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in readers.file_fingerprint(spark, str(tmp_path)).collect()}
    want = {n.rsplit("/", 1)[-1]: hashlib.sha256(d).hexdigest() for n, d in content.items() if d}
    assert {n.replace("%20", " ").replace("%2B", "+"): r["digest"] for n, r in rows.items() if n != "__all__"} == want
    total = hashlib.sha256("".join(sorted(want.values())).encode()).hexdigest()
    assert rows["__all__"]["digest"] == total and rows["__all__"]["bytes"] == sum(map(len, content.values()))
    one, two = str(tmp_path / "a.bin"), str(tmp_path / "b.txt")
    first, second = (readers.file_fingerprint(spark, p).where("path = '__all__'").first()["digest"] for p in ([one, two], [two, one]))
    assert first == second != total
    monkeypatch.setattr(readers, "WHOLE_FILE", 1000)
    large = {r["path"].rsplit("/", 1)[-1]: r["kind"] for r in readers.file_fingerprint(spark, str(tmp_path)).collect()}
    assert large["a.bin"] == "lines" and large["b.txt"] == "sha256"


def test_unfilled_rows_are_counted_where_they_are_dropped(spark):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "sw1" if i % 2 else "sw2", float(i) if i % 2 and i % 3 else None, 100 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id int, ts string, device_id string, cpu double, octets int").withColumn("interface_id", F.lit("1"))
    schema = tl.TelemetrySchema(ts="ts", counters=["octets"], gauges=["cpu"], status=[], label=None, bounds={})
    out, manifest = flows.preprocess_telemetry(df, schema, "event_id")
    got = {r["metric"]: r["value"] for r in manifest.collect()}
    assert got["raw_rows"] == "40" and got["unfilled_rows"] == "20" and got["rows"] == "20"  # sw2 never has a value
    assert out.count() == 20


def test_correlations_of_many_columns_in_one_scan(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(600, 40)) * rng.uniform(0.1, 1000, 40) + rng.uniform(-1e6, 1e6, 40)
    data[:, 5] = 2 * data[:, 4] - 7
    data[:, 6] = 3.0
    data[rng.random(data.shape) < 0.1] = np.nan
    data[:, 7] = np.nan
    cols = [f"f{i}" for i in range(40)]
    pdf = pd.DataFrame(data, columns=cols)
    df = spark.createDataFrame(pdf).repartition(7)
    plan = selection.correlations(df, cols)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = {(r["a"], r["b"]): r["r"] for r in selection.correlations(df, cols).collect()}
    want = pdf.corr()
    assert len(got) == 40 * 39 // 2
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert (r is None) if np.isnan(w) or "f6" in (a, b) else abs(r - w) < 1e-8
    spearman = {(r["a"], r["b"]): r["r"] for r in selection.correlations(selection.ranked(df.select(*cols[:5]), cols[:5]), cols[:5]).collect()}
    assert all(abs(r - pdf[cols[:5]].rank().corr().loc[a, b]) < 1e-9 for (a, b), r in spearman.items()) and len(spearman) == 10
    assert selection.correlations(df.limit(0), cols[:3]).count() == 0
