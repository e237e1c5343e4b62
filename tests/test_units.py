"""Small fixtures: skew, exact ranks and quantiles, log grammar, readers and encoders."""

import random

import pytest
from pyspark.sql import functions as F

from opsframe.functions import intervals as iv
from opsframe.functions import quantiles, ranking, scalars
from opsframe.operators import encoding, learning, logs, metrics, series, tables, vendor, windows
from opsframe.sources import readers, sinks

SAMPLE = """=~=~=~= PuTTY log 2026.07.13 =~=~=~=
SW1#sh logging
\x1b[0m\x1b[1;37mSep  8 2025 16:33:15 SW1 MPU0 %TELNET-LOGOUT_OK-5:Telnet(vty0) is closed by client (192.168.100.1) OK.\x1b[0m
---MORE---     \x1b[1;33mSep 14 2025 05:08:51 SW1 MPU0 %SNMP-USER_AUTH_FAILED-3:User op1 authentication failed.\x1b[0m
Jan  1 1970 00:00:15 switch %DCM-PROCESS_START-5:Process sysmgmtaddr is starting...
Jun 13 2026 18:42:00 SW3 M-0/MPU0 %SNMP-COMMUNITY_AUTHOR_FAILED-3:Community public authentication failed.
Jun 13 2026 18:42:00 SW3 M-0/MPU0 %SNMP-COMMUNITY_AUTHOR_FAILED-3:Community public authentication failed.
Jun 13 2026 19:10:01 SW3 M-0/MPU0 %POE-POWER_ABNORMAL-3:Short detected on interface gigabitethernet0/7.
""".splitlines()


def log_events(spark):
    rows = [("a.log", i, line) for i, line in enumerate(SAMPLE)]
    return logs.parse_events(spark.createDataFrame(rows, "source string, ord long, line string"))


def test_log_sample(spark):
    got = {r["code"]: r for r in log_events(spark).collect()}
    assert set(got) == {"TELNET-LOGOUT_OK", "SNMP-USER_AUTH_FAILED", "DCM-PROCESS_START", "SNMP-COMMUNITY_AUTHOR_FAILED", "POE-POWER_ABNORMAL"}
    assert got["SNMP-COMMUNITY_AUTHOR_FAILED"]["duplicate_count"] == 2
    assert got["SNMP-USER_AUTH_FAILED"]["color_hint"] == "yellow"
    assert got["DCM-PROCESS_START"]["clock_unreliable"] and got["DCM-PROCESS_START"]["module"] is None
    assert got["POE-POWER_ABNORMAL"]["entities"]["interface_id"] == "gigabitethernet0/7"
    assert got["POE-POWER_ABNORMAL"]["tags"] == ["poe_fault", "short_detected"]
    assert got["TELNET-LOGOUT_OK"]["timestamp"] == "2025-09-08T16:33:15+05:30"
    assert got["TELNET-LOGOUT_OK"]["timestamp_utc"] == "2025-09-08T11:03:15+00:00"


def test_unset_clock_is_left_out_of_windows(spark):
    w = windows.window_features(log_events(spark), 5)
    assert w.where("hostname = 'switch'").count() == 0
    assert w.where("scope = 'interface'").count() == 1


def test_hot_series_windows_cross_chunks(spark):
    rows = [("hot" if i % 3 else f"d{i % 7}", "if", i, float((i * 37) % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "device_id string, interface_id string, t long, v double").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    got = {(r["device_id"], r["t"]): (r["v_roll5_sum"], r["v_lag3"]) for r in series.drop_history(
        series.with_history(df, 5).withColumns({**series._rolling(["v"], [5], ["sum"], series.chunk_window()), **series._lags(["v"], [3], series.chunk_window())})).collect()}
    by = {}
    for d, _, t, v in rows:
        by.setdefault(d, []).append((t, v))
    for d, xs in by.items():
        for i, (t, _) in enumerate(xs):
            want = (sum(v for _, v in xs[max(0, i - 4):i + 1]), xs[i - 3][1] if i >= 3 else 0.0)
            assert got[(d, t)] == pytest.approx(want)


def test_narrowed_quantiles_match_sorting(spark):
    rng = random.Random(3)
    xs = [rng.choice([1.0, 5.0, rng.random() * 100]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    small = quantiles.exact_quantiles(df, ["x"], probs)["x"]
    narrowed = quantiles.exact_quantiles(df.withColumn("y", -F.col("x")), ["x", "y"], probs, bracket_rows=50)
    assert narrowed["x"] == pytest.approx(small)
    assert narrowed["y"] == pytest.approx([-q for q in quantiles.exact_quantiles(df, ["x"], [1 - p for p in probs])["x"]])
    ordered = sorted(xs)
    assert narrowed["x"][0] == ordered[0] and narrowed["x"][-1] == ordered[-1]


def test_global_rank_is_total(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("k"))
    got = ranking.global_rank(df, ["k"]).orderBy("k").select("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))


def test_range_expansion_and_vlan_order(spark):
    row = spark.range(1).select(scalars.expand_ranges(F.lit("10-12,1,x")).alias("r"), scalars.sort_vlans(F.array(F.lit("x"), F.lit("10"), F.lit("9"))).alias("v")).first()
    assert row["r"] == [1, 10, 11, 12] and row["v"] == ["9", "10", "x"]


def test_words_and_large_ids_survive_range_expansion(spark):
    cell = spark.range(1).select(
        scalars.expand_list(F.lit("5000,none,7-8, ALL ,9-1,1-3")).alias("l"), scalars.expand_ranges(F.lit("5000,none,7")).alias("r"),
        F.size(scalars.expand_list(F.lit("1,5-2000000,7"))).alias("n"), F.size(scalars.expand_ranges(F.lit("1,5-2000000,7"))).alias("m"),
        scalars.sort_vlans(F.array(F.lit("1234567890123456"), F.lit("x"), F.lit("9"))).alias("v")).first()
    assert cell["l"] == ["5000", "none", "7", "8", "ALL", "1", "2", "3"] and cell["r"] == [7, 5000] and cell["v"] == ["9", "1234567890123456", "x"]
    assert cell["n"] == 1999998 and cell["m"] == 1999997


def test_intervals_are_sets(spark):
    rng = random.Random(11)
    texts = [",".join(f"{a}-{a + rng.randint(-1, 6)}" if rng.random() < 0.6 else str(a) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    df = spark.createDataFrame([(x, y) for x, y in zip(texts[::2], texts[1::2])], "x string, y string")
    a, b = iv.parse(F.col("x")), iv.parse(F.col("y"))
    rows = df.select("x", "y", iv.ids(a).alias("a"), iv.ids(b).alias("b"), *[iv.ids(f(a, b)).alias(n) for n, f in (("u", iv.union), ("d", iv.difference), ("i", iv.intersection))], iv.count(a).alias("n"), iv.text(a).alias("t"), iv.contains(a, F.lit(7)).alias("has")).collect()

    def plain(t):
        out = set()
        for part in filter(None, t.split(",")):
            lo, _, hi = part.partition("-")
            out |= set(range(int(lo), int(hi or lo) + 1))
        return out

    for r in rows:
        x, y = plain(r["x"]), plain(r["y"])
        assert (r["a"], r["b"], r["u"], r["d"], r["i"]) == tuple(sorted(s) for s in (x, y, x | y, x - y, x & y))
        assert r["n"] == len(x) and plain(r["t"]) == x and r["has"] == (7 in x)
    wide = spark.range(1).select(iv.text(iv.difference(iv.parse(F.lit("1,5-2000000,7, x ,9-8")), iv.parse(F.lit("10-20,1999999")))).alias("t")).first()["t"]
    assert wide == "1,5-9,21-1999998,2000000"


def test_interval_sets_grow_without_copies(spark):
    raw = spark.createDataFrame([([(5, 9), (1, 2), (8, 20), (3, 3), (30, 29), (40, 40)],), ([],)], f"r {iv.TYPE}").select(iv.normalize(F.col("r")).alias("n"))
    assert [[tuple(x) for x in r["n"]] for r in raw.collect()] == [[(1, 3), (5, 20), (40, 40)], []]
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" not in plan and "aggregate(" not in plan  # a set of k parts was copied k times


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 2), ("a", 1, 5), (None, 2, 3)], "g string, o int, v int")
    got = ranking.running_totals(df, ["o"], {"before": "v"}, ["g"]).orderBy("g", "o").collect()
    assert [(r["g"], r["before"]) for r in got] == [(None, 0), (None, 2), ("a", 0)]


def test_readers_check_their_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("b,a,label\n1,2,x\n")
    row = readers.read_split_csv(spark, {"train": str(tmp_path / "s.csv")}, "a int, b int, label string", label="label").first()
    assert (row["a"], row["b"]) == (2, 1)
    with pytest.raises(ValueError):
        readers.read_split_csv(spark, {"train": str(tmp_path / "s.csv")}, "a int, z int")
    (tmp_path / "n.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        readers.read_split_csv(spark, {"train": str(tmp_path / "n.csv")}, "a int, label string", label="label")
    (tmp_path / "h.csv").write_text('1,"tcp, ""q""",normal\n2,udp,x\n')
    d = readers.read_headerless_csv(spark, {"train": str(tmp_path / "h.csv")}, "d int, p string, label string")
    assert d.count() == 2 and d.where("d = 1").first()["p"] == 'tcp, "q"'
    for text in ("1,tcp\n", "1,tcp,a,b\n"):
        (tmp_path / "h.csv").write_text("2,udp,x\n" + text)
        d = readers.read_headerless_csv(spark, {"train": str(tmp_path / "h.csv")}, "d int, p string, label string")
        for action in (d.count, d.groupBy("d").count().collect):
            with pytest.raises(Exception):
                action()


def test_captures_with_odd_names(spark, tmp_path):
    folder = tmp_path / "caps" / "snap 1" / "dev a+b"
    folder.mkdir(parents=True)
    (folder / "mac table.txt").write_text("one\r\ntwo\n")
    captures, missing = readers.read_captures(spark, str(tmp_path / "caps"), ["mac table", "trunk"])
    rows = captures.where("line <> ''").orderBy("line_no").collect()
    assert [(r["snapshot_id"], r["device"], r["command"], r["line"]) for r in rows] == [("snap 1", "dev a+b", "mac table", "one"), ("snap 1", "dev a+b", "mac table", "two")]
    assert [r["command"] for r in missing.collect()] == ["trunk"]


def test_leak_audit_sees_quotes_and_nested_values(spark):
    df = spark.createDataFrame([('say a"b\\c', ["x", "tab\there"], {"k": "v"})], "t string, l array<string>, m map<string,string>")
    got = {r["needle"]: r["leaked"] for r in vendor.leak_audit(df, ['a"b\\c', "tab\there", "v", "k", "absent"]).collect()}
    assert got == {'a"b\\c': True, "tab\there": True, "v": True, "k": True, "absent": False}


def test_fingerprint_tells_cells_apart(spark):
    one, two = (readers.fingerprint(spark.createDataFrame([r], "a string, b string")).first()["digest"] for r in (("a|b", "c"), ("a", "b|c")))
    assert one != two


def test_zone_with_daylight_saving(spark):
    df = spark.createDataFrame([("2025-07-01 12:00:00",), ("2025-01-01 12:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    got = [r[0] for r in df.select(logs.iso_text(F.col("t"), "America/New_York")).collect()]
    assert got == ["2025-07-01T12:00:00-04:00", "2025-01-01T12:00:00-05:00"]


def test_columns_without_text_or_order(spark):
    df = spark.sql("select cast(null as date) as d, map('a', 1) as m, cast(null as string) as s union all select date'2024-01-01', map('a', 1), 'x'")
    out = tables.impute_categorical(df.drop("m"), "constant").collect()
    assert {r["s"] for r in out} == {"x", "__missing__"} and None in {r["d"] for r in out}
    assert tables.constant_columns(df) == ["m"]


def test_dirty_table(spark):
    df = spark.createDataFrame([(1.0, "a", 7), (1.0, "a", 7), (float("inf"), None, 7), (None, "b", 7), (3.0, "b", 7)], "num double, cat string, const int")
    out, report = tables.clean(df)
    steps = {r["step"]: r["n"] for r in report.collect()}
    assert steps["duplicate_rows"] == 1 and steps["inf_cells"] == 1 and steps["constant_columns"] == 1 and steps["missing_after"] == 0
    assert "const" not in out.columns


def test_scaler_edge_cases(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "k double, x double")
    out = encoding.fit_scaler(df, ["k", "x"], "minmax").transform(df).orderBy("x").collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0), (0.0, 1.0)]


def test_isolation_forest_ranks_outliers(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 60 == 0, 50.0).otherwise(F.rand(1)).alias("x"), (F.col("id") % 60 == 0).alias("bad"))
    f = learning.fit_isolation_forest(df, ["x"], "id", trees=20, sample=128)
    auc = metrics.roc_auc(f.score(df), "bad", "score").first()["auc"]
    assert auc > 0.95


def test_sources_roundtrip(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    lines = readers.read_log_lines(spark, [str(tmp_path / "a.log")]).where("line <> ''").orderBy("ord").collect()
    assert [r["line"] for r in lines] == ["one", "two"] and lines[0]["ord"] < lines[1]["ord"]
    assert logs.parse_events(readers.read_log_lines(spark, [str(tmp_path / "a.log")])).count() == 0
    (tmp_path / "t.csv").write_text(" dur ,label\n1,x\n")
    cap = readers.read_capture_csvs(spark, [str(tmp_path / "t.csv")])
    assert cap.columns == ["dur", "label", "source_file"] and cap.first()["source_file"] == "t.csv"
    (tmp_path / "h.csv").write_text("1,tcp,normal\n2,udp\n")
    with pytest.raises(Exception):
        readers.read_headerless_csv(spark, {"train": str(tmp_path / "h.csv")}, "d int, p string, label string").collect()
    sinks.write_table(spark.range(3), str(tmp_path / "out"))
    assert readers.read_table(spark, str(tmp_path / "out")).count() == 3
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nnot json\n')
    from pyspark.sql import types as T

    good, bad = readers.read_events_jsonl(spark, str(tmp_path / "e.jsonl"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert good.count() == 1 and bad.first()["line"] == "not json"


def test_fill_looks_at_no_row_twice(spark):
    """A frame that ends with its partition is read anew for every row: the square of a day's, or a series', rows."""
    day, rows, want = 86400, [], {}
    values = {0: None, 1: 4.0, 2: None, day: None, day + 1: None, 3 * day: None, 3 * day + 1: 7.0, 5 * day: None}
    filled = [4.0, 4.0, 4.0, 4.0, 4.0, 4.0, 7.0, 7.0]
    for (at, v), f in zip(values.items(), filled):
        rows.append(("a", at, v))
        want["a", at] = f
    rows += [("b", 0, None), ("b", 2 * day, None), ("b", 4 * day, None), ("b", 4 * day + 5, 9.0), ("b", 9 * day, None), ("c", 0, None), ("c", day, None)]
    want |= {("b", at): 9.0 for at in (0, 2 * day, 4 * day, 4 * day + 5, 9 * day)}
    df = spark.createDataFrame(rows, "device_id string, at long, v double").withColumns({"ts": F.timestamp_seconds("at"), "interface_id": F.lit("x")})
    out = series.fill_series(df, ["v"])
    assert {(r.device_id, r["at"]): r.v for r in out.collect()} == want
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_first_reading_is_one_row_without_a_sort(spark):
    rows = [(1, "a", 3, 30, None), (1, "a", 2, 20, 2.0), (1, "a", None, 5, 5.0), (2, "a", 4, None, 4.0), (2, "a", 4, None, 4.0), (3, "b", None, 1, 1.0), (1, None, 7, 70, None)]
    df = spark.createDataFrame(rows, "t int, d string, id long, n int, v double")
    out = series.dedupe_readings(df, ["t", "d"], "id")
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "a", 2, 20, 2.0), (2, "a", 4, None, 4.0), (3, "b", None, None, None), (1, None, 7, 70, None)], key=str)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
