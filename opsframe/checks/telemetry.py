"""Queries for series windows, telemetry conversion, checks and time splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import SERIES, Case, bind
from opsframe.operators import series as sr
from opsframe.operators import telemetry as tl

ORDER = ["ts", "event_id"]
SCHEMA = tl.TelemetrySchema(ts="ts", counters=["octets"], gauges=["cpu"], status=["status"], label=None, required=("ts", "device_id", "interface_id", "octets", "cpu"), bounds={"cpu": (5, 90)})
S = f"with s as ({SERIES})"
W = "(partition by device_id, interface_id order by ts, event_id)"

# one repeated reading per 50 events, as an explicit later copy
COPIES = f"select * from ({SERIES}) a union all select event_id + 1000000000, ts, device_id, interface_id, octets + 5, cpu, status from ({SERIES}) b where event_id % 50 = 0"
RAW = """
select cast(ts as string) as "Record Time", cast(user_id % 20 as string) as "Node", event_type as "if-name", cast(event_id * 3 as string) as "ifHCInOctets",
  case when event_id % 9 = 0 then 'n/a' else cast(event_id % 100 as string) end as "CPU Load",
  case event_id % 4 when 0 then 'UP' when 1 then 'down' when 2 then '1' else 'weird' end as "oper status",
  case when event_id % 5 = 0 then 'Port Scan' else 'normal' end as "class", 'x' as "vendor note", 'y' as "Host"
from events
"""


def series(s, d):
    return bind(s, d, SERIES)


def raw(s, d):
    return bind(s, d, RAW.replace('"', "`"))


def filled_sql(extra: str) -> str:
    return S + f""", f as (select event_id, ts, device_id, interface_id, octets, status,
      coalesce(last_value(cpu ignore nulls) over {W[:-1]} rows between unbounded preceding and current row),
               first_value(cpu ignore nulls) over {W[:-1]} rows between current row and unbounded following)) as cpu from s)
      , ff as (select * from f where cpu is not null) {extra}"""


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _split(s, d):
    return tl.split_by_time(series(s, d), "ts").select("event_id", "split")


SPLIT_SQL = S + """, q as (select quantile_cont(epoch_us(ts), 0.7) as a, quantile_cont(epoch_us(ts), 0.85) as b from s)
select event_id, case when epoch_us(ts) <= a then 'train' when epoch_us(ts) <= b then 'validation' else 'test' end as split from s, q"""


def _checks(s, d):
    df = bind(s, d, COPIES)
    return tl.check_telemetry(df, SCHEMA)


CHECK_SQL = f"""with s as ({COPIES}),
o as (select octets < lag(octets) over (partition by device_id, interface_id order by ts, octets) as drop_ from s)
select * from (select 'warning' as severity, 'missing_values' as check_name, 'cpu' as "column", count_if(cpu is null) as n from s
union all select 'warning', 'bounds', 'cpu', count_if(cpu < 5 or cpu > 90) from s
union all select 'warning', 'duplicates', 'ts', (select count(*) from s) - (select count(*) from (select distinct ts, device_id, interface_id from s))
union all select 'warning', 'counter_monotonicity', 'octets', count_if(drop_) from o) where n > 0"""


def _snapshots(s, d):
    snaps = bind(s, d, "select cast(o_custkey % 40 as string) as device, o_orderdate as label, o_orderkey, o_orderstatus as state from orders")
    p = sr.pair_snapshots(snaps.withColumn("label", F.col("label").cast("timestamp") + F.make_interval(secs=F.col("o_orderkey") % 86400)), "device", "label")
    return p.select("device", F.col("before.o_orderkey").alias("a"), F.col("after.o_orderkey").alias("b"), F.col("before.state").alias("sa"), F.col("after.state").alias("sb"))


def _features(s, d):
    df = series(s, d)
    return sr.series_features(df, ["octets"], (3,), ("mean", "std", "max"), (1, 2), ("status",), order=ORDER).select(
        "event_id", *[F.round(c, 4).alias(c) for c in ("octets_roll3_mean", "octets_roll3_std", "octets_roll3_max", "octets_lag1", "octets_lag2")], "status_changed")


ROLL = "over (partition by device_id, interface_id order by ts, event_id rows between 2 preceding and current row)"
CANON_SQL = RAW and f"""with r as ({RAW}) select strftime(try_cast("Record Time" as timestamp), '%Y-%m-%d %H:%M:%S') as "timestamp", "Node" as device_id, "if-name" as interface_id,
  try_cast("ifHCInOctets" as double) as "ifInOctets",
  case when "oper status" = 'UP' then 1.0 when "oper status" = 'down' then 2.0 else try_cast("oper status" as double) end as "ifOperStatus",
  try_cast("CPU Load" as double) as cpu_usage, case when "class" = 'normal' then 0 else 1 end as "label", "vendor note", "Host" from r"""

CASES = {
    "win_dedupe_readings": Case(lambda s, d: sr.dedupe_readings(bind(s, d, COPIES)).select("event_id", "octets"), f"with c as ({COPIES}) select event_id, octets from (select *, row_number() over (partition by ts, device_id, interface_id order by event_id) as r from c) where r = 1"),
    "win_fill_series": Case(lambda s, d: sr.fill_series(series(s, d), ["cpu"], order=ORDER).select("event_id", "cpu"), filled_sql("select event_id, cpu from ff")),
    "win_counter_rates": Case(
        lambda s, d: sr.counter_rates(series(s, d), ["octets"], order=ORDER).select("event_id", "octets_delta", F.round("octets_rate", 3).alias("octets_rate")),
        S + f""", l as (select event_id, octets - lag(octets) over {W} as dl, (epoch_us(ts) - lag(epoch_us(ts)) over {W}) / 1e6 as sec from s)
        select event_id, cast(greatest(coalesce(dl, 0), 0) as double) as octets_delta, round(case when sec > 0 then greatest(coalesce(dl, 0), 0) / sec else 0 end, 3) as octets_rate from l"""),
    "win_resample": Case(
        lambda s, d: sr.resample(series(s, d).drop("event_id"), "6 hours").select(_fmt("ts"), "device_id", "interface_id", F.round("octets", 3).alias("octets"), F.round("cpu", 3).alias("cpu"), F.round("status", 3).alias("status")),
        S + "select strftime(time_bucket(interval 6 hour, ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as ts, device_id, interface_id, round(avg(octets), 3) as octets, round(avg(cpu), 3) as cpu, round(avg(status), 3) as status from s group by all"),
    "win_rate_aliases": Case(lambda s, d: sr.rate_aliases(series(s, d).withColumnRenamed("octets", "ifInOctets_rate")).select("event_id", "traffic_in_rate"), S + "select event_id, octets as traffic_in_rate from s"),
    "win_rolling": Case(
        lambda s, d: sr.rolling(series(s, d), ["octets"], (3,), ("mean", "std", "max"), order=ORDER).select("event_id", *[F.round(f"octets_roll3_{x}", 4).alias(f"octets_roll3_{x}") for x in ("mean", "std", "max")]),
        S + f"select event_id, round(avg(octets) {ROLL}, 4) as octets_roll3_mean, round(coalesce(stddev_samp(octets) {ROLL}, 0), 4) as octets_roll3_std, cast(max(octets) {ROLL} as double) as octets_roll3_max from s"),
    "win_lags": Case(
        lambda s, d: sr.lags(series(s, d), ["octets"], (1, 5), order=ORDER).select("event_id", "octets_lag1", "octets_lag5"),
        S + f"select event_id, cast(coalesce(lag(octets, 1) over {W}, 0) as double) as octets_lag1, cast(coalesce(lag(octets, 5) over {W}, 0) as double) as octets_lag5 from s"),
    "win_status_changes": Case(
        lambda s, d: sr.status_changes(series(s, d), ["status"], order=ORDER).select("event_id", "status_changed"),
        S + f"select event_id, case when lag(status) over {W} is not null and lag(status) over {W} <> status then 1 else 0 end as status_changed from s"),
    "win_pair_snapshots": Case(_snapshots, """with o as (select cast(o_custkey % 40 as varchar) as device, o_orderdate + to_seconds(o_orderkey % 86400) as label, o_orderkey, o_orderstatus as state from orders),
      p as (select device, lag(o_orderkey) over w as a, o_orderkey as b, lag(state) over w as sa, state as sb from o window w as (partition by device order by label)) select * from p where a is not null"""),
    "win_series_features": Case(_features, S + f"""select event_id, round(avg(octets) {ROLL}, 4) as octets_roll3_mean, round(coalesce(stddev_samp(octets) {ROLL}, 0), 4) as octets_roll3_std, cast(max(octets) {ROLL} as double) as octets_roll3_max,
      cast(coalesce(lag(octets, 1) over {W}, 0) as double) as octets_lag1, cast(coalesce(lag(octets, 2) over {W}, 0) as double) as octets_lag2,
      case when lag(status) over {W} is not null and lag(status) over {W} <> status then 1 else 0 end as status_changed from s"""),
    "prj_map_columns": Case(
        lambda s, d: raw(s, d).select(*[F.col(f"`{r}`").cast("string").alias(c) for c, r in tl.map_columns(raw(s, d).columns, "snmp_mib_2016")[0].items() if c != "timestamp"]),
        f'with r as ({RAW}) select "Node" as device_id, "if-name" as interface_id, "ifHCInOctets" as "ifInOctets", "CPU Load" as cpu_usage, "oper status" as "ifOperStatus", "class" as "label" from r'),
    "prj_to_canonical": Case(lambda s, d: tl.to_canonical(raw(s, d), "snmp_mib_2016", keep_unknown=True).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), CANON_SQL),
    "prj_coerce_status": Case(lambda s, d: raw(s, d).groupBy(tl.coerce_status(F.col("`oper status`")).alias("code")).agg(F.count(F.lit(1)).alias("n")),
        f"""with r as ({RAW}) select case when "oper status" = 'UP' then 1.0 when "oper status" = 'down' then 2.0 else try_cast("oper status" as double) end as code, count(*) as n from r group by 1"""),
    "prj_map_label": Case(
        lambda s, d: raw(s, d).select(tl.map_label(raw(s, d), "class").alias("auto"), tl.map_label(raw(s, d), "class", {"normal": 0}).alias("mapped"), tl.map_label(raw(s, d), "ifHCInOctets").alias("num")),
        f"""with r as ({RAW}) select case when "class" = 'normal' then 0 else 1 end as auto, case when "class" = 'normal' then 0 end as mapped, cast("ifHCInOctets" as int) as num from r"""),
    "prj_parse_ts": Case(
        lambda s, d: bind(s, d, "select o_orderkey, case o_orderkey % 4 when 0 then 'bad' when 1 then '2024-02-30 00:00:00' when 2 then '2024-03-01 10:20:30' else '2024/03/01 10:20:30' end as t from orders").select(
            "o_orderkey", F.date_format(tl.parse_ts(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("t"), F.date_format(tl.parse_ts(F.col("t"), "yyyy/MM/dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").alias("strict")),
        "select o_orderkey, case when o_orderkey % 4 >= 2 then '2024-03-01 10:20:30' end as t, case when o_orderkey % 4 = 3 then '2024-03-01 10:20:30' end as strict from orders"),
    "prj_probe_columns": Case(
        lambda s, d: tl.probe_columns(raw(s, d), "snmp_mib_2016"),
        """select * from (values ('Record Time', 'timestamp', 'timestamp'), ('Node', 'device_id', 'metric'), ('if-name', 'interface_id', 'other'), ('ifHCInOctets', 'ifInOctets', 'metric'),
         ('CPU Load', 'cpu_usage', 'metric'), ('oper status', 'ifOperStatus', 'metric'), ('class', 'label', 'label'), ('vendor note', null, 'other'), ('Host', null, 'other')) t("column", canonical, role)"""),
    "cln_clip_bounds": Case(lambda s, d: tl.clip_bounds(series(s, d), {"cpu": (5.0, 90.0)}).select("event_id", "cpu"), S + "select event_id, case when cpu < 5 then 5 when cpu > 90 then 90 else cpu end as cpu from s"),
    "prf_check_telemetry": Case(_checks, CHECK_SQL),
    "prf_series_coverage": Case(
        lambda s, d: tl.series_coverage(series(s, d)).withColumn("rows_mean", F.round("rows_mean", 4)),
        S + """, p as (select device_id, interface_id, count(*) as n from s group by all) select count(distinct device_id) as n_devices, count(*) as n_interfaces, count(*) as n_series, min(n) as rows_min, max(n) as rows_max, round(avg(n), 4) as rows_mean from p"""),
    "spl_by_time": Case(_split, SPLIT_SQL),
}
