"""Queries for projection, cleaning, profiling, splits and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import Case, bind
from opsframe.checks.logs import _features, windows_cte
from opsframe.operators import encoding as enc
from opsframe.operators import profiling as prf
from opsframe.operators import splits as spl
from opsframe.operators import tables as tb

TABLE = """
select o_orderkey as id, case when o_orderkey % 13 = 0 then null else o_totalprice end as price,
  case when o_orderkey % 97 = 0 then cast('Infinity' as double) when o_orderkey % 89 = 0 then cast('-Infinity' as double) else o_totalprice / 3 end as rate,
  o_custkey % 50 as cust, case when o_orderkey % 17 = 0 then null else o_orderpriority end as prio, o_orderstatus as label, 7 as konst, cast(null as string) as gone
from orders
"""
DUP = "select case when o_orderkey % 5 = 0 then null else o_custkey % 40 end as a, o_orderstatus as b, case when o_orderkey % 5 = 0 then null else o_orderpriority end as c from orders"
T = f"with t as ({TABLE})"
D = f"with t as ({DUP})"


def t(s, d):
    return bind(s, d, TABLE)


def dup(s, d):
    return bind(s, d, DUP)


def finite(s, d):
    return t(s, d).select("id", "cust", F.col("rate"), "price")


def scaled(kind):
    def run(s, d):
        df = t(s, d).select("id", "price", "cust", "konst")
        return enc.fit_scaler(df, ["price", "cust", "konst"], kind).transform(df).select("id", *[F.round(c, 6).alias(c) for c in ("price", "cust", "konst")])

    parts = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"), "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}[kind]
    stats = ", ".join(f"{parts[0].format(c=c)} as a_{c}, {parts[1].format(c=c)} as b_{c}" for c in ("price", "cust", "konst"))
    outs = ", ".join(f"round((t.{c} - a_{c}) / case when b_{c} = 0 then 1 else b_{c} end, 6) as {c}" for c in ("price", "cust", "konst"))
    return Case(run, T + f", s as (select {stats} from t) select id, {outs} from t, s")


def _impute(strategy, sql):
    return Case(lambda s, d: tb.impute_numeric(finite(s, d).drop("rate"), strategy).select("id", F.round("price", 4).alias("price")), sql)


def _flow(s, d):
    cfg = tb.CleanConfig(drop=["id"], clip_factor=1.5)
    return tb.clean(t(s, d), cfg)[1]


FLOW_SQL = T + """, a as (select price, case when abs(rate) = 'Infinity'::double then null else rate end as rate, cust, prio, label, konst, gone from t),
dd as (select distinct * from a), nn as (select * from dd where not (price is null and rate is null and cust is null and prio is null and label is null)),
im as (select coalesce(price, (select quantile_cont(price, 0.5) from nn)) as price, coalesce(rate, (select quantile_cont(rate, 0.5) from nn)) as rate, cust from nn),
b as (select quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) as pl, quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) as ph,
  quantile_cont(rate, 0.25) - 1.5 * (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)) as rl, quantile_cont(rate, 0.75) + 1.5 * (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)) as rh,
  quantile_cont(cust, 0.25) - 1.5 * (quantile_cont(cust, 0.75) - quantile_cont(cust, 0.25)) as cl, quantile_cont(cust, 0.75) + 1.5 * (quantile_cont(cust, 0.75) - quantile_cont(cust, 0.25)) as ch from im)
select 'rows_before' as step, (select count(*) from t) as n union all select 'columns_before', 8
union all select 'missing_before', (select count_if(price is null) + count_if(prio is null) + count(*) from t)
union all select 'columns_dropped', 1 union all select 'inf_cells', (select count_if(abs(rate) = 'Infinity'::double) from t)
union all select 'duplicate_rows', (select count(*) from t) - (select count(*) from dd) union all select 'constant_columns', 2
union all select 'all_null_rows', (select count(*) from dd) - (select count(*) from nn)
union all select 'clipped_cells', (select count_if(price < pl or price > ph) + count_if(rate < rl or rate > rh) + count_if(cust < cl or cust > ch) from im, b)
union all select 'narrowed_columns', 1 union all select 'rows_after', (select count(*) from nn) union all select 'columns_after', 5 union all select 'missing_after', 0"""


def _narrow(s, d):
    df = bind(s, d, "select o_orderkey % 100 as tiny, o_orderkey % 20000 as small, o_orderkey as k, cast(o_orderkey % 8 as double) / 4 as exact, o_totalprice as price from orders")
    out, changed = tb.narrow_types(df)
    types = {**dict(df.dtypes), **dict(out.dtypes)}
    cols = [F.lit(types[c]).alias(f"type_{c}") for c in df.columns]
    return out.agg(F.sum("tiny").alias("tiny"), F.sum(F.col("exact").cast("double")).alias("exact")).select("*", *cols)


def _split_sizes(s, d):
    df = spl.split_random(t(s, d).select("id", "label"), "id", label="label")
    return spl.split_report(df, "label")


SIZES_SQL = T + """, c as (select label, count(*) as n from t group by label), z as (select label, n, round(n * 0.7) as a, least(round(n * 0.15), n - round(n * 0.7)) as b from c)
select * from (select 'train' as split, label, cast(a as bigint) as n from z union all select 'validation', label, cast(b as bigint) from z union all select 'test', label, cast(n - a - b as bigint) from z) where n > 0"""


def _random(s, d):
    df = spl.split_random(t(s, d).select("id"), "id")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def _position(s, d, holdout=None):
    w = _features(s, d).select("window_start_iso", "hostname", "scope", "interface_id")
    return spl.split_by_position(w, ["window_start_iso", "hostname", "scope", "interface_id"], holdout=holdout)


POS = windows_cte(5) + """, o as (select window_start_iso, hostname, scope, interface_id, row_number() over (order by window_start_iso, hostname, scope, interface_id) as r, count(*) over () as n from wl where hostname <> '@h'),
p as (select window_start_iso, hostname, scope, interface_id, case when r <= floor(n * @a) then 'train' when @b then 'validation' else 'test' end as split from o
 union all select window_start_iso, hostname, scope, interface_id, 'test' from wl where hostname = '@h')"""
POS_SQL = POS.replace("@h", "-").replace("@a", "0.7::double").replace("@b", "r <= floor(n * 0.7::double) + floor(n * 0.15::double)")
HOLD_SQL = POS.replace("@h", "sw1").replace("@a", "0.7::double").replace("@b", "true")

CASES = {
    "prj_drop_present": Case(lambda s, d: tb.drop_present(t(s, d), ["konst", "gone", "rate", "absent"])[0], T + " select id, price, cust, prio, label from t"),
    "prj_feature_columns": Case(lambda s, d: t(s, d).withColumn("Split", F.lit(1)).select(*tb.feature_columns(t(s, d).withColumn("Split", F.lit(1)), "label")[0]), T + " select id, price, rate, cust, konst from t"),
    "prj_infer_kinds": Case(lambda s, d: t(s, d).select(F.explode(F.create_map(*[F.lit(x) for kv in tb.infer_kinds(t(s, d), tb.Roles("label", ["cust"], ["id"])).items() for x in kv])).alias("column", "kind")).groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n")),
        T + " select k.*, (select count(*) from t) as n from (values ('id','identifier'),('price','numerical'),('rate','numerical'),('cust','categorical'),('prio','categorical'),('label','target'),('konst','numerical'),('gone','categorical')) k(\"column\", kind)"),
    "prj_require_columns": Case(lambda s, d: tb.require_columns(t(s, d), ["label", "id"])[0], T + " select label, id from t"),
    "prj_search_events": Case(
        lambda s, d: tb.search_events(bind(s, d, "select event_id, event_type as category, props as device, ts as timestamp from events"), {"category": "CLI"}, "7", 50, newest=("timestamp", "event_id")).select("event_id", "category"),
        "select event_id, event_type as category from events where event_type like '%cli%' and props like '%7%' order by ts desc, event_id desc limit 50"),
    "prj_search_text": Case(
        lambda s, d: tb.search_events(bind(s, d, "select conv_id, turn, role, text from conversations"), {"text": "the", "role": "USER"}, limit=200, newest=("conv_id", "turn")).select("conv_id", "turn"),
        "select conv_id, turn from conversations where contains(lower(text), 'the') and contains(lower(role), 'user') order by conv_id desc, turn desc limit 200"),
    "prj_narrow_types": Case(_narrow, """select sum(o_orderkey % 100) as tiny, sum(cast(o_orderkey % 8 as double) / 4) as exact, 'tinyint' as type_tiny, 'smallint' as type_small,
        case when max(o_orderkey) < 32768 then 'smallint' else 'int' end as type_k, 'float' as type_exact, 'double' as type_price from orders"""),
    "cln_replace_inf": Case(lambda s, d: tb.replace_inf(t(s, d)).select("id", "rate"), T + " select id, case when abs(rate) <> 'Infinity'::double then rate end as rate from t"),
    "cln_drop_duplicates": Case(lambda s, d: tb.drop_duplicates(dup(s, d)), D + " select distinct * from t"),
    "cln_drop_duplicates_none": Case(lambda s, d: tb.drop_duplicates(bind(s, d, "select doc_id % 150 as g, lang, source, n_chars % 7 as k from documents"), "none"),
        "select g, lang, source, k from (select doc_id % 150 as g, lang, source, n_chars % 7 as k from documents) group by all having count(*) = 1"),
    "cln_drop_constant": Case(lambda s, d: tb.drop_constant(t(s, d))[0].select("*").groupBy().agg(*[F.count(F.lit(1)).alias(c) for c in tb.drop_constant(t(s, d))[0].columns]),
        "select count(*) as id, count(*) as price, count(*) as rate, count(*) as cust, count(*) as prio, count(*) as label from orders"),
    "cln_drop_all_null": Case(lambda s, d: tb.drop_all_null(dup(s, d).select("a", "c")), D + " select a, c from t where a is not null or c is not null"),
    "cln_impute_median": _impute("median", T + " select id, round(coalesce(price, (select quantile_cont(price, 0.5) from t)), 4) as price from t"),
    "cln_impute_mean": _impute("mean", T + " select id, round(coalesce(price, (select avg(price) from t)), 4) as price from t"),
    "cln_impute_zero": _impute("zero", T + " select id, round(coalesce(price, 0), 4) as price from t"),
    "cln_impute_drop": _impute("drop", T + " select id, round(price, 4) as price from t where price is not null"),
    "cln_impute_categorical": Case(lambda s, d: tb.impute_categorical(t(s, d).select("id", "prio", "gone")),
        T + " select id, coalesce(prio, (select prio from t where prio is not null group by prio order by count(*) desc, prio limit 1)) as prio, '__missing__' as gone from t"),
    "cln_clip_iqr": Case(lambda s, d: tb.clip_iqr(t(s, d).select("id", "rate"), 0.5, ["rate"]).select("id", F.round("rate", 2).alias("rate")),
        T + ", b as (select quantile_cont(rate, 0.25) as q1, quantile_cont(rate, 0.75) as q3 from t) select id, round(case when rate < q1 - 0.5 * (q3 - q1) then q1 - 0.5 * (q3 - q1) when rate > q3 + 0.5 * (q3 - q1) then q3 + 0.5 * (q3 - q1) else rate end, 2) as rate from t, b"),
    "cln_clean_report": Case(_flow, FLOW_SQL),
    "prf_missing_counts": Case(lambda s, d: prf.missing_counts(t(s, d)), T + " select * from (select 'price' as \"column\", count_if(price is null) as n from t union all select 'prio', count_if(prio is null) from t union all select 'gone', count(*) from t) where n > 0"),
    "prf_inf_counts": Case(lambda s, d: prf.inf_counts(t(s, d)), T + " select 'rate' as \"column\", count_if(abs(rate) = 'Infinity'::double) as n from t"),
    "prf_duplicate_count": Case(lambda s, d: prf.duplicate_count(dup(s, d)), D + " select (select count(*) from t) - (select count(*) from (select distinct * from t)) as duplicate_rows"),
    "prf_column_types": Case(lambda s, d: t(s, d).agg(F.count(F.lit(1)).alias("n")).join(prf.column_types(t(s, d))),
        "select n, c as \"column\", ty as type from (select count(*) as n from orders), (values ('id','bigint'),('price','double'),('rate','double'),('cust','bigint'),('prio','string'),('label','string'),('konst','int'),('gone','string')) v(c, ty)"),
    "prf_label_distribution": Case(lambda s, d: prf.label_distribution(t(s, d), "prio"), T + " select prio as label, count(*) as n from t group by prio"),
    "prf_class_imbalance": Case(lambda s, d: prf.class_imbalance(prf.label_distribution(t(s, d), "prio")).withColumn("imbalance_ratio", F.round("imbalance_ratio", 6)).withColumn("majority_share", F.round("majority_share", 6)),
        T + """, c as (select prio, count(*) as n from t where prio is not null group by prio) select count(*) as n_classes, (select prio from c order by n desc, prio limit 1) as majority_class, max(n) as majority_count,
        (select prio from c order by n, prio limit 1) as minority_class, min(n) as minority_count, round(max(n) / min(n), 6) as imbalance_ratio, round(max(n) / sum(n), 6) as majority_share from c"""),
    "prf_numeric_summary": Case(
        lambda s, d: prf.numeric_summary(t(s, d).select("price", "cust")).select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]),
        T + " " + " union all ".join(f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, round(max({c})::double, 4) as max from t" for c in ("price", "cust"))),
    "prf_categorical_summary": Case(
        lambda s, d: prf.categorical_summary(t(s, d), ["prio", "label", "cust"]),
        T + " " + " union all ".join(f"select '{c}' as \"column\", count({c}) as count, count(distinct {c}) as \"unique\", (select cast({c} as varchar) from t where {c} is not null group by {c} order by count(*) desc, cast({c} as varchar) limit 1) as top, (select count(*) from t where {c} is not null group by {c} order by count(*) desc limit 1) as top_freq, count_if({c} is null) as missing from t" for c in ("prio", "label", "cust"))),
    "prf_profile": Case(lambda s, d: prf.profile(t(s, d), "label", ["prio"])),
    "prf_check_schema": Case(lambda s, d: t(s, d).agg(F.count(F.lit(1)).alias("n")).join(prf.check_schema(t(s, d), ["id", "absent"], "target", ["prio", "cust", "nope"]).select("severity", "code")),
        "select n, v.* from (select count(*) as n from orders), (values ('warning','missing_expected_column'),('error','missing_label'),('warning','missing_categorical'),('warning','categorical_is_numeric')) v(severity, code)"),
    "prf_check_quality": Case(lambda s, d: prf.check_quality(t(s, d).drop("id"), "label", 1.01).withColumn("n", F.round("n", 6)),
        T + """, x as (select price, rate, cust, prio, label, konst, gone from t), c as (select label, count(*) as n from t where label is not null group by label)
        select 'warning' as severity, 'missing_values' as code, null as subject, cast(count_if(price is null) + count_if(prio is null) + count(*) as double) as n from t
        union all select * from (select 'warning', 'duplicate_rows', null, cast((select count(*) from x) - (select count(*) from (select distinct * from x)) as double) as n) where n > 0
        union all select * from (select 'warning', 'infinite_values', 'rate', cast(count_if(abs(rate) = 'Infinity'::double) as double) as n from t) where n > 0
        union all select 'error', 'all_null_column', 'gone', cast(count(*) as double) from t
        union all select 'warning', 'severe_class_imbalance', 'label', round(max(n) / min(n), 6) from c having max(n) / min(n) >= 1.01"""),
    "prf_recommend": Case(lambda s, d: prf.recommend(t(s, d), "label", 100.0),
        T + """select * from (values ('action','replace_infinite'),('action','impute_missing'),('action','encode_categorical'),('action','scale_numeric'),('risk','warning:infinite_values'),('risk','warning:missing_values'),('risk','error:all_null_column'),
        ('note','stratify_split'),('note','fit_on_train_only'),('note','report_more_than_accuracy'),('note','choose_multiclass_or_binary')) v(kind, text) where text <> 'choose_multiclass_or_binary' or (select count(distinct label) from t) > 2"""),
    "prf_audit_matrix": Case(lambda s, d: prf.audit_matrix({"train": t(s, d).select("cust", "price", "label"), "test": t(s, d).select("price", "cust", "prio", "label")}, "label", ["cust"]),
        T + " select * from (values ('train', 'differs_from_recorded', 'price'), ('test', 'columns', 'prio'), ('test', 'not_numeric', 'prio')) v(split, problem, columns) union all select 'train', 'missing', 'price' from t having count_if(price is null) > 0 union all select 'test', 'missing', 'price' from t having count_if(price is null) > 0 union all select 'test', 'missing', 'prio' from t having count_if(prio is null) > 0"),
    "spl_random_stratified": Case(_split_sizes, SIZES_SQL),
    "spl_random": Case(_random, T + """, z as (select count(*) as n, round(count(*) * 0.7) as a, round(count(*) * 0.15) as b from t)
        select 'train' as split, cast(a as bigint) as n, cast(a as bigint) as ids from z union all select 'validation', cast(b as bigint), cast(b as bigint) from z union all select 'test', cast(n - a - b as bigint), cast(n - a - b as bigint) from z"""),
    "spl_by_position": Case(_position, POS_SQL + " select * from p"),
    "spl_by_position_holdout": Case(lambda s, d: _position(s, d, "sw1"), HOLD_SQL + " select * from p"),
    "spl_manifest": Case(lambda s, d: spl.split_manifest(_position(s, d), "window_start_iso"), POS_SQL + " select split, count(*) as n, min(window_start_iso) as first_window, max(window_start_iso) as last_window from p group by split"),
    "enc_onehot": Case(lambda s, d: (lambda df: enc.fit_onehot(df.where("id % 3 <> 0 and prio <> '1-URGENT'"), ["prio"]).transform(df))(t(s, d).select("id", "prio")),
        T + """ select id, """ + ", ".join(f"case when prio = '{p}' then 1.0 else 0.0 end as \"prio_{p}\"" for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " from t"),
    "enc_ordinal": Case(lambda s, d: (lambda df: enc.fit_ordinal(df.where("prio <> '1-URGENT'"), ["prio"]).transform(df))(t(s, d).select("id", "prio")),
        T + ", k as (select prio, row_number() over (order by prio) - 1 as i from (select distinct prio from t where prio is not null and prio <> '1-URGENT')) select id, coalesce(i, -1) as prio from t left join k using (prio)"),
    "enc_labels": Case(lambda s, d: (lambda df: enc.fit_labels(df, "label").transform(df))(t(s, d).select("id", "label")),
        T + ", k as (select label, row_number() over (order by label) - 1 as i from (select distinct label from t)) select id, i as label from t join k using (label)"),
    "enc_decode": Case(lambda s, d: enc.decode_labels(t(s, d).select("id", (F.col("cust") - 2).alias("i")), ["a", "b", "c"], "i", "name"),
        T + " select id, cust - 2 as i, case cust - 2 when 0 then 'a' when 1 then 'b' when 2 then 'c' else cast(cust - 2 as varchar) end as name from t"),
    "enc_scale_standard": scaled("standard"),
    "enc_scale_minmax": scaled("minmax"),
    "enc_scale_robust": scaled("robust"),
}
