"""Queries for evaluation, experiment tables, feature selection and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.checks.base import PRED, SERIES, Case, bind
from opsframe.operators import bundles
from opsframe.operators import experiments as ex
from opsframe.operators import learning as ml
from opsframe.operators import metrics as met
from opsframe.operators import selection as sel
from opsframe.session import scratch_dir

P = f"with p as ({PRED})"
M = P + """, c as (select y_true, y_pred, count(*) as n from p group by all), l as (select y_true as label from c union select y_pred from c),
m as (select label, coalesce((select sum(n) from c where y_true = label), 0) as support, coalesce((select sum(n) from c where y_pred = label), 0) as predicted, coalesce((select n from c where y_true = label and y_pred = label), 0) as tp, (select sum(n) from c) as total from l),
k as (select label, support, case when predicted = 0 then 0 else tp / predicted end as precision, case when support = 0 then 0 else tp / support end as recall, case when support + predicted = 0 then 0 else 2 * tp / (support + predicted) end as f1, predicted - tp as fp, support - tp as fn,
 case when total = support then 0 else (predicted - tp) / (total - support) end as fpr, tp, total from m)"""
RUN = """select s_name as experiment_id, 'd' || cast(s_nationkey % 4 as string) as dataset, case s_suppkey % 5 when 0 then 'xgboost' when 1 then 'lightgbm' when 2 then 'mlp' when 3 then 'lstm' else 'other' end as model_type,
 case when s_suppkey % 9 = 0 then null else '2024-01-' || cast(10 + s_suppkey % 19 as string) end as created_at, case when s_suppkey % 11 = 0 then null else round(s_acctbal / 10000, 3) end as f1, round(cast(s_suppkey % 17 as double) / 17, 6) as accuracy, round(cast(s_suppkey % 13 as double) / 13, 6) as roc_auc,
 1.0 + s_suppkey % 60 as train_seconds, 0.5 + s_suppkey % 30 as size_mb, 0.01 + s_suppkey % 7 as inference_seconds, case when s_suppkey % 10 = 0 then 'archived' when s_suppkey % 10 = 1 then 'production' else 'candidate' end as stage from supplier"""
R = f"with r as ({RUN})"
LB = R + ", lb as (select *, row_number() over (partition by dataset order by f1 desc nulls last, accuracy desc nulls last, roc_auc desc nulls last, model_type, experiment_id) as rank from r)"
NUM = "select l_orderkey, l_quantity as q, l_extendedprice as e, l_discount as d, l_tax as t, l_quantity * 2 + l_linenumber as q2, 3.0 as k, l_returnflag as y from lineitem"
CONTRIB = "select event_id as row_id, event_type as feature, cast(user_id % 2 as string) as output, value - 20 as value from events"
COLS = ["q", "e", "d", "t"]


def b(sql):
    return lambda s, d: bind(s, d, sql)


pred, runs, nums, contrib = map(b, (PRED, RUN, NUM, CONTRIB))


def rnd(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def auc_sql(pos, score, src):
    return f"select (sum(r) filter (p) - count_if(p) * (count_if(p) + 1) / 2.0) / (count_if(p) * count_if(not p)) from (select {pos} as p, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as r from {src})"


def scores(s, d):
    return {"A": "sa", "N": "sn", "R": "sr"}, pred(s, d).withColumns({"sa": F.col("score"), "sn": 1 - F.col("score"), "sr": F.col("score") * 2 - F.col("l_linenumber") / 10})


def flags(s, d):
    return pred(s, d).select((F.col("y_true") == "R").cast("int").alias("label"), (F.col("y_pred") == "R").cast("int").alias("flag"), F.col("score"))


def _ovr(s, d):
    sc, df = scores(s, d)
    return met.roc_auc_ovr(df, sc).withColumn("auc", F.round("auc", 6))


def _index(s, d):
    m = runs(s, d).select("experiment_id", "dataset", "model_type", "created_at", F.create_map(F.lit("lr"), F.lit("0.1"), F.lit("depth"), F.col("size_mb").cast("string")).alias("params"),
        F.map_filter(F.create_map(F.lit("test"), F.when(F.col("stage") != "candidate", F.create_map(F.lit("f1"), F.col("f1"), F.lit("accuracy"), F.col("accuracy"))), F.lit("train"), F.create_map(F.lit("f1"), F.lit(1.0), F.lit("accuracy"), F.lit(1.0))), lambda k, v: v.isNotNull()).alias("metrics"))
    return ex.experiment_index(m).select("experiment_id", "split", "f1", "accuracy", "params")


def _threshold(s, d):
    df = pred(s, d)
    return met.flag_above(df, "score", met.threshold(df, "score", 0.93)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def _score_cols(fn):
    return lambda s, d: fn(nums(s, d), COLS, "y").withColumn("score", F.round("score", 4))


def corr_sql(*cols):
    return " union all ".join(f"select '{a}' as a, '{b_}' as b, round(corr({a}, {b_}), 5) as r from x" for i, a in enumerate(cols) for b_ in cols[i + 1:])


def _pairs(method):
    def run(s, d):
        base = nums(s, d).select(*COLS, "q2", "k")
        cols = [*COLS, "q2"] if method == "spearman" else [*COLS, "q2", "k"]
        if method == "spearman":
            base = sel.ranked(base, cols)
        return sel.correlations(base, cols).withColumn("r", F.round("r", 5))

    return run


RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in [*COLS, "q2"])


TASK = "select l_quantity as q, l_extendedprice as e, l_discount as d, l_tax as t, case when l_quantity * 1000 > l_extendedprice then 'hi' else 'lo' end as y from lineitem where l_returnflag is not null"


def _model(s, d, kind, **params):
    """Rows of each class, and whether the model finds most of them."""
    df = bind(s, d, TASK)
    found = ml.train(df, "y", COLS, kind, **params).predict(df).groupBy(F.col("y").alias("y_true")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("recall"), F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p) - 1)).alias("off"))
    return found.select("y_true", "n", (F.col("recall") > 0.6).alias("learned"), (F.col("off") < 1e-9).alias("sums_to_one"))


MODEL_SQL = f"select y as y_true, count(*) as n, true as learned, true as sums_to_one from ({TASK}) group by 1"
#: Three classes that the columns decide, in parts of whole order keys; numbers of the returned rows are known without a model.
RAW = """select l_orderkey, l_linenumber, l_quantity as q, l_extendedprice as e, l_discount as d, l_returnflag as mode, l_orderkey % 10 as g,
 case when l_quantity < 15 then 'small' when l_discount > 0.05 then 'cheap' else 'plain' end as y from lineitem"""


def _scored(df, keys=()):
    p = F.map_values("class_probabilities")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("complete").alias("scored"), F.count_if(~F.col("y_pred").isin("small", "cheap", "plain")).alias("unknown"),
        F.count_if((F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9) | (F.size(p) != 3)).alias("bad_probabilities"),
        (F.avg((F.col("y") == F.col("y_pred")).cast("double")) > 0.8).alias("learned"))


def _saved_bundle(s, d, kind, **params):
    """A bundle is fitted, written, read in another session and scores raw rows, some of them incomplete."""
    raw, root = bind(s, d, RAW), f"{scratch_dir(s)}/bundle"
    parts = raw.where("g < 7"), raw.where("g = 7")
    version = bundles.save_bundle(bundles.fit_bundle(parts[0], "y", ["q", "e", "d"], ["mode"], kind=kind, valid=parts[1] if kind == "gbt" else None, **params), root)
    test = raw.where("g > 7").withColumn("q", F.when(F.col("l_orderkey") % 50 != 9, F.col("q")))
    return _scored(bundles.load_bundle(s, root, version).score(test, "flag"), ["g"])


SCORED_SQL = f"select g, count(*) as rows, count_if(l_orderkey % 50 <> 9) as scored, 0 as unknown, 0 as bad_probabilities, true as learned from ({RAW}) where g > 7 group by 1"


def _boosted_rounds(s, d):
    """Rounds of boosted classes on labels that are partly noise: the validation rows end them before the limit."""
    raw = bind(s, d, RAW).withColumn("y", F.when(F.abs(F.xxhash64("l_orderkey", "l_linenumber")) % 3 == 0, "plain").otherwise(F.col("y")))
    m = ml.train(raw.where("g < 3"), "y", ["q", "e", "d"], "gbt", valid=raw.where("g = 7"), maxIter=8, maxDepth=4, stepSize=1.0, patience=2).model.boosted
    h = m.rounds_table(s)
    return h.agg((F.count(F.lit(1)) < 8).alias("ended_early"), (F.min_by("round", "validation_loss") == m.rounds).alias("best_kept"), (F.max_by("train_loss", "round") < F.min_by("train_loss", "round")).alias("learned"))


def _experiment(s, d):
    """Every split's metrics in range, and its confusion counts adding up to its rows."""
    e = ml.run_experiment({k: v.select("q", "e", "d", "y") for k, v in _raw_parts(s, d).items()}, "y", ["q", "e", "d"], "forest", numTrees=5)
    ok = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "false_positive_rate"):
        ok = ok & F.col(c).between(0, 1)
    counted = e.confusion.groupBy("split").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells"))
    return e.metrics.select("split", "n_classes", ok.alias("in_range"), (F.col("predict_seconds") > 0).alias("timed")).join(counted, "split")


def _raw_parts(s, d):
    raw = bind(s, d, RAW)
    return {"train": raw.where("g < 7"), "validation": raw.where("g = 7"), "test": raw.where("g > 7")}


def _isolation(s, d):
    df = bind(s, d, SERIES).select("event_id", "octets", F.coalesce("cpu", F.lit(0.0)).alias("cpu"), "status")
    f = ml.fit_isolation_forest(df, ["octets", "cpu", "status"], "event_id", 20)
    return f.score(df).agg(F.count(F.lit(1)).alias("rows"), (F.min("score") > 0).alias("above_zero"), (F.max("score") <= 1).alias("up_to_one"), (F.stddev_pop("score") > 0.001).alias("differs"))


def _parts(s, d):
    df = nums(s, d).select("q", "e", "d", "t", F.when(F.col("q") > 25, "hi").otherwise("lo").alias("y"), (F.col("l_orderkey") % 10).alias("g"))
    return {"train": df.where("g < 7").drop("g"), "validation": df.where("g = 7").drop("g"), "test": df.where("g > 7").drop("g")}


def _engineer(s, d):
    from opsframe.plans.flows import engineer_features

    return engineer_features({k: v.withColumn("split", F.lit(k)).withColumn("k", F.lit(1.0)) for k, v in _parts(s, d).items()}, "y", k=2)[1]


CASES = {
    "met_confusion": Case(lambda s, d: met.confusion(pred(s, d), ["A", "N", "R", "Z"]), M + " select a.x as y_true, b.x as y_pred, coalesce(n, 0) as n from (values ('A'), ('N'), ('R'), ('Z')) a(x), (values ('A'), ('N'), ('R'), ('Z')) b(x) left join c on c.y_true = a.x and c.y_pred = b.x"),
    "met_classification": Case(lambda s, d: rnd(met.classification_metrics(pred(s, d)), "accuracy", "precision", "recall", "f1"), M + " select round(sum(tp) / max(total), 6) as accuracy, round(sum(precision * support) / sum(support), 6) as precision, round(sum(recall * support) / sum(support), 6) as recall, round(sum(f1 * support) / sum(support), 6) as f1 from k"),
    "met_classification_macro": Case(lambda s, d: rnd(met.classification_metrics(pred(s, d), "macro"), "accuracy", "precision", "recall", "f1"), M + " select round(sum(tp) / max(total), 6) as accuracy, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from k"),
    "met_fpr": Case(lambda s, d: rnd(met.fpr(pred(s, d)), "fpr"), M + " select label, round(fpr, 6) as fpr from k union all select '__macro__', round(avg(fpr), 6) from k union all select '__headline__', round(avg(fpr), 6) from k"),
    "met_roc_auc": Case(lambda s, d: rnd(met.roc_auc(pred(s, d).withColumn("pos", F.col("y_true") == "R"), "pos", "score"), "auc"), P + f" select round(({auc_sql(chr(39) + 'R' + chr(39) + ' = y_true', 'score', 'p')}), 6) as auc, count_if(y_true = 'R') as positives, count_if(y_true <> 'R') as negatives from p"),
    "met_roc_auc_ovr": Case(_ovr, P + f", x as (select *, 1 - score as sn, score * 2 - l_linenumber / 10 as sr from p), a as ({auc_sql(chr(39) + 'A' + chr(39) + ' = y_true', 'score', 'x')}), b as ({auc_sql(chr(39) + 'N' + chr(39) + ' = y_true', 'sn', 'x')}), c as ({auc_sql(chr(39) + 'R' + chr(39) + ' = y_true', 'sr', 'x')}), "
        "n as (select count_if(y_true = 'A') as na, count_if(y_true = 'N') as nn, count_if(y_true = 'R') as nr from p) select round(((select * from a) * na + (select * from b) * nn + (select * from c) * nr) / (na + nn + nr), 6) as auc, 3 as classes from n"),
    "met_anomaly": Case(lambda s, d: rnd(met.anomaly_metrics(flags(s, d)), "precision", "recall", "f1", "auc"), P + f""", x as (select y_true = 'R' as y, y_pred = 'R' as f, score from p), q as (select count_if(y and f) as tp, count_if(not y and f) as fp, count_if(y and not f) as fn, count_if(not y and not f) as tn from x)
        select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(({auc_sql('y', 'score', 'x')}), 6) as auc from q"""),
    "met_score_summary": Case(lambda s, d: rnd(met.score_summary(flags(s, d)), "anomaly_rate", "mean", "std", "min", "p50", "p95", "p99", "max"), P + " select count(*) as n, round(avg((y_pred = 'R')::int), 6) as anomaly_rate, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(min(score), 6) as min, round(quantile_cont(score, 0.5), 6) as p50, round(quantile_cont(score, 0.95), 6) as p95, round(quantile_cont(score, 0.99), 6) as p99, round(max(score), 6) as max from p"),
    "met_class_metrics": Case(lambda s, d: rnd(met.class_metrics(pred(s, d)), "precision", "recall", "f1", "fpr"), M + " select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, fp, fn, round(fpr, 6) as fpr, tp, total from k"),
    "met_hardest_classes": Case(lambda s, d: rnd(met.hardest_classes(pred(s, d), 2), "f1"), M + " select * from (select row_number() over (order by f1, support desc, label) as rank, label, round(f1, 6) as f1, support from k where support > 0) where rank <= 2"),
    "met_misclassified": Case(lambda s, d: met.misclassified(pred(s, d), 100, keys=["l_orderkey", "l_linenumber", "y_true", "y_pred"], positive="R").select("l_orderkey", "l_linenumber", "y_true", "y_pred", "score", "kind"),
        P + " select l_orderkey, l_linenumber, y_true, y_pred, score, case when y_pred = 'R' then 'false_positive' else 'false_negative' end as kind from p where y_true <> y_pred order by score desc, l_orderkey, l_linenumber, y_true, y_pred limit 100"),
    "met_analyze_errors": Case(lambda s, d: rnd(met.analyze_errors(pred(s, d)), "accuracy", "macro_f1", "weighted_f1"), M + ' select max(total) as "rows", max(total) - sum(tp) as misclassified, round(sum(tp) / max(total), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from k'),
    "met_rank_contributions": Case(lambda s, d: rnd(met.rank_contributions(contrib(s, d)), "mean_abs", "std_abs", "percent", "cumulative", digits=4), f"""with x as ({CONTRIB}), r as (select row_id, feature, avg(abs(value)) as a from x group by all), g as (select feature, avg(a) as m, stddev_pop(a) as s from r group by 1),
        t as (select *, 100 * m / (sum(m) over ()) as p from g) select feature, round(m, 4) as mean_abs, round(s, 4) as std_abs, round(p, 4) as percent, row_number() over (order by m desc, feature) as rank, round(sum(p) over (order by m desc, feature rows unbounded preceding), 4) as cumulative from t"""),
    "met_rank_rows": Case(lambda s, d: met.rank_row_contributions(contrib(s, d).withColumn("row_id", F.col("row_id") % 300), 2).select("row_id", "feature", "rank", F.round("value", 3).alias("value")).groupBy("row_id").agg(F.max("rank").alias("k"), F.round(F.max(F.abs("value")), 3).alias("top")),
        f"with x as (select row_id % 300 as row_id, value from ({CONTRIB})) select row_id, least(2, count(*)) as k, round(max(abs(value)), 3) as top from x group by 1"),
    "exp_index": Case(_index, R + " select experiment_id, case when stage <> 'candidate' then 'test' else 'train' end as split, case when stage <> 'candidate' then round(f1, 6) else 1 end as f1, case when stage <> 'candidate' then accuracy else 1 end as accuracy, 'depth=' || cast(cast(size_mb as double) as varchar) || ';lr=0.1' as params from r"),
    "exp_latest_runs": Case(lambda s, d: ex.latest_runs(runs(s, d)).select("dataset", "model_type", "experiment_id", "runs"), R + " select dataset, model_type, arg_max(experiment_id, coalesce(created_at, '0000-00-00') || experiment_id) as experiment_id, count(*) as runs from r group by all"),
    "exp_leaderboard": Case(lambda s, d: ex.leaderboard(runs(s, d)).groupBy("dataset", "rank").agg(F.max("f1").alias("f1"), F.max("accuracy").alias("accuracy")), LB + " select dataset, rank, f1, accuracy from lb"),
    "exp_model_means": Case(lambda s, d: rnd(ex.model_means(runs(s, d)), "f1", "accuracy", "roc_auc", "train_seconds"), R + " select model_type, round(avg(f1), 6) as f1, round(avg(accuracy), 6) as accuracy, round(avg(roc_auc), 6) as roc_auc, round(avg(train_seconds), 6) as train_seconds, count(distinct dataset) as datasets from r group by 1"),
    "exp_family_means": Case(lambda s, d: rnd(ex.family_means(runs(s, d)).drop("fastest", "top_f1_model"), "f1", "accuracy", "train_seconds"), R + " select case when model_type in ('xgboost', 'lightgbm') then 'tree' when model_type in ('mlp', 'lstm') then 'deep' else 'other' end as family, round(avg(f1), 6) as f1, round(avg(accuracy), 6) as accuracy, round(avg(train_seconds), 6) as train_seconds from r group by 1"),
    "exp_efficiency": Case(lambda s, d: rnd(ex.efficiency_leaders(runs(s, d)).select("criterion", "value"), "value"), R + """ select 'train_seconds' as criterion, round(min(train_seconds), 6) as value from r union all select 'size_mb', round(min(size_mb), 6) from r union all select 'inference_seconds', round(min(inference_seconds), 6) from r
        union all select 'f1_per_minute', round(max(f1 / (train_seconds / 60)), 6) from r union all select 'f1_per_mb', round(max(f1 / size_mb), 6) from r"""),
    "exp_headline_facts": Case(lambda s, d: ex.headline_facts(ex.leaderboard(runs(s, d)), 0.05).where("fact = 'close_datasets'"), LB + " select 'close_datasets' as fact, cast(count_if(round(a.f1 - b.f1, 9) <= 0.05) as varchar) as value from lb a left join lb b on a.dataset = b.dataset and b.rank = 2 where a.rank = 1"),
    "exp_best_runs": Case(lambda s, d: ex.best_runs(runs(s, d)).select("dataset", "experiment_id", "f1"), R + " select dataset, experiment_id, f1 from (select *, row_number() over (partition by dataset order by f1 desc, experiment_id) as k from r where stage <> 'archived' and f1 is not null) where k = 1"),
    "exp_register": Case(lambda s, d: ex.register(runs(s, d), 0.3, datasets=["d0", "d2"]).select("experiment_id", "stage"), R + " select experiment_id, 'candidate' as stage from r where f1 >= 0.3 and dataset in ('d0', 'd2')"),
    "exp_promote": Case(lambda s, d: ex.promote(runs(s, d), ex.best_runs(runs(s, d)).where("dataset <> 'd3'"), "better f1", "2024-02-01").select("experiment_id", "stage", "reason"),
        R + ", bst as (select dataset, experiment_id as n from (select *, row_number() over (partition by dataset order by f1 desc, experiment_id) as k from r where stage <> 'archived' and f1 is not null) where k = 1 and dataset <> 'd3') select experiment_id, case when experiment_id = n then 'production' when n is not null and stage = 'production' then 'archived' else stage end as stage, case when experiment_id = n or (n is not null and stage = 'production') then 'better f1' end as reason from r left join bst using (dataset)"),
    "exp_resolve": Case(lambda s, d: ex.resolve(runs(s, d)), R + ", p as (select dataset, max(experiment_id) as e from r where stage = 'production' group by 1), bst as (select dataset, experiment_id as n from (select *, row_number() over (partition by dataset order by f1 desc, experiment_id) as k from r where stage <> 'archived' and f1 is not null) where k = 1) select dataset, coalesce(e, n) as experiment_id, case when e is not null then 'production' else 'best' end as via from bst full join p using (dataset)"),
    "fsl_variance": Case(lambda s, d: rnd(sel.variances(nums(s, d), [*COLS, "k"]), "score", digits=4), f"with x as ({NUM}) " + " union all ".join(f"select '{c}' as feature, round(var_samp({c}), 4) as score from x" for c in [*COLS, "k"])),
    "fsl_pearson": Case(_pairs("pearson"), f"with x as ({NUM}) " + corr_sql(*COLS, "q2") + " union all " + " union all ".join(f"select '{c}', 'k', null" for c in [*COLS, "q2"])),
    "fsl_spearman": Case(_pairs("spearman"), f"with n as ({NUM}), x as (select {RANKS} from n) " + corr_sql(*COLS, "q2")),
    "fsl_correlation_filter": Case(lambda s, d: nums(s, d).select(*sel.correlation_filter(nums(s, d), [*COLS, "q2"], 0.95)[0]).agg(*[F.round(F.sum(c), 2).alias(c) for c in COLS]), f"with x as ({NUM}) select " + ", ".join(f"round(sum({c}), 2) as {c}" for c in COLS) + " from x"),
    "fsl_mutual_information": Case(lambda s, d: rnd(sel.mutual_information(nums(s, d), ["q", "d"], "y", 4), "score", digits=5), f"""with x as ({NUM}), b as (select y, case when q <= (select quantile_cont(q, 0.25) from x) then 0 when q <= (select quantile_cont(q, 0.5) from x) then 1 when q <= (select quantile_cont(q, 0.75) from x) then 2 else 3 end as q,
        case when d <= (select quantile_cont(d, 0.25) from x) then 0 when d <= (select quantile_cont(d, 0.5) from x) then 1 when d <= (select quantile_cont(d, 0.75) from x) then 2 else 3 end as d from x),
        l as (select 'q' as feature, q as b, y from b union all select 'd', d, y from b), n as (select feature, b, y, count(*) as n from l group by all),
        w as (select *, sum(n) over (partition by feature, b) as nx, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as nt from n) select feature, round(greatest(0, sum(n / nt * ln(n * nt / (nx * ny)))), 5) as score from w group by 1"""),
    "fsl_chi2": Case(_score_cols(sel.chi2_scores), f"with x as ({NUM}) " + " union all ".join(f"(with z as (select y, ({c} - (select min({c}) from x)) / (select max({c}) - min({c}) from x) as v from x), g as (select y, sum(v) as o, count(*) as n from z group by y), e as (select *, sum(o) over () * n / sum(n) over () as ex from g) select '{c}' as feature, round(sum((o - ex) * (o - ex) / ex), 4) as score from e)" for c in COLS)),
    "fsl_anova": Case(_score_cols(sel.anova_scores), f"with x as ({NUM}) " + " union all ".join(f"(with g as (select y, count(*) as n, avg({c}) as m, var_pop({c}) * count(*) as ss from x group by y), a as (select avg({c}) as gm from x) select '{c}' as feature, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 4) as score from g, a)" for c in COLS)),
    "fsl_select_top_k": Case(lambda s, d: sel.select_features(nums(s, d), COLS, "y", "variance", 2).transform(nums(s, d)).agg(F.round(F.sum("e"), 2).alias("e"), F.round(F.sum("q"), 2).alias("q"), F.count("y").alias("y")), f"with x as ({NUM}) select round(sum(e), 2) as e, round(sum(q), 2) as q, count(y) as y from x"),
    "fsl_tree_importance": Case(lambda s, d: ml.tree_importance(nums(s, d), COLS, "y", 5, 3).agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("score"), 6).alias("total"), F.count_if(F.col("score") < 0).alias("negative")), "select 4 as features, 1.0 as total, 0 as negative"),
    "fsl_rfe": Case(lambda s, d: ml.rfe(nums(s, d), COLS, "y", 2, 1).groupBy("rank").agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("score"), 6).alias("score")), "select * from (values (1, 2, 2.0), (2, 1, 0.5), (3, 1, 0.333333)) v(rank, features, score)"),
    "fsl_pca": Case(lambda s, d: ml.fit_pca(nums(s, d), COLS, 0.9).transform(nums(s, d)).agg(F.count(F.lit(1)).alias("rows"), F.round(F.abs(F.avg("pc_1")), 3).alias("mean"), F.round(F.var_samp("pc_1") / F.var_samp("e"), 3).alias("share")), f"with x as ({NUM}) select count(*) as rows, 0.0 as mean, 1.0 as share from x"),
    "fsl_engineer": Case(_engineer, "select * from (values ('split', 'excluded'), ('k', 'low_variance'), ('d', 'not_selected'), ('t', 'not_selected'), ('q', 'selected'), ('e', 'selected')) v(feature, reason)"),
    "mlt_forest": Case(lambda s, d: _model(s, d, "forest"), MODEL_SQL),
    "mlt_gbt": Case(lambda s, d: _model(s, d, "gbt"), MODEL_SQL),
    "mlt_mlp": Case(lambda s, d: _model(s, d, "mlp"), MODEL_SQL),
    "mlt_isolation_forest": Case(_isolation, "select count(*) as rows, true as above_zero, true as up_to_one, true as differs from events"),
    "mlt_boosted_classes": Case(lambda s, d: _saved_bundle(s, d, "gbt", maxIter=4, maxDepth=3), SCORED_SQL),
    "mlt_boosted_rounds": Case(_boosted_rounds, "select true as ended_early, true as best_kept, true as learned"),
    "mlt_threshold": Case(_threshold, P + ", t as (select quantile_cont(score, 0.93) as c from p) select (score > c)::int as flag, count(*) as n from p, t group by 1"),
    "mlt_experiment": Case(_experiment, f"select case when g < 7 then 'train' when g = 7 then 'validation' else 'test' end as split, 3 as n_classes, true as in_range, true as timed, count(*) as rows, 9 as cells from ({RAW}) group by 1"),
    "mlt_tune": Case(lambda s, d: ml.tune(_parts(s, d)["train"], _parts(s, d)["validation"], "y", COLS, "forest", {"numTrees": [3, 5], "maxDepth": [2, 4]}, 2).agg(F.count_distinct("trial").alias("trials"), F.count_if(F.col("value").between(0, 1)).alias("in_range"), F.count_distinct("params").alias("settings")), "select 2 as trials, 2 as in_range, 2 as settings"),
    "mlt_batch_score": Case(lambda s, d: _saved_bundle(s, d, "forest", numTrees=10, maxDepth=6), SCORED_SQL),
}
