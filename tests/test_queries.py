"""Registered queries against DuckDB SQL at the smallest scale; OPSFRAME_ALL=1 runs every one."""

import os

import pytest

from check import compare, duck
from opsframe.checks import all_cases

SAMPLE = [
    "log_enrich", "agg_weak_labels", "fnd_all_rules", "win_series_features", "win_fill_series", "prj_to_canonical", "cln_clip_iqr", "prf_categorical_summary",
    "spl_random_stratified", "enc_ordinal", "cor_rule_loop", "top_edges", "cfg_trunk_missing", "dif_tables", "rsk_score", "evt_traps", "str_monitoring_state",
    "ops_executive_summary", "met_roc_auc", "exp_best_runs", "fsl_anova", "inv_trunks", "fun_expand_ranges", "fun_expand_list", "rsk_findings_view", "src_split_csv", "src_headerless_csv", "evt_leak_audit",
]
CASES = all_cases()
NAMES = list(CASES) if os.environ.get("OPSFRAME_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    ok, note, _ = compare(spark, duck(sf_dir), sf_dir, name, CASES[name].run, CASES[name].sql)
    assert ok, note


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
