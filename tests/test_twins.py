"""A few queries of each family against their SQL twins; tools/verify.py runs all."""

import os
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = "hier_anchor_spine hier_cycle_components clash_straddles census_undeclared label_norm_keys ck_d3_competing_paths rewrite_merge_terms finding_locus_density bind_gates timing_phase_stats log_replay_state job_feed_priority lex_clause_kind norm_capacities gate_first_violation live_counters lex_celex finding_debt mlc_coverage p4_found pc_naming pc_typing pc_chain pc_reuse gs_signatures cat_clashes top_reuse set_first_kept lint_definitions fin_gates ck_b3_links ck_d3_shared_condition mut_spaces src_envelopes win_attach str_flush_marks".split()
if os.environ.get("ALL_TWINS"):
    import __spark_entry__

    NAMES = sorted(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from tools.verify import compare

    assert compare(spark, DATA, [name]) == []


def test_catalogue_is_whole():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
