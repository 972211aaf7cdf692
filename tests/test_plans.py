"""What the plans look like: pruned scans, pushed filters, rank limits, no products, no Python in the hot path."""

import re

import pytest

from loomset.queries import QUERIES
from tests.conftest import SF

#: Queries of which a part goes to Arrow batches: an automaton over texts, paths of any depth, repair of JSON, fuzzy spans.
PYTHON = {"q23_containment_join", "q42_key_paths", "q43_json_recovery", "q50_span_match", "q57_span_tiers"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_little_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", plan)


def test_scans_are_pruned_and_filtered(spark):
    plan = formatted(QUERIES["q28_left_semi"](spark, SF))
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_returnflag,R\).*GreaterThan\(l_quantity,45", plan)
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = formatted(QUERIES["q05_prefilter_decision"](spark, SF))
    assert "Exchange" not in plan and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_ranks_are_cut_before_the_shuffle(spark):
    for name in ("q01_priority_dedup", "q09_diverse_quota"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in plan_of(QUERIES["q08_pool_order_top100"](spark, SF))
