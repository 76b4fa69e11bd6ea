"""What the plans must look like to hold at scale."""

import re

import pytest

from casequarry.registry import QUERIES


def plan(spark, small, name):
    df = QUERIES[name](spark, small)
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def columns_read(text, table):
    """Columns of each scan of a table."""
    scans = re.findall(rf"Location: [^\n]*/{table}\.parquet[^\n]*\n(?:PushedFilters: [^\n]*\n)?ReadSchema: struct<([^\n]*)>", text)
    return [{part.split(":")[0] for part in re.sub(r"<[^<>]*>", "", scan).split(",")} for scan in scans]


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("q01_exact_hash_latest", "documents", {"doc_id", "text"}),
        ("q06_jaccard_topk", "documents", {"doc_id", "text"}),
        ("q12_store_stats", "documents", {"doc_id", "text"}),
        ("q14_rates", "labels", {"doc_id", "quality", "toxic"}),
        ("q19_parent_choice", "orders", {"o_custkey", "o_orderkey", "o_orderpriority"}),
        ("q26_views", "lineitem", {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"}),
        ("q30_json", "customer", {"c_custkey", "c_name", "c_nationkey", "c_mktsegment"}),
    ],
)
def test_scans_read_only_what_is_used(spark, small, name, table, columns):
    found = columns_read(plan(spark, small, name), table)
    assert found and all(scan <= columns for scan in found)


@pytest.mark.parametrize("name", ["q04_fused_topk", "q04b_text_channel_only", "q06_jaccard_topk", "q36_predictions", "q14b_most_missed"])
def test_top_k_is_a_heap(spark, small, name):
    assert "TakeOrderedAndProject" in plan(spark, small, name)


@pytest.mark.parametrize("name", ["q01_exact_hash_latest", "q02_superseded", "q03_version_history", "q17_first_wins_dedup", "q19_parent_choice"])
def test_latest_and_first_are_summed_up_before_a_shuffle(spark, small, name):
    """No window over a key that a third of all rows may share."""
    text = plan(spark, small, name)
    assert "Window" not in text and re.search(r"(Hash|Sort|ObjectHash)Aggregate", text)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("q05_topk_per_query", "q07_cascade", "q24_matrix")])
def test_only_stated_query_sets_meet_all_rows(spark, small, name):
    text = plan(spark, small, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("q05_topk_per_query", "q07_cascade", "q28_nms", "q67_keyword_catalogue", "q69_summed_areas", "q70_projection_cells", "q74_nearest_vectors", "q75_nearest_profiles")])
def test_python_runs_only_where_it_must(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, small, name))


def test_a_filter_reaches_the_scan(spark, small):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(toxic,1\)", plan(spark, small, "q29b_delete"))
