"""Physical plan shapes the design relies on."""
import re

from conftest import SF01
from findings_lake import queries as Q


def plan(spark, name):
    df = Q.registry()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


def test_retrieval_meets_blocks_in_an_equi_join(spark):
    p = plan(spark, "kb_retrieve")
    assert "CoGroup" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_report_counts_need_no_window(spark):
    for name in ["severity_counts_full", "scan_summary", "function_severity_text", "analyze_result"]:
        p = plan(spark, name)
        assert "Window" not in p, name
        assert "SortAggregate" not in p, name  # fixed-width buffers: hash aggregation
        assert re.search(r"HashAggregate\(keys=\[.*\], functions=\[partial_", p), name


def test_scans_are_pruned(spark):
    p = plan(spark, "severity_counts_full")
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", p)
    assert schemas and all("ts:" not in x for x in schemas)  # events.ts is never read
    p = plan(spark, "kb_topn_per_source")
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", p)
    assert "struct<vec_id:bigint,embedding:array<float>>" in schemas  # queries need no label


def test_cwe_dedupe_is_an_aggregation(spark):
    p = plan(spark, "plan_cwe_dedupe")
    assert re.search(r"functions=\[partial_min\(", p)


def test_no_nested_loop_or_cartesian_joins(spark):
    for name in ["plan_wordlists", "fuzz_plan_jobs", "plan_summary", "plan_collisions",
                 "mitigation_report", "scan_prompts", "combined_report"]:
        p = plan(spark, name)
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_mitigation_preview_filters_above_the_parse(spark):
    p = Q.registry()["mitigation_preview"](spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    parses = sum("parseJson(concat([, repaired#" in x for x in p.splitlines())
    filters = sum("Filter" in x and "parseJson" in x for x in p.splitlines())
    assert (parses, filters) == (1, 0)
