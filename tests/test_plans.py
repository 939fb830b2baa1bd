"""Plans that must not get worse: what scans read, where rows are shuffled, where Python runs."""

import re

import pytest

from tolparse.plans.queries import QUERIES, customer_trees


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange (?:hash|range|Single)", text))


@pytest.mark.parametrize("name, columns", [("tokenize_words", {"doc_id", "text"}), ("tag_counts", {"html"}), ("tag_entities", {"page_id", "html"}), ("pair_depth", {"event_id", "props"}), ("span_relations", {"l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"})])
def test_scans_read_what_is_used(spark, sf_dir, name, columns):
    text = plan(QUERIES[name](spark, sf_dir))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert read and {c.split(":")[0] for s in read for c in s.split(",")} == columns


@pytest.mark.parametrize("name", ["tokenize_words", "tokenize_lines", "pair_depth", "ll_parse_json", "lr_parse_json", "recovery", "custom_blocks"])
def test_parsing_does_not_shuffle_by_key(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert exchanges(text) == 0 and len(re.findall(r"\bMapInArrow", text)) == 1


@pytest.mark.parametrize("name", ["span_relations", "span_hull", "span_exclude", "rename_types", "chunk_values", "text_functions"])
def test_column_operators_are_one_stage(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["multiset_diff_left", "remap_offsets", "void_subtrees", "leaf_collapse", "merge_water", "section_parents", "routine_aggregation", "pair_depth_window"])
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name, by_key, tables", [("ghost_splice", 1, 2), ("list_flatten", 1, 2), ("entities_from_nodes", 1, 1), ("section_parents", 1, 1), ("routine_visitor", 9, 1)])
def test_folds_shuffle_once_and_need_no_action(spark, sf_dir, name, by_key, tables):
    """Building the plan runs no job but those that read tables' schemas; a fold is one shuffle by document over what it is given."""
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"planning {name}", name)
    df = QUERIES[name](spark, sf_dir)
    assert len(status.getJobIdsForGroup(f"planning {name}")) <= tables
    spark.sparkContext.setJobGroup("tests", "tests")
    text = plan(df)
    given = exchanges(plan(customer_trees(spark, sf_dir))) if name in ("ghost_splice", "list_flatten") else 0
    assert exchanges(text) - given <= by_key and "NestedLoop" not in text
    assert name == "routine_visitor" or "Join" not in text or given


@pytest.mark.parametrize("name", ["leaf_collapse", "ancestor_pairs", "section_hierarchy"])
def test_trees_and_sections_are_one_fold(spark, sf_dir, name):
    given = exchanges(plan(customer_trees(spark, sf_dir))) if name != "section_hierarchy" else 0
    text = plan(QUERIES[name](spark, sf_dir))
    assert exchanges(text) - given <= 1 and "FlatMapGroups" not in text and "SortMergeJoin" not in text.split("MapInArrow")[0]


def test_cutting_patterns_moves_no_text(spark, sf_dir):
    assert "Exchange hash" not in (text := plan(QUERIES["exclude_segments"](spark, sf_dir))) and "Arrow" not in text
    moved = re.findall(r"Exchange hashpartitioning\([^\n]*", plan(QUERIES["remap_offsets"](spark, sf_dir)))
    assert moved and not any("html" in m or "text" in m for m in moved)


def test_differences_do_not_join(spark, sf_dir):
    assert "Join" not in plan(QUERIES["multiset_diff_left"](spark, sf_dir))


def test_top_k_is_bounded(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_docs"](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[[^\]]*c_acctbal", plan(QUERIES["multiset_diff_left"](spark, sf_dir)))
