"""Plans stay what they were designed to be."""

import re

from __spark_entry__ import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_map_only(spark, sf):
    p = plan(queries()["flagship_ranked_board"](spark, sf))
    assert len(re.findall(r"\bExchange\b", p)) <= 1  # only the re-split of the source rows, when it has few splits
    assert "Python" not in p and "ArrowEval" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_cartesian_products(spark, sf):
    for name in ("e18_active_at", "e24_covers", "d1_words_in_window", "c9_locate_phrase_fuzzy", "g2_catalog_search", "b21_quote_in_note"):
        p = plan(queries()[name](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_filters_reach_the_scan(spark, sf):
    p = plan(queries()["h1_project_list"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in p and "TakeOrderedAndProject" in p
