"""What the plans must look like: pruned scans, pushed filters, combined maxima, keyed joins."""

import re

import pytest

from siftwork.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"register_users", "registration_answer", "registration_flow", "register_in_order"}))
def test_joins_have_keys(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(registry.latest_session_of_one_user(spark, sf))
    assert "EqualTo(o_custkey,7)" in text
    assert "o_totalprice" not in text and "TakeOrderedAndProject" in text


def test_latest_rows_are_combined_before_the_shuffle(spark, sf):
    text = plan(registry.latest_by_user_purpose(spark, sf))
    assert "Window" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert text.index("partial_max") > text.index("Exchange")  # printed top down


def test_token_states_read_each_column_once_needed(spark, sf):
    text = plan(registry.token_state(spark, sf))
    assert "Window" not in text
    assert not re.search(r"ReadSchema: struct<[^>]*\bvalue\b", text)


@pytest.mark.parametrize("name", ["unrevoked_sessions", "mask_email_a", "docs_gate_ipv4", "public_token_parse", "issue_tokens"])
def test_row_rules_do_not_shuffle(spark, sf, name):
    assert "Exchange" not in plan(registry.QUERIES[name](spark, sf))


#: Queries with an operator that goes through sorted rows in order, which no column function expresses.
IN_ORDER = {"cooldown_in_order", "reset_issues_in_order"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - IN_ORDER))
def test_no_python_on_executors(spark, sf, name):
    assert not re.search("Python|Pandas|Arrow", plan(registry.QUERIES[name](spark, sf)))
