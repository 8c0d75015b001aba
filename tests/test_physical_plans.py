"""What the optimizer makes of the queries: no needless shuffle, nothing computed twice."""

import re

import pytest

from acceptance.queries import QUERIES

# Writes files or starts a stream when called; what is left to plan is a plain scan.
WRITERS = {
    "stored_results", "stream_results", "stream_batches", "csv_corpus", "jsonl_input",
    "published_messages", "peeked_message", "message_files", "published_counts", "stored_result_ids",
    "bounded_batches", "large_csv", "fitted_model_rows", "fitted_model_quality", "score_native_faults",
    "merged_results", "running_accuracy", "redelivered_results",
}


@pytest.fixture(scope="module")
def physical(spark, sf_dir):
    """The physical plan of a query, as text."""
    known = {}

    def plan(name):
        if name not in known:
            df = QUERIES[name](spark, sf_dir)
            known[name] = df._jdf.queryExecution().executedPlan().toString()
        return known[name]

    return plan


def shuffles(tree):
    """Exchanges other than a broadcast and the even spread of a small input."""
    return [
        line for line in tree.splitlines()
        if re.search(r"\bExchange\b", line) and "RoundRobinPartitioning" not in line
    ]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_pairwise_join(physical, name):
    tree = physical(name)
    assert "CartesianProduct" not in tree and "NestedLoop" not in tree


@pytest.mark.parametrize(
    "name",
    ["result_rows", "result_rows_pandas", "mixed_plan_outcomes", "score_fanout", "accepted_answers",
     "routed_messages", "dead_letter_rows", "bound_inputs", "plan_results", "message_outcome"],
)
def test_rows_are_never_shuffled(physical, name):
    assert shuffles(physical(name)) == []


@pytest.mark.parametrize("name", ["accuracy_by_model", "result_accuracy"])
def test_evaluation_shuffles_partial_counts_only(physical, name):
    tree = physical(name)
    assert len(shuffles(tree)) == 2  # by model, then the sort of one row per model
    assert tree.count("partial_count") >= 1


@pytest.mark.parametrize(
    "name", ["accuracy_by_model", "row_correctness", "score_fanout", "result_rows", "result_accuracy",
             "mixed_plan_outcomes", "plan_results"]
)
def test_texts_are_scored_once(physical, name):
    tree = physical(name)
    assert tree.count("RLIKE(lower(") == 2  # one per classifier
    assert len(re.findall(r"Project .*RLIKE\(lower\(", tree)) == 1  # in one projection


@pytest.mark.parametrize("name", ["result_rows", "accepted_answers", "routed_messages", "dead_letter_rows"])
def test_bodies_are_parsed_once(physical, name):
    """The parser is named three times: the value, and the two forms of a text that holds
    the mark itself."""
    assert physical(name).count("from_json(VariantType") == 3


def test_scans_read_what_is_needed(physical):
    tree = physical("parse_reply")
    assert "ReadSchema: struct<doc_id:bigint>" in tree
    tree = physical("accuracy_by_model")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in tree
    assert "IsNotNull(toxic)" in tree
