"""What the plans look like: columns pruned, no Python where none is needed, no unbounded cross joins."""

from __future__ import annotations

import re

import pytest

from glimpsar.plans import catalog


def plan(spark, small, name):
    return catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


#: Matrix products and replays; everything else is left to the engine.
PYTHON = {
    *("knn_exact", "best_region_per_photo", "recall_topk", "recall_alive", "recall_with_feedback", "knn_lsh", "knn_ivf"),
    *("descriptor_2nn", "ratio_test", "verify_pairs", "multi_exemplar_verify", "region_pool", "feedback_fold"),
}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - PYTHON))
def test_stays_in_the_engine(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, small, name))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("per_class_accept", {"l_partkey", "l_quantity", "l_returnflag"}),
        ("inlier_distribution", {"l_partkey", "l_quantity", "l_returnflag"}),
        ("photo_ids", {"doc_id", "source"}),
        ("timeline_summary", {"event_id", "user_id", "ts"}),
    ],
)
def test_reads_only_what_it_needs(spark, small, name, columns):
    read = set()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, small, name)):
        read |= {c.split(":")[0] for c in schema.split(",")}
    assert read == columns


def test_cross_joins_have_a_bounded_side(spark, small):
    """Wherever all rows meet all rows, one side is broadcast: a grid, a total or the query's own regions."""
    for name in catalog.queries():
        assert "CartesianProduct" not in plan(spark, small, name)


def test_pooling_and_descriptors_shuffle_no_pairs(spark, small):
    """Pooling moves nothing; descriptors are shuffled as keypoints, before they meet."""
    assert "Exchange" not in plan(spark, small, "region_pool")
    last = plan(spark, small, "descriptor_2nn")
    assert last.index("MapInArrow") < last.index("Exchange")
    assert "Window" not in last
