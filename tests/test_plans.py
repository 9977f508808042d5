"""Plan guard: no registered query plans a cross product."""
import pytest

from tests.conftest import SF_SMALL

from corpusmill.plans import load_all

QUERIES = load_all()[0]
SKIP = {"svm_margins", "svm_training_error", "svm_coverage_error", "svm_metrics", "lda_topics", "word2vec_docs", "bisecting_kmeans",
        "part_sequences", "split_repair_multilabel", "split_repair_leftovers"}  # these run jobs inside the call


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cross_products(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
