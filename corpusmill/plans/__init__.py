"""Named queries (one per checked operator) and their DuckDB oracles."""

from corpusmill.plans.registry import ORACLES, QUERIES

_MODULES = ("q_text", "q_labels", "q_splits", "q_metrics", "q_parts", "q_vectors", "q_models", "q_io")


def load_all():
    import importlib
    for m in _MODULES:
        importlib.import_module(f"corpusmill.plans.{m}")
    return QUERIES, ORACLES
