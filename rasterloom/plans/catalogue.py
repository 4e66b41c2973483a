"""All queries of the library (without the subpackage for training data)."""

from rasterloom.plans import graph_queries, partition_queries, selector_queries, study_queries  # noqa: F401
from rasterloom.plans.registry import ORACLE, QUERIES  # noqa: F401
