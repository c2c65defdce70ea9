"""All registered queries, by importing the modules that register them."""

from signalloom.plans import clean_queries, feature_queries, model_queries  # noqa: F401
from signalloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
