"""All registered queries."""

from . import analysis_queries, clean_queries, model_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
