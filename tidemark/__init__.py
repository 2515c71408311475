"""Weighted market index and event-cycle analytics on Spark."""

from tidemark.operators.cycles import Cycle, cycle_windows
from tidemark.operators.index import IndexResult, compute_index, weighted_index
from tidemark.operators.rolling import Columns
from tidemark.params import DEFAULT_RULES, RuleSet
from tidemark.session import build_session

__all__ = [
    "DEFAULT_RULES",
    "Columns",
    "Cycle",
    "IndexResult",
    "RuleSet",
    "build_session",
    "compute_index",
    "cycle_windows",
    "weighted_index",
]
