"""Every registered query with its equivalent SQL, over the supplied tables."""

from catalogue import cycles, filters, index, joins, maintain, report, sources, store, trend
from catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cycles", "filters", "index", "joins", "maintain", "report", "sources", "store", "trend"]
