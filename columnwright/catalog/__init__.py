"""Registered queries and the SQL that gives the same rows."""

from columnwright.catalog.registry import ORACLES, QUERIES
from columnwright.catalog import columns, io, ledgers, prompts, runs, scores, selections, splits

__all__ = ["ORACLES", "QUERIES", "columns", "io", "ledgers", "prompts", "runs", "scores",
           "selections", "splits"]
