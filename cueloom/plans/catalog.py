"""All registered queries of the library."""

from . import cue_queries, evidence_queries, manifest_queries, more_queries, review_queries, script_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
