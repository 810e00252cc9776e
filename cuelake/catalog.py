"""Registered queries of the timed-text operators and their SQL."""
from cuelake.plans import cue_queries, detection_queries, lexicon_queries, quality_queries, source_queries, streaming_queries, translation_queries
from cuelake.plans.registry import ORACLES, QUERIES

FLAGSHIP = "t1_merge_islands"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
