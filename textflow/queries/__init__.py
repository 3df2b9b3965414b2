"""Registered queries and their SQL."""

from . import align_queries, annot_queries, experiment_queries, form_queries, gloss_queries, ledger_queries, more_queries, replay_queries, stream_queries, text_queries, tier_queries
from .base import ORACLES, QUERIES

stream_queries.use_batch_oracles()

__all__ = ["ORACLES", "QUERIES", "align_queries", "annot_queries", "experiment_queries", "form_queries", "gloss_queries", "ledger_queries", "more_queries", "replay_queries", "stream_queries", "text_queries", "tier_queries"]
