"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("ngram_join", "token_output", "spotsigs", "quality", "wfst_pieces", "pii", "chat", "mixing", "toxicity", "ann", "collocation", "orchard", "sharding")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"textflow.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
