"""Imports every operator module, which fills the registry, and the pipeline."""

import corpus_pipeline
from locusloom.llm import (  # noqa: F401
    collocations,
    embedding_dedup,
    hard_negatives,
    html_text,
    langid,
    line_dedup,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    topk,
    url_filter,
)
from locusloom.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
