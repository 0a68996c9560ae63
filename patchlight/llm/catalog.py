"""Importing this module registers all queries of the subpackage."""

from __future__ import annotations

import corpus_pipeline
from patchlight.llm import (  # noqa: F401
    chat, decontaminate, fingerprints, licenses, linededup, lmscore, mixing, paragraphs, periodic, quality, repair, simhash, substrings,
)
from patchlight.llm.registry import ORACLES, QUERIES

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
