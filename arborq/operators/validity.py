"""Validity against the internal DTD, as a table; :mod:`arborq.functions.checks` judges it in the scan's pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .parse import Corpus


def validity_diagnostics(corpus: Corpus) -> DataFrame:
    """``(doc_id, stage, node_id, ord, verdict, reason)`` of every violation of a validity constraint; the corpus must have
    been parsed with ``validating``."""
    return corpus.diagnostics.where("stage >= 20")
