"""Namespace resolution and its rules, as tables; the scan resolves the names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parse import Corpus

_DECLARES = "name = 'xmlns' OR name LIKE 'xmlns:%'"


def declarations(corpus: Corpus) -> DataFrame:
    """``(doc_id, node_id, end_id, prefix, uri)``: every xmlns attribute and where it is in scope."""
    return corpus.attrs.where(_DECLARES).select("doc_id", "node_id", "end_id", F.expr("substring(name, 7)").alias("prefix"), F.col("value").alias("uri"))


def resolve_elements(corpus: Corpus) -> DataFrame:
    """Element rows with ``prefix, local, ns_uri``: the nearest declaration around them; an empty default namespace is none."""
    return corpus.nodes.where("kind = 'element'")


def resolve_attributes(corpus: Corpus) -> DataFrame:
    """Attribute rows (declarations left out) with ``prefix, local, ns_uri``; without a prefix they are in no namespace."""
    return corpus.attrs.where(f"NOT ({_DECLARES})")


def namespace_diagnostics(corpus: Corpus) -> DataFrame:
    """``(doc_id, stage, node_id, ord, verdict, reason)`` of every violation of a namespace rule."""
    return corpus.diagnostics.where("stage = 10")
