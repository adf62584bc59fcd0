"""RSS 2.0: hard rules, soft warnings and item counts, decided in a document's own rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parse import list_array


def _children(out, names, parent: int, *wanted: str) -> list:
    """Unprefixed children without a namespace, of these names."""
    found, at, last = [], parent + 1, out.nodes[parent][1]
    while at <= last:
        n = out.nodes[at]
        if n[6] == "element" and n[7] in wanted and names[at][2] is None:
            found.append(n)
        at = n[1] + 1
    return found


def _root(out):
    return next(n for n in out.nodes if n[2] is None and n[6] == "element")


def rss_rules(out, names) -> str | None:
    """Why a document is no RSS: its root is no ``rss`` of version 2.0 with exactly one channel."""
    root = _root(out)
    if root[7] != "rss" or names[root[0]][2] is not None:
        return "root is no rss"
    if not any(key == "version" and value == "2.0" for _, key, value in root[9]):
        return "rss version is not 2.0"
    return None if len(_children(out, names, root[0], "channel")) == 1 else "not exactly one channel"


def _report(out, names) -> tuple[int, list[tuple[int, str]]] | None:
    channels = _children(out, names, _root(out)[0], "channel")
    if len(channels) != 1:
        return None
    channel = channels[0][0]
    have = {n[7] for n in _children(out, names, channel, "title", "link", "description")}
    warnings = [(i, f"channel without {x}") for i, x in enumerate(("title", "link", "description")) if x not in have]
    items = _children(out, names, channel, "item")
    for nth, item in enumerate(items, 1):
        if not _children(out, names, item[0], "title", "description"):
            warnings.append((nth + 2, f"item {nth} has neither title nor description"))
    return len(items), warnings


def rss_report(df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(doc_id, n_items, warnings)`` of every well-formed document with one channel; ``warnings`` holds ``(ord, warning)``: a channel
    without title, link or description, and items (from 1) with neither title nor description. No row leaves its task."""
    out = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType)]).add("n_items", "long")
    out = out.add("warnings", T._parse_datatype_string("array<struct<ord:int,warning:string>>"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from arborq.functions.checks import judge

        kind = to_arrow_schema(out)
        for batch in batches:
            rows, counts, warnings = [], [], []
            for i, source in enumerate(batch.column(1).to_pylist()):
                scan, names, found = judge(source)
                report = _report(scan, names) if not found else None
                if report:
                    rows.append(i)
                    counts.append(report[0])
                    warnings.append(report[1])
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), list_array(warnings, kind.field(2).type)], schema=kind)

    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")).mapInArrow(run, out)


def rss_warnings(df: DataFrame, **columns) -> DataFrame:
    """``(doc_id, ord, warning)``."""
    return rss_report(df, **columns).select("doc_id", F.explode("warnings").alias("w")).select("doc_id", "w.*")


def rss_item_count(df: DataFrame, **columns) -> DataFrame:
    """``(doc_id, n_items)`` of the documents with one channel."""
    return rss_report(df, **columns).select("doc_id", "n_items")
