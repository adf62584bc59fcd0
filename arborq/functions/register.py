"""SQL functions and a table function over documents, and documents as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .checks import judge, verdict_of
from .scanner import scan


def document_json(source: bytes | str | None) -> str | None:
    """A well-formed document as JSON: ``{"xmlDecl", "prologMisc", "root", "epilogMisc"}`` with elements as
    ``{"name", "attrs", "contents"}``; fields that are empty are left out. Null for others, and for those nested too deeply to be
    written."""
    s, _, found = judge(source)
    if found:
        return None
    items: dict[int, dict] = {}
    out: dict = {"prologMisc": [], "epilogMisc": []}
    decl = {k: v for k, v in (("version", s.version), ("encoding", s.encoding), ("standalone", s.standalone)) if v}
    for node, _, parent, _, _, region, kind, name, text, attrs in s.nodes:
        if kind == "element":
            item = {"name": name}
            if attrs:
                item["attrs"] = [{"name": n, "value": v} for _, n, v in attrs]
            items[node] = item
            wrapped = {"child": item}
        else:
            wrapped = {kind: {"target": name, "data": text} if kind == "pi" else text}
        if parent is not None:
            items[parent].setdefault("contents", []).append(wrapped)
        elif kind == "element":
            out["root"] = item
        else:
            out["prologMisc" if region == "prolog" else "epilogMisc"].append(wrapped)
    try:
        return json.dumps(({"xmlDecl": decl} if decl else {}) | {k: v for k, v in out.items() if v}, ensure_ascii=False)
    except RecursionError:
        return None


class XmlNodes:
    """Rows of a document's nodes; a document that is not well-formed has none."""

    def eval(self, source: str):
        for node, end, parent, depth, pos, region, kind, name, text, _ in scan(source).nodes:
            yield node, end, parent, depth, pos, region, kind, name, text


def register(spark: SparkSession) -> None:
    """Makes ``xml_verdict(source)``, ``xml_validity(source)``, ``xml_json(source)`` and the table function
    ``xml_nodes(source)`` known to SQL."""

    @F.pandas_udf("string")
    def xml_verdict(source: pd.Series) -> pd.Series:
        return source.map(lambda s: verdict_of(*judge(s)[::2], False)[0])

    @F.pandas_udf("string")
    def xml_validity(source: pd.Series) -> pd.Series:
        return source.map(lambda s: verdict_of(*judge(s, True)[::2], True)[0])

    @F.pandas_udf("string")
    def xml_json(source: pd.Series) -> pd.Series:
        return source.map(document_json)

    spark.udf.register("xml_verdict", xml_verdict)
    spark.udf.register("xml_validity", xml_validity)
    spark.udf.register("xml_json", xml_json)
    nodes = F.udtf(XmlNodes, returnType="node_id int, end_id int, parent_id int, depth int, sib_pos int, region string, kind string, name string, text string")
    spark.udtf.register("xml_nodes", nodes)


__all__ = ["XmlNodes", "document_json", "register"]
