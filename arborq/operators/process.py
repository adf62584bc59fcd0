"""Verdicts: scan errors, namespace rules and validity, the earliest violation first, decided in the pass that scans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.functions.scanner import MAX_EXPANSION

from .parse import Corpus


def diagnostics(corpus: Corpus) -> DataFrame:
    """``(doc_id, stage, node_id, ord, verdict, reason)`` of every violation."""
    return corpus.diagnostics


def verdicts(corpus: Corpus) -> DataFrame:
    """``(doc_id, verdict, reason, root)`` of every document: the verdict of its first violation by stage and
    document order, else VALID or WELL_FORMED by mode."""
    first = F.get("diagnostics", F.lit(0))
    root = F.get(F.filter("nodes", lambda n: (n["kind"] == "element") & n["parent_id"].isNull()), F.lit(0))["name"]
    good = "VALID" if corpus.validating else "WELL_FORMED"
    verdict = F.coalesce(first["verdict"], F.lit(good))
    return corpus.docs.select("doc_id", verdict.alias("verdict"), first["reason"].alias("reason"), F.when(first.isNull(), root).alias("root"))


def process(
    df: DataFrame,
    *,
    schema=None,
    validating: bool = False,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: list[str] = (),
    limit: int = MAX_EXPANSION,
) -> DataFrame:
    """``(doc_id, verdict, reason, root)`` of each row, and the columns of ``keep``; streams too. With a schema, documents are not
    validated against their DTD but projected: VALID or INVALID, whatever the mode. ``root`` is the qualified name of
    the root element of accepted documents. Every row has its own verdict: null and repeated ids are carried. Documents
    whose entities expand to more than ``limit`` characters are LIMIT_EXCEEDED."""
    if schema is not None:
        from .project import project

        return project(df, schema, id_col=id_col, source_col=source_col, keep=keep, limit=limit).verdicts
    fields = df.schema
    held = [fields[id_col].dataType, *[fields[c].dataType for c in keep]]
    out = T.StructType([T.StructField(n, t) for n, t in zip(["doc_id", *keep], held, strict=True)])
    for name in ("verdict", "reason", "root"):
        out = out.add(name, "string")
    rows = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), *keep)

    def run(batches):
        from arborq.functions.checks import judge, verdict_of

        for batch in batches:
            found = []
            for source in batch.column(0).to_pylist():
                scan, _, violations = judge(source, validating, limit)
                found.append(verdict_of(scan, violations, validating))
            own = [pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [*batch.schema.names[1:], "verdict", "reason", "root"])

    return rows.mapInArrow(run, out)
