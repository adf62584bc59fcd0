"""The pieces of documents as rows, for looking at what a scan reads."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"(?P<declaration><\?xml(?=[ \t\r\n]).*?\?>)|(?P<pi><\?.*?\?>)|(?P<comment><!--.*?-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<doctype><!DOCTYPE)"
    r"|(?P<end></[^>]*>)|(?P<empty><(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>)|(?P<start><(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)|(?P<reference>&[^;<&\s]*;)|(?P<text>[^<&]+)|(?P<other>.)",
    re.S,
)


def split(text: str) -> list[tuple[int, str, str]]:
    """``(at, kind, text)`` of every piece; together they are the whole text, well-formed or not."""
    from arborq.functions.scanner import doctype_end

    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        end = m.end()
        if m.lastgroup == "doctype":
            close = doctype_end(text, end)
            end = close + 1 if close >= 0 else len(text)
        out.append((at, m.lastgroup, text[at:end]))
        at = end
    return out


def tokens(df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(doc_id, nth, at, kind, text)`` of every piece of every document, in order. Documents that can't be decoded, and null
    ones, have none."""
    out = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType)])
    for name, kind in (("nth", "integer"), ("at", "integer"), ("kind", "string"), ("text", "string")):
        out = out.add(name, kind)

    def run(batches):
        from arborq.functions.scanner import Rejected, decode, line_ends

        for batch in batches:
            for i, source in enumerate(batch.column(1).to_pylist()):
                try:
                    rows = split(line_ends(*decode(source))) if source is not None else []
                except Rejected:
                    rows = []
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    ids = batch.column(0).take(pa.array([i] * len(part), pa.int64()))
                    columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(lo, lo + len(part)), pa.int32()), *columns], out.names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")).mapInArrow(run, out)
