"""Reading documents, and input normalisation as column functions (what the scanner does to a document, for those who need it alone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.functions import chars as C


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, source)``: one row for each file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("source"))


def decoded(source: Column) -> Column:
    """Text of a binary column: UTF-16 by its byte order mark, declared Latin-1, else UTF-8 without its mark."""
    head = F.hex(F.substring(source, 1, 3))
    body = lambda n: F.substr(source, F.lit(n))
    latin = F.lower(pseudo_attribute(F.decode(source, "ISO-8859-1"), "encoding")).isin("iso-8859-1", "latin-1", "latin1")
    return (
        F.when(head.startswith("FFFE"), F.decode(body(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(body(3), "UTF-16BE"))
        .when(latin, F.decode(source, "ISO-8859-1"))
        .when(head == "EFBBBF", F.decode(body(4), "UTF-8"))
        .otherwise(F.decode(source, "UTF-8"))
    )


def pseudo_attribute(text: Column, name: str) -> Column:
    """What stands between the next two quotes behind the name inside the XML declaration; empty without it."""
    head = F.substring_index(text, "?>", 1)
    return F.when(F.contains(text, F.lit("?>")), F.regexp_extract(head, f"(?s)^<\\?xml.*?{name}[^'\"]*['\"]([^'\"]*)['\"]", 1)).otherwise(F.substring(text, 1, 0))


def is_v11(text: Column) -> Column:
    return pseudo_attribute(text, "version") == "1.1"


def illegal_at(text: Column, v11: bool = False) -> Column:
    """Place (from 1) of the first character that may not stand in a document; 0 without one."""
    return F.regexp_instr(text, F.lit(C.ILLEGAL_11 if v11 else C.ILLEGAL_10))


def line_ends(text: Column, v11: bool = False) -> Column:
    return F.regexp_replace(text, "\\r\\n|\\r\u0085|\\r|\u0085| " if v11 else "\\r\\n?", "\n")
