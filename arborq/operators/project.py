"""Projection of documents into a schema, in the pass that scans them: relations by type, unknown markup and typed values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.functions.scanner import MAX_EXPANSION
from arborq.plans.schema import Schema, pascal, snake

from .parse import list_array

_PLACED = (
    "array<struct<node_id:int,end_id:int,parent_id:int,name:string,local:string,type:string,field:string,wrapper:string,"
    "repeated:boolean,oneof:int,values:map<string,string>>>"
)


def mangled(name, upper: bool):
    """Type name (or, not upper, field name) of an element or attribute, as column functions."""
    parts = F.filter(F.split(name, "[-_ ]|(?<=[a-z0-9])(?=[A-Z])"), lambda w: w != "")
    if upper:
        capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substr(w, F.lit(2)))
        return F.array_join(F.transform(parts, capital), "")
    return F.array_join(F.transform(parts, F.lower), "_")


class Projection:
    """``docs`` has one row a document: ``doc_id`` and kept columns, ``verdict, reason, root``, ``placed`` and ``unknown``
    (arrays) and ``value``, the typed value as JSON: elements that the schema has once merge into one message, the last
    attribute or text winning and the last variant of a choice; repeated ones are listed. The other tables are views of it;
    none of them shuffles."""

    def __init__(self, docs: DataFrame, schema: Schema, keep: list[str]):
        self.docs, self.schema, self.keep = docs, schema, list(keep)

    @property
    def verdicts(self) -> DataFrame:
        return self.docs.select("doc_id", *self.keep, "verdict", "reason", "root")

    @property
    def placed(self) -> DataFrame:
        """Element rows with their type, and the field and wrapper of their parent's type that they fill."""
        return self.docs.select("doc_id", F.explode("placed").alias("x")).select("doc_id", "x.*")

    @property
    def unknown(self) -> DataFrame:
        return self.docs.select("doc_id", F.explode("unknown").alias("x")).select("doc_id", "x.*")

    @property
    def values(self) -> DataFrame:
        """``(doc_id, node_id, type, field, value)`` of attributes and text."""
        return self.placed.select("doc_id", "node_id", "type", F.explode("values").alias("field", "value"))

    def relation(self, type_name: str, fields: list[str]) -> DataFrame:
        """One row for each element of a type: ``doc_id, node_id, parent_id`` and its string fields."""
        rows = self.docs.select("doc_id", F.explode(F.filter("placed", lambda x: x["type"] == type_name)).alias("x"))
        return rows.select("doc_id", "x.node_id", "x.parent_id", *[F.element_at("x.values", F.lit(f)).alias(f) for f in fields])

    def variant(self) -> Column:
        """The typed value of each row of ``docs`` as VARIANT."""
        return F.parse_json("value")

    def typed(self, type_name: str) -> DataFrame:
        """``(doc_id, message)``: the typed value of accepted documents with a root of this type, as the type's struct. Types
        that refer to themselves have no struct; their values are read as JSON or VARIANT."""
        struct = self.schema.struct(type_name)
        if struct is None:
            raise ValueError(f"type {type_name} refers to itself")
        root = F.get("placed", F.lit(0))["type"] == type_name
        return self.docs.where((F.col("verdict") == "VALID") & root).select("doc_id", F.from_json("value", struct).alias("message"))


def project(df: DataFrame, schema: Schema, *, id_col: str = "doc_id", source_col: str = "source", keep: list[str] = (), limit: int = MAX_EXPANSION) -> Projection:
    """Types every element of the well-formed documents by the schema.

    Types follow local names, parents before children: an element fills a field of its parent's type whose type is its own, a
    plain field before a wrapper's variant. Elements with a string field ``text`` and no message field are leaves: their descendant
    text is the value (if not blank), nothing in them is looked at. Verdict: INVALID for an unknown root type or unknown markup
    that the schema doesn't tolerate, else VALID; documents that are not well-formed keep their verdict. Null and repeated
    ids are carried, each row with its own result."""
    out = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *[T.StructField(c, df.schema[c].dataType) for c in keep]])
    own = {"verdict": "string", "reason": "string", "root": "string", "placed": _PLACED, "unknown": "array<struct<node_id:int,what:string>>", "value": "string"}
    for name, kind in own.items():
        out = out.add(name, T._parse_datatype_string(kind))
    rows = df.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), *keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from arborq.functions.checks import judge, root_name
        from arborq.functions.projecting import Layout, Projected, as_json, place

        layout, arrow = Layout(schema), to_arrow_schema(out)
        kinds = [f.type for f in arrow][-3:]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                heads, placed, unknown, value = [], [], [], []
                for source in part.column(0).to_pylist():
                    scan, names, found = judge(source, False, limit)
                    got = place(scan, names, layout) if not found else Projected()
                    bad = (found[0][3], found[0][4], None) if found else ("INVALID", got.why, None) if got.why else None
                    heads.append(bad or ("VALID", None, root_name(scan)))
                    placed.append(got.placed)
                    unknown.append(got.unknown)
                    value.append(as_json(got.value) if got.placed else None)
                texts = [pa.array(c, pa.string()) for c in zip(*heads, strict=True)]
                columns = [*part.columns[1:], *texts, list_array(placed, kinds[0]), list_array(unknown, kinds[1]), pa.array(value, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return Projection(rows.mapInArrow(run, out), schema, keep)


__all__ = ["Projection", "mangled", "pascal", "project", "snake"]
