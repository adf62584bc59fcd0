"""Documents -> rows. One Arrow pass scans every document and resolves its names; the tables here are views of its result."""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.functions.scanner import MAX_EXPANSION

ATTR = {"pos": "int", "name": "string", "value": "string", "prefix": "string", "local": "string", "ns_uri": "string"}
NODE = {
    "node_id": "int", "end_id": "int", "parent_id": "int", "depth": "int", "sib_pos": "int", "region": "string", "kind": "string", "name": "string",
    "prefix": "string", "local": "string", "ns_uri": "string", "text": "string", "text_at": "int", "text_len": "int", "run_len": "int",
}
DIAGNOSTIC = {"stage": "int", "node_id": "int", "ord": "int", "verdict": "string", "reason": "string"}
LISTS = {
    "diagnostics": DIAGNOSTIC,
    "elements": {"ord": "int", "name": "string", "kind": "string", "model": "string"},
    "attlists": {"ord": "int", "element": "string", "name": "string", "type": "string", "allowed": "array<string>", "default": "string", "value": "string"},
    "entities": {"ord": "int", "name": "string", "external": "boolean", "notation": "string"},
    "notations": {"ord": "int", "name": "string"},
}
PLAIN = {"v11": "boolean", "version": "string", "encoding": "string", "standalone": "string", "verdict": "string", "reason": "string", "root_type": "string", "external_subset": "boolean"}
#: Rows of an Arrow batch are handed on in groups of so many documents, so that node rows stay bounded.
GROUP = 64


def struct_type(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">"


def list_array(rows: list[list[tuple]], kind: pa.ListType, more: dict[str, pa.Array] | None = None) -> pa.Array:
    """A list of structs for each document, column by column; ``more``: columns that are arrays already, behind the others."""
    flat = list(chain.from_iterable(rows))
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    plain = fields[: len(fields) - len(more or {})]
    columns = zip(*flat, strict=True) if flat else [()] * len(plain)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, plain, strict=True)] + list((more or {}).values())
    at = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(arrays, fields=fields))


def _node_rows(scan, names) -> tuple[list[tuple], list[list[tuple]], bytes]:
    """Node rows, their attributes, and the document's character data, in which an element's text is ``text_len`` bytes from
    ``text_at``. ``run_len`` is that of a run of neighbouring text nodes, at its first."""
    data: list[bytes] = []
    size, rows, attrs, marks = 0, [], [], []
    starts: list[int] = []
    for n, own in zip(scan.nodes, names, strict=True):
        starts.append(size)
        if n[6] in ("text", "cdata"):
            raw = n[8].encode()
            data.append(raw)
            size += len(raw)
        marks.append(size)
    runs = [0] * len(starts)
    for i in range(len(starts) - 1, -1, -1):
        n = scan.nodes[i]
        if n[6] == "text":
            runs[i] = marks[i] - starts[i]
            if i + 1 < len(starts) and scan.nodes[i + 1][6] == "text" and scan.nodes[i + 1][2] == n[2]:
                runs[i] += runs[i + 1]
                runs[i + 1] = 0
    for i, (n, own) in enumerate(zip(scan.nodes, names, strict=True)):
        prefix, local, uri = own[:3] if own else (None, None, None)
        text = None if n[6] in ("text", "cdata") else n[8]
        rows.append((*n[:8], prefix, local, uri, text, starts[i], marks[n[1]] - starts[i], runs[i]))
        attrs.append([(*a, *b) for a, b in zip(n[9], own[3], strict=True)] if own else [])
    return rows, attrs, b"".join(data)


class Corpus:
    """The scanned documents: ``docs`` has one row for each, with all that was found in it; the other tables are its arrays,
    exploded, so none of them shuffles. Rows are told apart by themselves and not by ``doc_id``, which may be null or repeat.

    Nodes are pre-order numbered, with ``end_id`` the last descendant. Nothing is kept: a table that is read twice is
    scanned twice, unless :meth:`persist` (or a written copy of ``docs``) is used."""

    def __init__(self, docs: DataFrame, validating: bool = False):
        self.docs, self.validating = docs, validating

    def persist(self) -> Corpus:
        self.docs.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.docs.unpersist()

    def _table(self, name: str) -> DataFrame:
        return self.docs.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")

    def text_of(self, n: Column, length: str = "text_len") -> Column:
        """Character data of a node struct (of its run of text nodes, with ``run_len``)."""
        return F.decode(F.substring(F.col("content"), n["text_at"] + 1, n[length]), "UTF-8")

    def each(self, keep=None, **columns) -> DataFrame:
        """``doc_id`` and columns made from the node structs that ``keep`` holds for; no row leaves its task."""
        nodes = F.filter("nodes", keep) if keep is not None else F.col("nodes")
        picked = F.transform(nodes, lambda n: F.struct(*[make(n).alias(name) for name, make in columns.items()]))
        return self.docs.select("doc_id", F.explode(picked).alias("x")).select("doc_id", "x.*")

    @property
    def nodes(self) -> DataFrame:
        own = {c: (lambda n, c=c: n[c]) for c in NODE if c != "text"}
        text = lambda n: F.when(n["kind"].isin("text", "cdata"), self.text_of(n)).otherwise(n["text"])
        return self.each(None, **own, text=text, attrs=lambda n: n["attrs"])

    @property
    def attrs(self) -> DataFrame:
        rows = self.docs.select("doc_id", F.explode("nodes").alias("n")).where("n.kind = 'element'")
        found = rows.select("doc_id", "n.node_id", "n.end_id", F.col("n.name").alias("element"), F.explode("n.attrs").alias("a"))
        return found.select("doc_id", "node_id", "end_id", "element", "a.*")

    @property
    def diagnostics(self) -> DataFrame:
        return self._table("diagnostics")

    @property
    def elements(self) -> DataFrame:
        return self._table("elements")

    @property
    def attlists(self) -> DataFrame:
        return self._table("attlists")

    @property
    def entities(self) -> DataFrame:
        return self._table("entities")

    @property
    def notations(self) -> DataFrame:
        return self._table("notations")


def parse(df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", validating: bool = False, limit: int = MAX_EXPANSION) -> Corpus:
    """Scans ``source_col`` (string or binary) of every row. ``validating``: parameter entities are expanded before
    declarations are read, and validity is judged. ``limit``: characters that the entities of a document may expand to."""
    nodes = {**NODE, "attrs": f"array<{struct_type(ATTR)}>"}
    fields = {**PLAIN, "content": "binary", "nodes": f"array<{struct_type(nodes)}>", **{k: f"array<{struct_type(v)}>" for k, v in LISTS.items()}}
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(",".join(f"`{k}` {v}" for k, v in fields.items())).fields])
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from arborq.functions.checks import judge

        arrow = to_arrow_schema(schema)
        kind = {f.name: f.type for f in arrow}
        attr_kind = kind["nodes"].value_type.field(len(NODE)).type
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                plain, node_rows, attr_rows, content = [], [], [], []
                lists: dict[str, list] = {k: [] for k in LISTS}
                for source in part.column(1).to_pylist():
                    s, names, found = judge(source, validating, limit)
                    plain.append([getattr(s, k) for k in PLAIN])
                    rows, attrs, data = _node_rows(s, names) if names else ([], [], b"")
                    node_rows.append(rows)
                    attr_rows += attrs
                    content.append(data)
                    lists["diagnostics"].append(found)
                    for k in ("elements", "attlists", "entities", "notations"):
                        lists[k].append(getattr(s, k))
                columns = [part.column(0), *(pa.array(c, kind[k]) for k, c in zip(PLAIN, zip(*plain, strict=True), strict=True)), pa.array(content, pa.binary())]
                columns.append(list_array(node_rows, kind["nodes"], {"attrs": list_array(attr_rows, attr_kind)}))
                columns += [list_array(lists[k], kind[k]) for k in LISTS]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return Corpus(rows.mapInArrow(run, schema), validating)
