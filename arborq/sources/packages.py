"""OPC packages (zip archives of parts): parts, content types and relationships as tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.operators.parse import parse


def clean_path(path: Column) -> Column:
    """Absolute path without ``.``, ``..`` and empty steps, by a fold over its steps."""

    def step(a, s):
        return F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))

    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


#: Part of a package that tells the content types of the others.
CONTENT_TYPES = "/[Content_Types].xml"


def _unzipped(content: bytes | None) -> dict[str, bytes]:
    """Parts by name, the last of a name; raises ValueError with what is wrong with an archive."""
    import io
    import posixpath
    import zipfile
    import zlib

    parts = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            for info in z.infolist():
                if not info.is_dir():
                    parts[posixpath.normpath("/" + info.filename.lstrip("/"))] = z.read(info)
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zlib.error, OSError, ValueError, struct.error) as e:
        raise ValueError(f"broken archive: {e}") from None
    return parts


def parts_of(packages: DataFrame) -> DataFrame:
    """``packages(package_id, content binary)`` -> ``(package_id, name, content, error)``: of parts of a name the last counts.
    A broken archive gives one row without a name, with the error."""

    def run(batches):
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, raw, None) for name, raw in _unzipped(content).items()]
                except ValueError as e:
                    rows = [(None, None, str(e))]
                names, raws, errors = zip(*rows, strict=True) if rows else ((), (), ())
                ids = pa.array([key.as_py()] * len(rows), batch.column(0).type)
                arrays = [ids, pa.array(names, pa.string()), pa.array(raws, pa.binary()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["package_id", "name", "content", "error"])

    kind = packages.schema["package_id"].dataType.simpleString()
    return packages.select("package_id", "content").mapInArrow(run, f"package_id {kind}, name string, content binary, error string")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``(package_id, content)`` of the package files at a path; the file is the ``package_id``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("package_id"), "content")


def _child_attrs(corpus, name: str, wanted: list[str]) -> DataFrame:
    """Attributes (by local name) of all elements of a local name below the root, as columns."""
    nodes = corpus.nodes.where("kind = 'element' AND depth = 1").where(F.substring_index("name", ":", -1) == name)

    def value(w: str) -> Column:
        return F.get(F.filter("attrs", lambda a: F.substring_index(a["name"], ":", -1) == w), F.lit(0))["value"].alias(w)

    return nodes.select("doc_id", "node_id", *[value(w) for w in wanted])


def content_types(parts: DataFrame) -> DataFrame:
    """``(package_id, extension, part, type)``: defaults by lower-case extension, overrides by part."""
    rows = parts.where("name = '/[Content_Types].xml'").select(F.col("package_id").alias("doc_id"), F.col("content").alias("source"))
    corpus = parse(rows)
    none, kind = F.lit(None).cast("string"), F.col("ContentType").alias("type")
    defaults = _child_attrs(corpus, "Default", ["Extension", "ContentType"]).select("doc_id", F.lower("Extension").alias("extension"), none.alias("part"), kind)
    overrides = _child_attrs(corpus, "Override", ["PartName", "ContentType"]).select("doc_id", none, F.col("PartName"), kind)
    return defaults.union(overrides).withColumnRenamed("doc_id", "package_id")


def with_types(parts: DataFrame, types: DataFrame) -> DataFrame:
    """Parts with ``content_type``: an override of the part beats the default of its extension."""
    own = types.where("part IS NOT NULL").groupBy("package_id", F.col("part").alias("name")).agg(F.max("type").alias("own"))
    by_extension = types.where("extension IS NOT NULL").groupBy("package_id", "extension").agg(F.max("type").alias("default"))
    extension = F.when(F.instr("name", ".") > 0, F.lower(F.substring_index("name", ".", -1))).otherwise("")
    both = parts.withColumn("extension", extension).join(own, ["package_id", "name"], "left").join(by_extension, ["package_id", "extension"], "left")
    return both.withColumn("content_type", F.coalesce("own", "default")).drop("own", "default", "extension")


def is_xml_part(name: Column, content_type: Column) -> Column:
    """By content type; without one by the extensions ``.xml`` and ``.rels``."""
    typed = content_type.endswith("+xml") | content_type.isin("application/xml", "text/xml")
    return F.when(content_type.isNotNull(), typed).otherwise(name.endswith(".xml") | name.endswith(".rels"))


def rels_name(part: Column) -> Column:
    """Name of the relationships part of a part (``/`` for the package)."""
    return F.regexp_replace(part, "^(.*/)([^/]*)$", "$1_rels/$2.rels")


def relationships(parts: DataFrame) -> DataFrame:
    """``(package_id, source_part, id, type, target, mode, resolved)``; internal targets are resolved against the source's folder."""
    rels = parts.where(F.col("name").rlike("(^|/)_rels/[^/]*\\.rels$"))
    rows = rels.select(F.struct("package_id", "name").alias("doc_id"), F.col("content").alias("source"))
    found = _child_attrs(parse(rows), "Relationship", ["Id", "Type", "Target", "TargetMode"])
    source = F.regexp_replace(F.col("doc_id.name"), "_rels/([^/]*)\\.rels$", "$1")
    base = F.regexp_replace(source, "[^/]*$", "")
    target = F.when(F.col("Target").startswith("/"), F.col("Target")).otherwise(F.concat(base, F.col("Target")))
    resolved = F.when(F.coalesce("TargetMode", F.lit("")) == "External", None).otherwise(clean_path(target))
    return found.select(
        F.col("doc_id.package_id").alias("package_id"),
        source.alias("source_part"),
        F.col("Id").alias("id"),
        F.col("Type").alias("type"),
        F.col("Target").alias("target"),
        F.coalesce("TargetMode", F.lit("")).alias("mode"),
        resolved.alias("resolved"),
    )


def _local_children(out, names, wanted: tuple[str, ...]) -> list[tuple[str, dict[str, str]]]:
    """Local names and attributes (by local name) of the root's children of these local names."""
    root = next(n for n in out.nodes if n[2] is None and n[6] == "element")
    found = []
    for n, own in zip(out.nodes, names, strict=True):
        if n[2] == root[0] and own and own[1] in wanted:
            found.append((own[1], {a[1]: v for (_, _, v), a in zip(n[9], own[3], strict=True)}))
    return found


def _clean(path: str) -> str:
    steps: list[str] = []
    for step in path.split("/"):
        if step == "..":
            del steps[-1:]
        elif step not in ("", "."):
            steps.append(step)
    return "/" + "/".join(steps)


def _rels(raw: bytes | None, part: str) -> list[tuple]:
    """``(id, type, target, mode, resolved)`` of a part's relationships; bad ones are none."""
    from arborq.functions.checks import judge

    if raw is None:
        return []
    out, names, found = judge(raw)
    if found:
        return []
    base, rows = part.rpartition("/")[0] + "/", []
    for _, a in _local_children(out, names, ("Relationship",)):
        target, mode = a.get("Target", ""), a.get("TargetMode", "")
        resolved = None if mode == "External" else _clean(target if target.startswith("/") else base + target)
        rows.append((a.get("Id"), a.get("Type"), target, mode, resolved))
    return rows


def _types(raw: bytes | None) -> tuple[dict, dict]:
    """Content types by part and by lower-case extension; a package without the list has none."""
    from arborq.functions.checks import judge

    if raw is None:
        return {}, {}
    out, names, found = judge(raw)
    if found:
        raise ValueError(f"content types: {found[0][4]}")
    rows = _local_children(out, names, ("Default", "Override"))
    by_extension = {a.get("Extension", "").lower(): a.get("ContentType") for n, a in rows if n == "Default"}
    return {a.get("PartName"): a.get("ContentType") for n, a in rows if n == "Override"}, by_extension


_REL = "array<struct<id:string,type:string,target:string,mode:string,resolved:string>>"
_PART = f"struct<name:string,content_type:string,root:string,nodes:int,rels:{_REL},format:string,verdict:string,value:string>"


def process_packages(packages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """``(package_id, package_verdict, reason, rels, name, content_type, root, nodes, part_rels, format, verdict, value)``: one row
    for each part but the content types and relationships, by name, and one without a name for a package that can't be read.

    ``rels`` are the package's own relationships. An XML part has its root's name and number of nodes; with ``schemas`` (by
    format) it goes to the first whose types hold its root, and has that format, its verdict and its typed value as JSON. A
    broken archive or list of content types makes a package NOT_A_PACKAGE, an XML part that is not well-formed makes it
    NOT_WELL_FORMED. A package is opened, parsed and projected in its own row."""
    kind = packages.schema["package_id"].dataType
    out = T.StructType([T.StructField("package_id", kind)]).add("package_verdict", "string").add("reason", "string")
    out = out.add("rels", T._parse_datatype_string(_REL)).add("parts", T._parse_datatype_string(f"array<{_PART}>"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from arborq.functions.checks import judge, root_name
        from arborq.functions.projecting import Layout, as_json, place

        layouts = {name: Layout(schema) for name, schema in (schemas or {}).items()}
        arrow = to_arrow_schema(out)

        def part_row(name, raw, types, parts):
            own, by_extension = types
            last = name.rpartition("/")[2]
            kind = own.get(name) or by_extension.get(last.rpartition(".")[2].lower() if "." in last else "")
            head, _, tail = name.rpartition("/")
            rels = _rels(parts.get(f"{head}/_rels/{tail}.rels"), name)
            typed = kind.endswith("+xml") or kind in ("application/xml", "text/xml") if kind is not None else name.endswith((".xml", ".rels"))
            if not typed:
                return (name, kind, None, None, rels, None, None, None), None
            scan, names, found = judge(raw)
            if found:
                return (name, kind, None, None, rels, None, found[0][3], None), f"{name}: {found[0][4]}"
            local = next(own[1] for n, own in zip(scan.nodes, names, strict=True) if n[2] is None and own)
            for format_, layout in layouts.items():
                if layout.mangled(local)[0] in layout.types:
                    got = place(scan, names, layout)
                    value = as_json(got.value) if got.placed else None
                    return (name, kind, root_name(scan), len(scan.nodes), rels, format_, "INVALID" if got.why else "VALID", value), None
            return (name, kind, root_name(scan), len(scan.nodes), rels, None, "WELL_FORMED", None), None

        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                rows, rels, verdict, reason = [], [], "WELL_FORMED", None
                try:
                    parts = _unzipped(content)
                    types = _types(parts.get(CONTENT_TYPES))
                    rels = _rels(parts.get("/_rels/.rels"), "/")
                    for name in sorted(parts):
                        if name != CONTENT_TYPES and "/_rels/" not in name:
                            row, wrong = part_row(name, parts[name], types, parts)
                            rows.append(row)
                            if wrong and reason is None:
                                verdict, reason = "NOT_WELL_FORMED", wrong
                except ValueError as e:
                    rows, verdict, reason = [], "NOT_A_PACKAGE", str(e)
                columns = [pa.array([verdict], pa.string()), pa.array([reason], pa.string()), pa.array([rels], arrow.field(3).type)]
                fields = [f.name for f in arrow.field(4).type.value_type]
                found = pa.array([[dict(zip(fields, r, strict=True)) for r in rows]], arrow.field(4).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns, found], schema=arrow)

    rows = packages.select("package_id", "content").mapInArrow(run, out)
    each = rows.select("package_id", "package_verdict", "reason", "rels", F.explode_outer("parts").alias("p"))
    names = ("name", "content_type", "root", "nodes", "format", "verdict", "value")
    return each.select("package_id", "package_verdict", "reason", "rels", *[F.col(f"p.{n}").alias(n) for n in names], F.col("p.rels").alias("part_rels"))
