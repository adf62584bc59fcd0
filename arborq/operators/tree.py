"""Trees as rows: descendant text, canonical form and generation of documents, all inside a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import Corpus

_TEXT_CONTROLS = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\u2028]"
_ATTR_CONTROLS = "[\\x00-\\x1f\\x7f-\\x9f\\u2028]"


def _as_references(c: Column, pattern: str) -> Column:
    each = F.transform(F.split(c, ""), lambda x: F.when(x.rlike(pattern), F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).otherwise(x))
    return F.when(c.rlike(pattern), F.array_join(each, "")).otherwise(c)


def escape_text(c: Column) -> Column:
    """``& < >`` as entities; control characters but tab and line feed as references."""
    return _as_references(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), _TEXT_CONTROLS)


def escape_attribute(c: Column) -> Column:
    """``& < "`` as entities; all control characters, tab and line feed too, as references."""
    return _as_references(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), _ATTR_CONTROLS)


def gather_text(corpus: Corpus, keep=None) -> DataFrame:
    """``(doc_id, node_id, text)``: text and CDATA inside each element (that ``keep(node struct)`` holds for), in order. Null
    without any. An element's text is a stretch of its document's character data, so this is linear in what it gives."""
    wanted = (lambda n: (n["kind"] == "element") & keep(n)) if keep is not None else (lambda n: n["kind"] == "element")
    return corpus.each(wanted, node_id=lambda n: n["node_id"], text=lambda n: F.when(n["text_len"] > 0, corpus.text_of(n)))


def coalesce_text(corpus: Corpus) -> DataFrame:
    """``(doc_id, parent_id, node_id, text)``: neighbouring text nodes of a parent as one, empty ones left out."""
    own = {c: (lambda n, c=c: n[c]) for c in ("parent_id", "node_id")}
    return corpus.each(lambda n: (n["run_len"] > 0) & n["parent_id"].isNotNull(), **own, text=lambda n: corpus.text_of(n, "run_len"))


def children(nodes: DataFrame, name: str) -> DataFrame:
    """Child elements of a name, with their parents' ids."""
    return nodes.where((F.col("kind") == "element") & (F.col("name") == name))


def generate(corpus: Corpus) -> DataFrame:
    """``(doc_id, source)`` of every document that has a root: declaration, prolog, root and epilog.

    Elements without children are written empty. An encoding that was declared becomes UTF-8; the DOCTYPE is not written.
    Begins and ends of nodes are sorted in the document's own row."""

    def begin(n: Column) -> Column:
        attrs = F.array_join(F.transform(n["attrs"], lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escape_attribute(a["value"]), F.lit('"'))), "")
        leaf = n["end_id"] == n["node_id"]
        data = F.when(n["text"] == "", "").otherwise(F.concat(F.lit(" "), n["text"]))
        return (
            F.when(n["kind"] == "element", F.concat(F.lit("<"), n["name"], attrs, F.when(leaf, "/>").otherwise(">")))
            .when(n["kind"] == "text", escape_text(corpus.text_of(n)))
            .when(n["kind"] == "cdata", F.concat(F.lit("<![CDATA["), corpus.text_of(n), F.lit("]]>")))
            .when(n["kind"] == "comment", F.concat(F.lit("<!--"), n["text"], F.lit("-->")))
            .otherwise(F.concat(F.lit("<?"), n["name"], data, F.lit("?>")))
        )

    event = lambda at, end, up, s: F.struct(at.alias("at"), F.lit(end).alias("end"), up.alias("up"), s.alias("s"))
    starts = F.transform("nodes", lambda n: event(n["node_id"], 0, F.lit(0), begin(n)))
    closed = F.filter("nodes", lambda n: (n["kind"] == "element") & (n["end_id"] > n["node_id"]))
    ends = F.transform(closed, lambda n: event(n["end_id"], 1, -n["depth"], F.concat(F.lit("</"), n["name"], F.lit(">"))))
    body = F.array_join(F.transform(F.sort_array(F.concat(starts, ends)), lambda e: e["s"]), "")
    declared = lambda name, value: F.when(F.col(name) != "", F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")
    parts = [declared("version", F.col("version")), declared("encoding", F.lit("UTF-8")), declared("standalone", F.col("standalone"))]
    decl = F.when(F.col("version") != "", F.concat(F.lit("<?xml"), *parts, F.lit("?>"))).otherwise("")
    return corpus.docs.where("verdict IS NULL AND size(nodes) > 0").select("doc_id", F.concat(decl, body).alias("source"))
