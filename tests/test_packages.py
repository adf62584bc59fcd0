import io
import zipfile

from arborq.operators.parse import parse
from arborq.operators.tree import generate
from arborq.plans.schema import compile_ebnf
from arborq.sources.packages import content_types, parts_of, process_packages, relationships, with_types
from arborq.streaming.documents import process_stream, verdict_counts


def package(bad: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="t"><Default Extension="XML" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/w/d.xml" ContentType="x/y+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="r"><Relationship Id="1" Type="t" Target="w/d.xml"/></Relationships>')
        z.writestr("w/_rels/d.xml.rels", '<Relationships xmlns="r"><Relationship Id="2" Type="t" Target="../m/i.png"/><Relationship Id="3" Type="t" Target="http://x" TargetMode="External"/></Relationships>')
        z.writestr("w/d.xml", "<a:doc xmlns:a='u'/>" if not bad else "<a>")
        z.writestr("m/i.png", b"\x89")
    return out.getvalue()


def test_package(spark):
    packages = spark.createDataFrame([("p", package()), ("q", package(True)), ("broken", b"no zip"), (None, package()), ("none", None)], "package_id string, content binary")
    parts = parts_of(packages)
    assert {r.package_id for r in parts.where("error IS NOT NULL").collect()} == {"broken", "none"}
    own = parts.where("package_id IS NOT NULL")
    typed = {(r.package_id, r.name): r.content_type for r in with_types(own, content_types(own)).collect()}
    assert typed[("p", "/w/d.xml")] == "x/y+xml" and typed[("p", "/m/i.png")] == "image/png" and typed[("p", "/_rels/.rels")] is None
    rels = {(r.package_id, r.id): (r.source_part, r.resolved) for r in relationships(own).collect()}
    assert rels[("p", "1")] == ("/", "/w/d.xml") and rels[("p", "2")] == ("/w/d.xml", "/m/i.png") and rels[("p", "3")][1] is None
    out = [(r.package_id, r.name, r.root, r.package_verdict) for r in process_packages(packages).collect()]
    good = [(k, n, root, "WELL_FORMED") for k in ("p", None) for n, root in (("/m/i.png", None), ("/w/d.xml", "a:doc"))]
    bad = [("q", n, None, "NOT_WELL_FORMED") for n in ("/m/i.png", "/w/d.xml")] + [(k, None, None, "NOT_A_PACKAGE") for k in ("broken", "none")]
    assert sorted(out, key=str) == sorted(good + bad, key=str)


def test_damaged_archives_stop_nothing(spark):
    whole = package()
    cut = [whole[: len(whole) * k // 7] for k in range(7)]
    flipped = [whole[:k] + bytes([whole[k] ^ 255]) + whole[k + 1 :] for k in range(0, len(whole), 5)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cut + flipped)], "package_id int, content binary")
    found = process_packages(rows).groupBy("package_id").count().count()
    assert found == len(cut + flipped) and parts_of(rows).select("package_id").distinct().count() == found


def test_routing_gives_typed_values(spark):
    rows = spark.createDataFrame([("p", package())], "package_id string, content binary")
    schema = compile_ebnf("doc = at_x, [k] ; k = text ;")
    found = {r.name: (r.format, r.verdict, r.value) for r in process_packages(rows, {"own": schema}).collect()}
    assert found["/w/d.xml"] == ("own", "VALID", "{}") and found["/m/i.png"] == (None, None, None)


def test_round_trip(spark):
    """parse(generate(parse(x))) = parse(x) but for the DOCTYPE and where text is split."""
    cases = ['<a b="1 &lt;&quot;">x<c/>y&amp;<d>z</d></a>', '<?xml version="1.0" encoding="latin1"?><!--c--><r xmlns="u" xmlns:p="v"><p:k p:a="1"/><![CDATA[<&]]></r><?p d?>', "<r a='&#9;&#10;'>&#13; t</r>", '<!DOCTYPE r [<!ENTITY e "<k>v</k>">]><r>&e;&e;</r>']
    first = parse(spark.createDataFrame(list(enumerate(cases)), "doc_id int, source string"))
    second = parse(generate(first))

    def canonical(corpus):
        out = {}
        for n in corpus.nodes.orderBy("doc_id", "node_id").collect():
            nodes = out.setdefault(n.doc_id, [])
            if n.kind == "text" and nodes and nodes[-1][0] == "text" and nodes[-1][1] == n.depth:
                nodes[-1] = ("text", n.depth, nodes[-1][2] + n.text, ())
            else:
                nodes.append((n.kind, n.depth, (n.name or "") + (n.text or "") if n.kind != "text" else n.text, tuple((a.name, a.value) for a in n.attrs)))
        return out

    assert canonical(first) == canonical(second) and len(canonical(first)) == len(cases)


def test_stream(spark, tmp_path):
    rows = [(1, "<r/>"), (2, "<r>"), (3, "<a:r/>")]
    spark.createDataFrame(rows, "doc_id int, source string").write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema("doc_id int, source string").parquet(str(tmp_path / "in"))
    process_stream(stream, lambda df, _: got.update({r.doc_id: r.verdict for r in df.collect()}), checkpoint=str(tmp_path / "c")).awaitTermination(120)
    assert got == {1: "WELL_FORMED", 2: "NOT_WELL_FORMED", 3: "NOT_WELL_FORMED"}


def test_counts_by_window(spark, tmp_path):
    sql = "SELECT timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, id AS doc_id, if(id % 3 = 0, '<r>', '<r/>') AS source FROM range(30)"
    spark.sql(sql).write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, doc_id long, source string"
    counts = verdict_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", width="10 minutes")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.begin.minute, r.verdict, r.n) for r in spark.table("counts").collect())
    assert got == [(0, "NOT_WELL_FORMED", 4), (0, "WELL_FORMED", 6), (10, "NOT_WELL_FORMED", 3), (10, "WELL_FORMED", 7), (20, "NOT_WELL_FORMED", 3), (20, "WELL_FORMED", 7)]
