import json

from pyspark.sql import functions as F

from arborq import api
from arborq.sources.text import decoded, illegal_at, line_ends, pseudo_attribute


def test_sql_functions(spark):
    api.register(spark)
    spark.createDataFrame([(1, "<r a='1'>x<k/></r>"), (2, "<r>")], "doc_id int, source string").createOrReplaceTempView("docs")
    got = spark.sql("SELECT doc_id, xml_verdict(source) v, xml_json(source) j FROM docs ORDER BY 1").collect()
    assert [r.v for r in got] == ["WELL_FORMED", "NOT_WELL_FORMED"] and got[1].j is None
    assert json.loads(got[0].j)["root"] == {"name": "r", "attrs": [{"name": "a", "value": "1"}], "contents": [{"text": "x"}, {"child": {"name": "k"}}]}
    assert spark.sql("SELECT d.doc_id, n.name FROM docs d, LATERAL xml_nodes(d.source) n WHERE n.kind = 'element' ORDER BY n.node_id").collect() == [(1, "r"), (1, "k")]


def test_schema_verdicts(spark):
    schema = api.compile_dtd("<!ELEMENT note (to)><!ELEMENT to (#PCDATA)>")
    rows = [(1, "<note><to>x</to></note>"), (2, "<note><cc/></note>"), (3, "<other/>"), (4, "<note>")]
    got = {r.doc_id: (r.verdict, r.root) for r in api.process(spark.createDataFrame(rows, "doc_id int, source string"), schema=schema).collect()}
    assert got == {1: ("VALID", "note"), 2: ("INVALID", None), 3: ("INVALID", None), 4: ("NOT_WELL_FORMED", None)}


def test_open_and_rss(spark):
    rows = [(1, '<rss version="2.0" xmlns:e="u"><channel><title>a<b/>c</title><e:x><y/></e:x></channel></rss>'), (2, '<rss version="2.0"><channel/><channel/></rss>'), (3, "<feed/>")]
    got = {r.doc_id: r.verdict for r in api.process(spark.createDataFrame(rows, "doc_id int, source string"), schema=api.format_schema("rss-2.0")).collect()}
    assert got == {1: "VALID", 2: "INVALID", 3: "INVALID"}
    docx = [(1, '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>hi</w:t></w:r><w:unknown/></w:p></w:body></w:document>')]
    assert [r.text for r in api.project(spark.createDataFrame(docx, "doc_id int, source string"), api.format_schema("docx")).relation("T", ["text"]).collect()] == ["hi"]
    sheets = [(1, '<comments><commentList><comment ref="A1"><text><t>why</t></text></comment></commentList></comments>'), (2, '<theme name="x"><themeElements/></theme>')]
    found = api.project(spark.createDataFrame(sheets, "doc_id int, source string"), api.format_schema("xlsx"))
    assert [r.verdict for r in found.verdicts.collect()] == ["VALID", "VALID"] and [r.text for r in found.relation("T", ["text"]).collect()] == ["why"]


def test_normalisation_columns(spark):
    rows = [("é<".encode("utf-16"),), ("é".encode(),), (b"\xef\xbb\xbfx",), (b'<?xml version="1.1" encoding="latin1"?>\xe9',)]
    got = [r[0] for r in spark.createDataFrame(rows, "s binary").select(decoded(F.col("s"))).collect()]
    assert got[:3] == ["é<", "é", "x"] and got[3].endswith("é")
    t = spark.createDataFrame([("<?xml version='1.1'?>a\r\nb\rc\x01",)], "t string")
    row = t.select(pseudo_attribute(F.col("t"), "version").alias("v"), line_ends(F.col("t")).alias("l"), illegal_at(F.col("t")).alias("i")).first()
    assert row.v == "1.1" and row.l.endswith("a\nb\nc\x01") and row.i == 28


def test_declaration_may_end_late(spark):
    from pyspark.sql import functions as F

    from arborq.functions.scanner import decode
    from arborq.sources.text import decoded, is_v11

    gap = " " * 5000
    latin = f"<?xml version='1.0'{gap}encoding='iso-8859-1'{gap}?><a>\u00e9</a>".encode("latin-1")
    newer = f"<?xml{gap}version='1.1'{gap}?><a/>".encode()
    late = b"<a/>" + b" " * 300 + b"<?xml version='1.1' encoding='latin-1'?>"
    assert decode(latin) == (latin.decode("latin-1"), False)
    assert [decode(x)[1] for x in (newer, newer.decode(), late)] == [True, True, False]
    rows = spark.createDataFrame([(0, latin), (1, newer), (2, late)], "k int, source binary").select("k", decoded(F.col("source")).alias("text")).select("k", "text", is_v11(F.col("text")).alias("v11")).orderBy("k").collect()
    assert [(r.text, r.v11) for r in rows] == [(latin.decode("latin-1"), False), (newer.decode(), True), (late.decode(), False)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_documents_are_judged_and_projected_in_place(spark):
    """No shuffle stands between a document and its verdict, tree, typed value or generated form."""
    df = spark.createDataFrame([(1, "<r><k/></r>")], "doc_id int, source string")
    corpus = api.parse(df, validating=True)
    p = api.project(df, api.compile_ebnf("r = {k} ; k = at_x, text ;"))
    for out in (api.process(df, validating=True), api.verdicts(corpus), corpus.nodes, corpus.attrs, corpus.diagnostics, api.generate(corpus), api.gather_text(corpus), api.coalesce_text(corpus), p.verdicts, p.relation("K", ["x"]), p.unknown, p.typed("R"), api.rss_report(df)):
        assert exchanges(out) == 0


def test_a_feed_of_many_items(spark):
    n = 100_000
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit('<rss version="2.0"><channel><title>t</title>'), F.repeat(F.lit("<item><title>a<b>b</b></title><link>l</link></item>"), n), F.lit("</channel></rss>")).alias("source"))
    p = api.project(df, api.format_schema("rss-2.0"))
    assert p.relation("Title", ["text"]).groupBy("text").count().orderBy("text").collect() == [("ab", n), ("t", 1)]
    assert api.rss_item_count(df).first().n_items == n
    assert api.gather_text(api.parse(df), lambda n: n["name"] == "title").where("text = 'ab'").count() == n


def test_registry_and_replies(spark, tmp_path):
    (tmp_path / "a.dtd").write_text("<!ELEMENT a EMPTY>")
    (tmp_path / "a.ebnf").write_text("a = text ;")
    (tmp_path / "b.xsd").write_text('<xs:schema xmlns:xs="x"><xs:include schemaLocation="c.xsd"/><xs:element name="b"/></xs:schema>')
    (tmp_path / "c.xsd").write_text('<xs:schema xmlns:xs="x"><xs:element name="c" type="xs:string"/></xs:schema>')
    known = api.Registry(str(tmp_path), {"b": {"open": True}})
    assert [f.name for f in known.get("a").types["A"]] == ["text"] and known.get("b").open and known.get("b").has_root("c")
    assert api.compile_schema("a = ", "ebnf").error and api.compile_schema("<!ELEMENT a EMPTY>", "dtd").rows == []
    assert api.compile_schema("<!ELEMENT a " + "(" * 5000 + "b" + ")" * 5000 + ">", "dtd").rows[0][1] == "b"


def test_commands(spark, tmp_path):
    from arborq import cli

    (tmp_path / "a.xml").write_text("<r><k/>t</r>")
    (tmp_path / "b.xml").write_text("<r>")
    (tmp_path / "s.dtd").write_text("<!ELEMENT r (k)><!ELEMENT k EMPTY>")
    (tmp_path / "p.zip").write_bytes(b"none")
    files = str(tmp_path / "*.xml")
    assert sorted(r.verdict for r in cli.run(spark, ["parse", files])[0].collect()) == ["NOT_WELL_FORMED", "WELL_FORMED"]
    assert sorted(r.verdict for r in cli.run(spark, ["parse", "--validate", files])[0].collect()) == ["INVALID", "NOT_WELL_FORMED"]
    assert [r.value for r in cli.run(spark, ["parse", "--schema", str(tmp_path / "s.dtd"), files])[0].orderBy("doc_id").collect()] == ['{"k": {}}', None]
    assert [r.text for r in cli.run(spark, ["parse", "--tokens", str(tmp_path / "a.xml")])[0].collect()] == ["<r>", "<k/>", "t", "</r>"]
    cli.run(spark, ["generate", files, str(tmp_path / "out")])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["<r><k/>t</r>"]
    assert cli.run(spark, ["packages", str(tmp_path / "p.zip")])[0].first().package_verdict == "NOT_A_PACKAGE"
