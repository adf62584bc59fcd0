"""Registered queries: XML made from the driver's tables (with defects by key), run through the engine, and the SQL that
computes the expected rows from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators.namespaces import resolve_elements
from arborq.operators.parse import parse
from arborq.operators.process import process
from arborq.operators.project import mangled, project
from arborq.operators.rss import rss_item_count, rss_warnings
from arborq.operators.validity import validity_diagnostics
from arborq.operators.tree import coalesce_text, escape_attribute, escape_text, gather_text, generate
from arborq.plans.formats import format_schema
from arborq.plans.schema import compile_dtd, compile_xsd


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(df: DataFrame, key: str, sql: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.expr(sql).alias("source"))


def m0_nation_roundtrip(spark, d):
    """Nations as XML, parsed, written, parsed again and read back as columns."""
    first = parse(_docs(_t(spark, d, "nation"), "n_nationkey", "concat('<nation id=\"', n_nationkey, '\" region=\"', n_regionkey, '\"><name>', n_name, '</name></nation>')"))
    corpus = parse(generate(first))
    # both values are read from a nation's own row
    inner = F.get(F.filter("nodes", lambda n: n["name"] == "name"), F.lit(0))
    outer = F.get(F.filter("nodes", lambda n: n["name"] == "nation"), F.lit(0))
    region = F.get(F.filter(outer["attrs"], lambda a: a["name"] == "region"), F.lit(0))["value"]
    return corpus.docs.select(F.col("doc_id").alias("n_nationkey"), corpus.text_of(inner).alias("n_name"), region.cast("int").alias("n_regionkey"))


def _verdict(spark, df, key, sql, validating=False):
    return process(_docs(df, key, sql), validating=validating).select("doc_id", "verdict")


def w1_tag_match_orders(spark, d):
    return _verdict(spark, _t(spark, d, "orders"), "o_orderkey", "concat('<o><p>', o_totalprice, '</', if(o_orderkey % 7 = 0, 'q', 'p'), '></o>')")


def w2_duplicate_attr(spark, d):
    return _verdict(spark, _t(spark, d, "orders"), "o_orderkey", "concat('<o a=\"1\" ', if(o_orderkey % 11 = 0, 'a', 'b'), '=\"2\"/>')")


def w6_char_references(spark, d):
    return _verdict(spark, _t(spark, d, "customer"), "c_custkey", "concat('<c>&#', c_custkey % 40, ';</c>')")


def w12_undeclared_entity(spark, d):
    return _verdict(spark, _t(spark, d, "customer"), "c_custkey", "concat('<!DOCTYPE c [<!ENTITY known \"x\">]><c>&', if(c_custkey % 13 = 0, 'other', 'known'), ';</c>')")


def w14_recursive_entity(spark, d):
    return _verdict(spark, _t(spark, d, "customer"), "c_custkey", "concat('<!DOCTYPE c [<!ENTITY a \"&b;\"><!ENTITY b \"', if(c_custkey % 5 = 0, '&a;', 'x'), '\">]><c>&a;</c>')")


def n5_illegal_characters(spark, d):
    return _verdict(spark, _t(spark, d, "part"), "p_partkey", "concat('<p>', p_name, if(p_partkey % 9 = 0, chr(1), ''), '</p>')")


def x1_nearest_namespace(spark, d):
    """The namespace of an inner element whose prefix is redeclared between it and the root for some keys."""
    src = "concat('<a:r xmlns:a=\"urn:0\"><m', if(c_custkey % 3 = 0, '', concat(' xmlns:a=\"urn:', c_custkey % 3, '\"')), '><a:k/></m></a:r>')"
    el = resolve_elements(parse(_docs(_t(spark, d, "customer"), "c_custkey", src)))
    return el.where("name = 'a:k'").select("doc_id", F.col("ns_uri").alias("uri"))


def x3_undeclared_prefix(spark, d):
    return _verdict(spark, _t(spark, d, "customer"), "c_custkey", "concat('<r xmlns:a=\"u\"><', if(c_custkey % 4 = 0, 'b', 'a'), ':k/></r>')")


def x4_expanded_attribute(spark, d):
    return _verdict(spark, _t(spark, d, "customer"), "c_custkey", "concat('<r xmlns:a=\"u\" xmlns:b=\"', if(c_custkey % 6 = 0, 'u', 'v'), '\" a:x=\"1\" b:x=\"2\"/>')")


_ORDER_DTD = "<!DOCTYPE o [<!ELEMENT o (p,d?)><!ELEMENT p (#PCDATA)><!ELEMENT d EMPTY><!ATTLIST o id ID #REQUIRED s (F|O) #IMPLIED>]>"
_ORDER = f"concat('{_ORDER_DTD}<o', if(o_orderkey % 8 = 0, '', concat(' id=\"o', o_orderkey, '\"')), ' s=\"', o_orderstatus, '\"><p>', o_totalprice, '</', if(o_orderkey % 7 = 0, 'q', 'p'), '>', if(o_orderkey % 5 = 0, '<d/><d/>', '<d/>'), '</o>')"


def verdict_tally(spark, d):
    """Several defects at once; the earliest stage decides."""
    return process(_docs(_t(spark, d, "orders"), "o_orderkey", _ORDER), validating=True).groupBy("verdict").agg(F.count("*").alias("n"))


def v4_content_model(spark, d):
    src = "concat('<!DOCTYPE l [<!ELEMENT l (q,p,(x|y)*)><!ELEMENT q EMPTY><!ELEMENT p EMPTY><!ELEMENT x EMPTY><!ELEMENT y EMPTY>]><l>', if(l_linenumber % 3 = 0, '', '<q/>'), '<p/>', repeat('<x/><y/>', l_linenumber % 4), if(l_linenumber % 5 = 0, '<p/>', ''), '</l>')"
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS k", "l_linenumber").distinct()
    return _verdict(spark, rows, "k", src, validating=True)


def v7_required_attribute(spark, d):
    return _verdict(spark, _t(spark, d, "customer"), "c_custkey", "concat('<!DOCTYPE c [<!ELEMENT c EMPTY><!ATTLIST c n CDATA #REQUIRED>]><c', if(c_custkey % 10 = 0, '', ' n=\"1\"'), '/>')", validating=True)


def v13_enumeration(spark, d):
    return _verdict(spark, _t(spark, d, "orders"), "o_orderkey", "concat('<!DOCTYPE o [<!ELEMENT o EMPTY><!ATTLIST o s (F|O) #IMPLIED>]><o s=\"', o_orderstatus, '\"/>')", validating=True)


def _customers_by_digit(spark, d):
    """One document for each last digit of the key: its customers, some with the attribute value of the one before."""
    c = _t(spark, d, "customer").withColumn("item", F.expr("concat('<c id=\"c', c_custkey - if(c_custkey % 3 = 0, 10, 0), '\"/>')"))
    dtd = "<!DOCTYPE n [<!ELEMENT n (c*)><!ELEMENT c EMPTY><!ATTLIST c id ID #REQUIRED>]>"
    rows = c.groupBy((F.col("c_custkey") % 10).alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list("item")), "").alias("items"))
    return rows.select("doc_id", F.concat(F.lit(dtd + "<n>"), F.col("items"), F.lit("</n>")).alias("source"))


def v9_duplicate_id(spark, d):
    """IDs that stand more than once in a document, as validation finds them."""
    found = validity_diagnostics(parse(_customers_by_digit(spark, d), validating=True)).where("stage = 23 AND ord = 8")
    return found.select("doc_id", F.expr("substring(reason, 11)").alias("id"))


def v10_dangling_idref(spark, d):
    """Orders with an IDREF to their customer, in one document for each priority; customers of one segment are left out."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    dtd = "<!DOCTYPE x [<!ELEMENT x (o,c?)><!ELEMENT o EMPTY><!ELEMENT c EMPTY><!ATTLIST o r IDREF #REQUIRED><!ATTLIST c i ID #REQUIRED>]>"
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return _verdict(spark, rows, "o_orderkey", f"concat('{dtd}<x><o r=\"k', o_custkey, '\"/>', if(c_custkey IS NULL, '', concat('<c i=\"k', c_custkey, '\"/>')), '</x>')", validating=True)


def e4_char_references(spark, d):
    """Text of documents written with references, read back."""
    docs = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<p>&lt;"), F.col("p_name"), F.lit("&#38;&#x41;&gt;&quot;&apos;</p>")).alias("source"))
    corpus = parse(docs)
    return gather_text(corpus).select("doc_id", "text")


def e5_attribute_whitespace(spark, d):
    docs = _t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('<p a="'), F.col("p_name"), F.lit('\n\tx&#9;y"/>')).alias("source"))
    return parse(docs).attrs.select("doc_id", "value")


def g4_escape(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.md5(escape_text(F.col("text"))).alias("as_text"), F.md5(escape_attribute(F.col("text"))).alias("as_attribute"))


def g1_document_roundtrip(spark, d):
    """Whole texts of ``documents`` as XML, generated, parsed and read back."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("<d>"), escape_text(F.col("text")), F.lit("</d>")).alias("source"))
    corpus = parse(generate(parse(docs)))
    return gather_text(corpus).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def t4_subtree_text(spark, d):
    """Text below each region of a tree of regions and nations."""
    n = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<n>"), x["n_name"], F.lit("</n>"))), "").alias("kids"))
    corpus = parse(n.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("<r>"), F.col("kids"), F.lit("</r>")).alias("source")))
    return gather_text(corpus, lambda n: n["name"] == "r").select(F.col("doc_id").alias("regionkey"), "text")


def t6_coalesce_text(spark, d):
    """Runs of text beside an element, each split by a reference, as one."""
    corpus = parse(_docs(_t(spark, d, "part"), "p_partkey", "concat('<p>a', p_size, '&amp;b<k/>c&lt;', p_size, '</p>')"))
    return coalesce_text(corpus).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "|").alias("runs"))


_CUSTOMER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="customer"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string"/>
<xs:element name="acctBal" type="xs:double"/></xs:sequence><xs:attribute name="custKey"/><xs:attribute name="segment"/></xs:complexType></xs:element></xs:schema>"""


def p2_projection_flat(spark, d):
    """Customers as XML, projected by an XSD to a flat relation."""
    src = "concat('<customer custKey=\"', c_custkey, '\" segment=\"', c_mktsegment, '\"><name>', c_name, '</name><acctBal>', cast(c_acctbal AS decimal(12,2)), '</acctBal></customer>')"
    rows = project(_docs(_t(spark, d, "customer"), "c_custkey", src), compile_xsd(_CUSTOMER_XSD)).typed("Customer")
    m = lambda path, name: F.col(f"message.{path}").alias(name)
    return rows.select(F.col("message.cust_key").cast("long").alias("c_custkey"), m("segment", "c_mktsegment"), m("name.text", "c_name"), F.col("message.acct_bal.text").cast("double").alias("c_acctbal"))


def p5_repeat_vs_merge(spark, d):
    """A child that the schema has once, standing up to three times with its own child, and a choice of two: messages merge, the
    last text wins, and the last variant of the choice stays."""
    schema = compile_dtd("<!ELEMENT o (v,(x|y))><!ELEMENT v (w)><!ELEMENT w (#PCDATA)><!ATTLIST w a CDATA #IMPLIED><!ELEMENT x (#PCDATA)><!ELEMENT y (#PCDATA)>")
    src = "concat('<o><v><w a=\"1\">first</w></v>', if(c_custkey % 2 = 0, '<v><w>second</w></v>', ''), if(c_custkey % 3 = 0, '<v><w>third</w></v>', ''), '<x>p</x>', if(c_custkey % 5 = 0, '<y>q</y>', ''), '</o>')"
    p = project(_docs(_t(spark, d, "customer"), "c_custkey", src), schema)
    at = lambda path, name: F.get_json_object("value", f"$.{path}").alias(name)
    return p.docs.select("doc_id", at("v.w.text", "value"), at("v.w.a", "attribute"), at("x.text", "x"), at("y.text", "y"))


def p6_unknown_markup(spark, d):
    schema = compile_dtd("<!ELEMENT o (v*)><!ELEMENT v (#PCDATA)><!ATTLIST o a CDATA #IMPLIED>")
    p = project(_docs(_t(spark, d, "customer"), "c_custkey", "concat('<o ', if(c_custkey % 4 = 0, 'b', 'a'), '=\"1\"><', if(c_custkey % 6 = 0, 'w', 'v'), '/></o>')"), schema)
    return p.verdicts.select("doc_id", "verdict")


def _feeds(spark, d):
    """A feed for each source of ``documents``: items without title and description for some ids, a version for others."""
    item = "concat('<item>', if(doc_id % 4 = 0, '', concat('<title>t', doc_id, '</title>')), if(doc_id % 8 = 0, '<link>l</link>', '<description>x</description>'), '</item>')"
    rows = _t(spark, d, "documents").select(F.substring("source", 4, 9).cast("long").alias("doc_id"), F.struct(F.col("doc_id").alias("k"), F.expr(item).alias("i")).alias("x"))
    head = F.expr("concat('<rss version=\"2.0\"><channel><title>f</title>', if(doc_id % 3 = 0, '', '<link>l</link>'), '<description>d</description>')")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["i"]), "").alias("items")).select("doc_id", F.concat(head, F.col("items"), F.lit("</channel></rss>")).alias("source"))


def p11_rss_conformance(spark, d):
    return rss_warnings(_feeds(spark, d)).groupBy("doc_id").agg(F.count("*").alias("warnings"))


def p12_rss_item_count(spark, d):
    return rss_item_count(_feeds(spark, d))


def p10_rss_rules(spark, d):
    """Verdicts by the RSS schema: wrong versions, unknown markup, namespaced extensions."""
    src = "concat('<rss version=\"', if(c_custkey % 5 = 0, '1.0', '2.0'), '\" xmlns:e=\"u\"><channel><title>t</title><', if(c_custkey % 3 = 0, 'e:x', if(c_custkey % 3 = 1, 'bogus', 'ttl')), '/></channel></rss>')"
    return project(_docs(_t(spark, d, "customer"), "c_custkey", src), format_schema("rss-2.0")).verdicts.select("doc_id", "verdict")


def k17_name_mangling(spark, d):
    names = _t(spark, d, "part").select(F.regexp_replace("p_type", " ", "-").alias("name")).distinct()
    return names.select("name", mangled(F.col("name"), True).alias("type_name"), mangled(F.col("name"), False).alias("field_name"))


def l6_pages_verdict(spark, d):
    """Raw web pages are no XML."""
    return process(_t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))).groupBy("verdict").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    m0_nation_roundtrip, w1_tag_match_orders, w2_duplicate_attr, w6_char_references, w12_undeclared_entity, w14_recursive_entity, n5_illegal_characters, x1_nearest_namespace, x3_undeclared_prefix, x4_expanded_attribute, verdict_tally,
    v4_content_model, v7_required_attribute, v9_duplicate_id, v10_dangling_idref, v13_enumeration, e4_char_references, e5_attribute_whitespace, g1_document_roundtrip, g4_escape, t4_subtree_text, t6_coalesce_text, p2_projection_flat,
    p5_repeat_vs_merge, p6_unknown_markup, p10_rss_rules, p11_rss_conformance, p12_rss_item_count, k17_name_mangling, l6_pages_verdict,
)}


def _bad(key: str, table: str, condition: str, bad: str = "NOT_WELL_FORMED", good: str = "WELL_FORMED") -> str:
    return f"SELECT CAST({key} AS BIGINT) AS doc_id, CASE WHEN {condition} THEN '{bad}' ELSE '{good}' END AS verdict FROM {table}"


_CONTROLS = [(c, f"&#{c};") for c in [*range(1, 9), *range(11, 32), *range(127, 160), 8232]]


def _escape_sql(attribute: bool) -> str:
    """Nested replacements; characters that a text can't hold don't matter."""
    out = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
    out = f"replace({out}, '\"', '&quot;')" if attribute else f"replace({out}, '>', '&gt;')"
    for c, ref in _CONTROLS + ([(9, "&#9;"), (10, "&#10;")] if attribute else []):
        out = f"replace({out}, chr({c}), '{ref}')"
    return out


ORACLE_SQL = {
    "m0_nation_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation",
    "w1_tag_match_orders": _bad("o_orderkey", "orders", "o_orderkey % 7 = 0"),
    "w2_duplicate_attr": _bad("o_orderkey", "orders", "o_orderkey % 11 = 0"),
    "w6_char_references": _bad("c_custkey", "customer", "c_custkey % 40 < 32 AND c_custkey % 40 NOT IN (9, 10, 13)"),
    "w12_undeclared_entity": _bad("c_custkey", "customer", "c_custkey % 13 = 0"),
    "w14_recursive_entity": _bad("c_custkey", "customer", "c_custkey % 5 = 0"),
    "n5_illegal_characters": _bad("p_partkey", "part", "p_partkey % 9 = 0"),
    "x1_nearest_namespace": "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'urn:' || (c_custkey % 3) AS uri FROM customer",
    "x3_undeclared_prefix": _bad("c_custkey", "customer", "c_custkey % 4 = 0"),
    "x4_expanded_attribute": _bad("c_custkey", "customer", "c_custkey % 6 = 0"),
    "verdict_tally": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'NOT_WELL_FORMED' WHEN o_orderkey % 8 = 0 OR o_orderkey % 5 = 0 OR o_orderstatus NOT IN ('F', 'O') THEN 'INVALID' ELSE 'VALID' END AS verdict, count(*) AS n FROM orders GROUP BY 1",
    "v4_content_model": "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS doc_id, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber % 5 = 0 THEN 'INVALID' ELSE 'VALID' END AS verdict FROM lineitem",
    "v7_required_attribute": _bad("c_custkey", "customer", "c_custkey % 10 = 0", "INVALID", "VALID"),
    "v13_enumeration": _bad("o_orderkey", "orders", "o_orderstatus NOT IN ('F', 'O')", "INVALID", "VALID"),
    "v9_duplicate_id": "SELECT c_custkey % 10 AS doc_id, 'c' || (c_custkey - CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END) AS id FROM customer GROUP BY 1, 2 HAVING count(*) > 1",
    "v10_dangling_idref": "SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') THEN 'VALID' ELSE 'INVALID' END AS verdict FROM orders",
    "e4_char_references": "SELECT p_partkey AS doc_id, '<' || p_name || '&A>\"''' AS text FROM part",
    "e5_attribute_whitespace": "SELECT p_partkey AS doc_id, p_name || '  x' || chr(9) || 'y' AS value FROM part",
    "g1_document_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents WHERE text IS NOT NULL",
    "g4_escape": f"SELECT doc_id, md5({_escape_sql(False)}) AS as_text, md5({_escape_sql(True)}) AS as_attribute FROM documents",
    "t4_subtree_text": "SELECT CAST(n_regionkey AS BIGINT) AS regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1",
    "t6_coalesce_text": "SELECT p_partkey AS doc_id, 'a' || p_size || '&b|c<' || p_size AS runs FROM part",
    "p2_projection_flat": "SELECT c_custkey, c_mktsegment, c_name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS c_acctbal FROM customer",
    "p5_repeat_vs_merge": "SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS value, '1' AS attribute, CASE WHEN c_custkey % 5 <> 0 THEN 'p' END AS x, CASE WHEN c_custkey % 5 = 0 THEN 'q' END AS y FROM customer",
    "p6_unknown_markup": _bad("c_custkey", "customer", "c_custkey % 4 = 0 OR c_custkey % 6 = 0", "INVALID", "VALID"),
    "p10_rss_rules": _bad("c_custkey", "customer", "c_custkey % 5 = 0 OR c_custkey % 3 = 1", "INVALID", "VALID"),
    "p11_rss_conformance": "WITH f AS (SELECT CAST(substring(source, 4) AS BIGINT) AS doc_id, count(*) FILTER (WHERE doc_id % 8 = 0) AS bare FROM documents GROUP BY 1) SELECT doc_id, bare + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS warnings FROM f WHERE bare > 0 OR doc_id % 3 = 0",
    "p12_rss_item_count": "SELECT CAST(substring(source, 4) AS BIGINT) AS doc_id, count(*) AS n_items FROM documents GROUP BY 1",
    "k17_name_mangling": "SELECT DISTINCT replace(p_type, ' ', '-') AS name, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || x[2:]), '') AS type_name, lower(replace(p_type, ' ', '_')) AS field_name FROM part",
    "l6_pages_verdict": "SELECT 'NOT_WELL_FORMED' AS verdict, count(*) AS n FROM pages",
}

# the operators that take one table of cases each, and packages
from arborq.plans import cases, package_queries  # noqa: E402

QUERIES |= cases.QUERIES | package_queries.QUERIES
ORACLE_SQL |= cases.ORACLE_SQL | package_queries.ORACLE_SQL
