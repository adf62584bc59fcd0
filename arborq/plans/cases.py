"""Registered queries, one for each check and step: documents made from the keys of ``customer``, some of them with a defect,
and the SQL that says by the key what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborq.operators.namespaces import resolve_attributes
from arborq.operators.parse import parse
from arborq.operators.process import process
from arborq.operators.project import project
from arborq.operators.tokens import tokens
from arborq.operators.tree import gather_text, generate
from arborq.plans.schema import compile_dtd, compile_ebnf, compile_schema, compile_xsd
from arborq.sources.text import decoded, is_v11, line_ends, pseudo_attribute

N, I, X = "NOT_WELL_FORMED", "INVALID", "CANNOT_VALIDATE"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _lit(s: str) -> str:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(a, b)
    return f"'{s}'"


def _customers(spark, d, source: str):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("doc_id"), F.expr(source).alias("source"))


def _verdict_case(name: str, before: str, bad: str, good: str, after: str, mod: int, verdict: str = N, validating: bool = False, binary: bool = False):
    """Registers a query of verdicts: documents ``before + bad + after`` where ``mod`` divides the key, else with ``good``."""
    lit = (lambda s: f"X'{s.encode('latin-1').hex().upper()}'") if binary else _lit
    source = f"concat({lit(before)}, if(k % {mod} = 0, {lit(bad)}, {lit(good)}), {lit(after)})"

    def query(spark, d):
        return process(_customers(spark, d, source), validating=validating).select("doc_id", "verdict")

    query.__name__ = name
    QUERIES[name] = query
    right = "VALID" if validating else "WELL_FORMED"
    ORACLE_SQL[name] = f"SELECT c_custkey AS doc_id, CASE WHEN c_custkey % {mod} = 0 THEN '{verdict}' ELSE '{right}' END AS verdict FROM customer"


def _dtd(body: str, root: str = "r") -> str:
    return f"<!DOCTYPE {root} [{body}]>"


_EL = "<!ELEMENT r (a,b?)><!ELEMENT a (#PCDATA)><!ELEMENT b EMPTY>"

# input
_verdict_case("n1_byte_order_mark", "", "\xff<r/>", "\xff\xfe<\0r\0/\0>\0", "", 3, binary=True)
_verdict_case("n1_utf8_mark", "", "\xef\xbb<r/>", "\xef\xbb\xbf<r/>", "", 3, binary=True)
_verdict_case("n2_declared_latin1", "<?xml version='1.0' encoding='", "utf-8", "ISO-8859-1", "'?><r>\xe9</r>", 4, binary=True)
_verdict_case("n4_version", "<?xml version='1.", "0", "1", "'?><r>&#1;</r>", 3)
# lexing and grammar
_verdict_case("l1_nmtoken", "<!DOCTYPE r [<!ATTLIST r a (x|", "&", "1-y", ") #IMPLIED>]><r/>", 5)
_verdict_case("l2_names", "<", "1r", "r1", "/>", 4)
_verdict_case("l3_character_data", "<r a='", "<", "&gt;>", "'>t</r>", 6)
_verdict_case("l4_until", "<r><!--a", "--b", "-b", "--></r>", 5)
_verdict_case("l5_balanced_doctype", "<!DOCTYPE r [<!-- ]> --><!ENTITY e ']>'>", "", "]", "><r/>", 7)
_verdict_case("l6_structure", "<r a='1'", "b='2'", " b='2'", "/>", 3)
_verdict_case("l7_doctype_grammar", "<!DOCTYPE r [<!ELEMENT r (a,b", "|", ",", "c)>]><r/>", 4)
# well-formedness
_verdict_case("w3_section_end", "<r>a]]", ">", "&gt;", "</r>", 5)
_verdict_case("w4_pi_target", "<r><?", "xMl", "xml-x", " d?></r>", 6)
_verdict_case("w5_dtd_pi_target", "<!DOCTYPE r [<?", "XML", "x", " d?>]><r/>", 6)
_verdict_case("w7_public_id", "<!DOCTYPE r PUBLIC '-//a", "{", "+", "' 's'><r/>", 7)
_verdict_case("w8_literal_reference", "<!DOCTYPE r [<!ENTITY e 'a", "&b", "&b;", "'>]><r/>", 4)
_verdict_case("w8_literal_percent", "<!DOCTYPE r [<!ENTITY e '5", "%", "&#37;", "'>]><r/>", 4)
_verdict_case("w9_literal_character", "<!DOCTYPE r [<!ENTITY e '&#", "8", "9", ";'>]><r/>", 3)
_verdict_case("w10_default_entity", "<!DOCTYPE r [<!ENTITY e 'x'><!ATTLIST r a CDATA '&", "f", "e", ";'>]><r/>", 5)
_verdict_case("w11_declared_before", "<!DOCTYPE r [", "<!ATTLIST r a CDATA '&e;'><!ENTITY e 'x'>", "<!ENTITY e 'x'><!ATTLIST r a CDATA '&e;'>", "]><r/>", 6)
_verdict_case("w13_unparsed", "<!DOCTYPE r [<!NOTATION n SYSTEM 'n'><!ENTITY e SYSTEM 's' ", "NDATA n", "", ">]><r>&e;</r>", 4)
_verdict_case("w15_external_in_attribute", "<!DOCTYPE r [<!ENTITY x SYSTEM 's'><!ENTITY e '", "&x;", "x", "'>]><r a='&e;'/>", 4)
_verdict_case("w16_less_than_by_entity", "<!DOCTYPE r [<!ENTITY e '", "<", "&gt;", "'>]><r a='&e;'/>", 5)
_verdict_case("w17_entity_content", "<!DOCTYPE r [<!ENTITY e '<k>", "", "</k>", "'>]><r>&e;</r>", 3)
_verdict_case("w18_single_root", "<r/>", "<r/>", "<!--c-->", "", 8)
# namespaces
_verdict_case("x5_reserved", "<r xmlns:", "xmlns", "y", "='u'/>", 5)
_verdict_case("x5_undeclared_in_10", "<r xmlns:a='u'><k xmlns", ":a", "", "=''/></r>", 4)
_verdict_case("x6_qname", "<r xmlns:a='u'><a:", "b:", "", "k/></r>", 4)
_verdict_case("x7_colons", "<r><?p", ":", "", "q d?></r>", 6)
_verdict_case("x7_entity_name", "<!DOCTYPE r [<!ENTITY a", ":", "-", "b 'x'>]><r/>", 6)
# entities
_verdict_case("e9_first_declaration", "<!DOCTYPE r [<!ENTITY e '", "<", "x", "'><!ENTITY e 'y'>]><r a='&e;'/>", 4)
_verdict_case("e10_scan", "<!DOCTYPE r [<!ENTITY e '", "&e;", "<![CDATA[&e;]]>", "'>]><r>&e;</r>", 5)
_verdict_case("e1_long_reference", "<r>&#" + "0" * 400, "9" * 30, "65", ";</r>", 9)
# validity
_verdict_case("v0_external_subset", "<!DOCTYPE r ", "SYSTEM 's'", "[<!ELEMENT r EMPTY>]", "><r/>", 5, X, True)
_verdict_case("v1_root", _dtd("<!ELEMENT r EMPTY><!ELEMENT s EMPTY>") + "<", "s", "r", "/>", 4, I, True)
_verdict_case("v2_element_declared", _dtd("<!ELEMENT r ANY><!ELEMENT k EMPTY>") + "<r><", "z", "k", "/></r>", 3, I, True)
_verdict_case("v3_mixed_content", _dtd("<!ELEMENT r (#PCDATA|a)*><!ELEMENT a EMPTY><!ELEMENT b EMPTY>") + "<r>t<", "b", "a", "/>u</r>", 4, I, True)
_verdict_case("v3_empty", _dtd("<!ELEMENT r EMPTY>") + "<r>", "x", "<!--c-->", "</r>", 4, I, True)
_verdict_case("v5_character_data", _dtd(_EL) + "<r>", "x", " \n", "<a/></r>", 4, I, True)
_verdict_case("v6_attribute_declared", _dtd("<!ELEMENT r EMPTY><!ATTLIST r a CDATA #IMPLIED>") + "<r ", "b", "a", "='1'/>", 5, I, True)
_verdict_case("v8_fixed", _dtd("<!ELEMENT r EMPTY><!ATTLIST r a NMTOKENS #FIXED ' x  y '>") + "<r a='", "y x", "  x y", "'/>", 5, I, True)
_verdict_case("v9_id_name", _dtd("<!ELEMENT r EMPTY><!ATTLIST r a ID #IMPLIED>") + "<r a='", "1x", "x1", "'/>", 5, I, True)
_verdict_case("v9_id_unique", _dtd("<!ELEMENT r (k,k)><!ELEMENT k EMPTY><!ATTLIST k i ID #REQUIRED>") + "<r><k i='a'/><k i='", "a", "b", "'/></r>", 6, I, True)
_verdict_case("v10_idrefs", _dtd("<!ELEMENT r (k*)><!ELEMENT k EMPTY><!ATTLIST k i ID #IMPLIED r IDREFS #IMPLIED>") + "<r><k r='a ", "c", "b", "'/><k i='a'/><k i='b'/></r>", 6, I, True)
_verdict_case("v11_nmtokens", _dtd("<!ELEMENT r EMPTY><!ATTLIST r a NMTOKENS #IMPLIED>") + "<r a='x ", "?", "-1", "'/>", 5, I, True)
_verdict_case("v12_entity_attribute", _dtd("<!ELEMENT r EMPTY><!NOTATION n SYSTEM 'n'><!ENTITY e SYSTEM 's' NDATA n><!ENTITY f 'x'><!ATTLIST r a ENTITY #IMPLIED>") + "<r a='", "f", "e", "'/>", 5, I, True)
_verdict_case("v13_notation", _dtd("<!ELEMENT r EMPTY><!NOTATION n SYSTEM 'n'><!ATTLIST r a NOTATION (n) #IMPLIED>") + "<r a='", "m", "n", "'/>", 5, I, True)
_verdict_case("v14_twice_declared", "<!DOCTYPE r [<!ELEMENT r EMPTY><!ELEMENT ", "r", "s", " ANY>]><r/>", 5, I, True)
_verdict_case("v14_mixed_twice", "<!DOCTYPE r [<!ELEMENT a EMPTY><!ELEMENT r (#PCDATA|a|", "a", "b", ")*>]><r/>", 5, I, True)
_verdict_case("v14_default", "<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r a NMTOKEN '", "x y", "xy", "'>]><r/>", 5, I, True)
_verdict_case("v14_notation_declared", "<!DOCTYPE r [<!ELEMENT r EMPTY><!NOTATION n SYSTEM 'n'><!ENTITY e SYSTEM 's' NDATA ", "m", "n", ">]><r/>", 5, I, True)
_verdict_case("v15_two_ids", "<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r a ID #IMPLIED b ", "ID", "CDATA", " #IMPLIED>]><r/>", 4, I, True)
_verdict_case("v15_id_default", "<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r a ID ", "'x'", "#IMPLIED", ">]><r/>", 4, I, True)
_verdict_case("v17_nested_model", _dtd("<!ELEMENT r ((a|(b,c))+,(a?,b)*)><!ELEMENT a EMPTY><!ELEMENT b EMPTY><!ELEMENT c EMPTY>") + "<r><a/><b/><c/>", "<c/>", "<b/>", "</r>", 4, I, True)
_verdict_case("v4_ambiguous_model", _dtd("<!ELEMENT r ((a|b)*,(a|b)*,a,(a|b))><!ELEMENT a EMPTY><!ELEMENT b EMPTY>") + "<r>" + "<a/><b/>" * 40, "<b/>", "<a/>", "<b/></r>", 4, I, True)
_verdict_case("e7_parameter_entities", "<!DOCTYPE r [<!ENTITY % d \"<!ELEMENT r ", "(a)", "EMPTY", ">\">%d;]><r/>", 4, I, True)
_verdict_case("e8_last_definition", "<!DOCTYPE r [<!ENTITY % d \"<!ELEMENT r (a)>\"><!ENTITY % d \"<!ELEMENT r ", "(b)", "EMPTY", ">\">%d;]><r/>", 4, I, True)


def _query(sql: str):
    """Registers a query of other columns with its SQL (over ``customer``, the key as k)."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.replace("FROM c", "FROM (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer)")
        return f

    return add


@_query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE WHEN n_nationkey % 4 = 0 THEN 'INVALID' ELSE 'VALID' END AS verdict FROM nation")
def v4_long_content(spark, d):
    """Elements with 24,000 children and more, one document for each nation."""
    dtd = _lit(_dtd("<!ELEMENT r ((x|y)*,z?)><!ELEMENT x EMPTY><!ELEMENT y EMPTY><!ELEMENT z EMPTY>"))
    source = f"concat({dtd}, '<r>', repeat('<x/><y/>', 12000 + n_nationkey), '<z/>', if(n_nationkey % 4 = 0, '<x/>', ''), '</r>')"
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.expr(source).alias("source"))
    return process(rows, validating=True).select("doc_id", "verdict")


@_query("SELECT CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 7 ELSE k END AS doc_id, CASE WHEN k % 3 = 0 THEN 'NOT_WELL_FORMED' ELSE 'WELL_FORMED' END AS verdict FROM c")
def s1_null_and_repeated_ids(spark, d):
    """Each row has its own verdict, whatever its id."""
    rows = _customers(spark, d, "if(k % 3 = 0, '<r>', '<r/>')").withColumn("doc_id", F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 7 ELSE doc_id END"))
    return process(rows).select("doc_id", "verdict")


@_query("SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN '1.1' ELSE '1.0' END AS version, CASE WHEN k % 3 = 0 THEN 'latin1' ELSE '' END AS encoding, k % 2 = 0 AS v11 FROM c")
def n3_pseudo_attributes(spark, d):
    rows = _customers(spark, d, "concat('<?xml version=\"1.', if(k % 2 = 0, '1', '0'), '\"', if(k % 3 = 0, ' encoding=\"latin1\"', ''), '?><r/>')")
    return rows.select("doc_id", pseudo_attribute(F.col("source"), "version").alias("version"), pseudo_attribute(F.col("source"), "encoding").alias("encoding"), is_v11(F.col("source")).alias("v11"))


@_query("SELECT k AS doc_id, 'a' || chr(10) || 'b' || chr(10) || CASE WHEN k % 2 = 0 THEN chr(10) ELSE chr(133) END || 'c' AS text, 'x' || chr(10) || 'y' AS folded FROM c")
def n6_line_ends(spark, d):
    """Line ends as the scan and the column function fold them."""
    corpus = parse(_customers(spark, d, "concat('<?xml version=\"1.', if(k % 2 = 0, '1', '0'), '\"?><r>a\\r\\nb\\r', decode(X'C285', 'UTF-8'), 'c</r>')"))
    return gather_text(corpus).withColumn("folded", line_ends(F.lit("x\r\ny"))).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\nc"), F.lit("\n\nc"))).otherwise(F.col("text")).alias("text"), "folded")


@_query("SELECT k AS doc_id, chr(233) || c_name AS text FROM c")
def n1_decoded(spark, d):
    """Binary input of three encodings as the column function decodes it."""
    text = F.concat(F.lit("\u00e9"), F.col("c_name"))
    utf16 = F.concat(F.expr("X'FFFE'"), F.encode(text, "UTF-16LE"))
    marked = F.concat(F.expr("X'EFBBBF'"), F.encode(text, "UTF-8"))
    source = F.when(F.col("c_custkey") % 3 == 0, utf16).when(F.col("c_custkey") % 3 == 1, marked).otherwise(F.encode(text, "UTF-8"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), source.alias("source"))
    return rows.select("doc_id", decoded(F.col("source")).alias("text"))


@_query("SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'urn:a' END AS uri, 'x' AS local FROM c")
def x2_attribute_namespaces(spark, d):
    """A prefixed attribute has its prefix's namespace, one without a prefix none; declarations are no attributes (X8)."""
    corpus = parse(_customers(spark, d, "concat('<r xmlns=\"urn:d\" xmlns:a=\"urn:a\" ', if(k % 2 = 0, 'a:', ''), 'x=\"1\"/>')"))
    return resolve_attributes(corpus).select("doc_id", F.col("ns_uri").alias("uri"), "local")


@_query("SELECT k AS doc_id, unnest(range(0, 1 + k % 3)) AS node_id, 0 AS n FROM c")
def x8_declarations_are_no_data(spark, d):
    corpus = parse(_customers(spark, d, "concat('<r xmlns=\"u\">', repeat('<k xmlns:p=\"v\"/>', cast(k % 3 AS int)), '</r>')"))
    data = F.size(F.filter("attrs", lambda a: (a["prefix"] != "xmlns") & (a["name"] != "xmlns")))
    return corpus.nodes.select("doc_id", F.col("node_id").cast("long").alias("node_id"), data.alias("n"))


@_query("SELECT k AS doc_id, 'x' || k || '<' || k || 'x' AS text FROM c")
def e1_expansion(spark, d):
    """Entities in entities, five deep, with references."""
    inner = "".join(f"<!ENTITY e{i} \"&e{i + 1};\">" for i in range(5))
    return gather_text(parse(_customers(spark, d, f"concat({_lit('<!DOCTYPE r [' + inner)}, '<!ENTITY e5 \"x&#38;#60;', k, '\">]><r>x', k, '&#60;', k, 'x</r>')"))).select("doc_id", "text")


@_query("SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS elements, 'v' || k AS text FROM c")
def e3_content_entities(spark, d):
    """An entity that holds an element gives nodes; one of text gives text."""
    corpus = parse(_customers(spark, d, "concat('<!DOCTYPE r [<!ENTITY e \"', if(k % 2 = 0, concat('<k>v', k, '</k>'), concat('v', k)), '\">]><r>&e;</r>')"))
    of_root = F.get(F.filter("nodes", lambda n: n["parent_id"].isNull()), F.lit(0))
    return corpus.docs.select("doc_id", F.size(F.filter("nodes", lambda n: n["kind"] == "element")).alias("elements"), corpus.text_of(of_root).alias("text"))


@_query("SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'x y' ELSE ' x  y ' END AS value FROM c")
def e6_tokenised(spark, d):
    return parse(_customers(spark, d, "concat('<!DOCTYPE r [<!ATTLIST r a ', if(k % 2 = 0, 'NMTOKENS', 'CDATA'), ' #IMPLIED>]><r a=\" x  y \"/>')")).attrs.select("doc_id", "value")


@_query("SELECT k AS doc_id, '<?xml version=\"1.0\"' || CASE WHEN k % 2 = 0 THEN ' encoding=\"UTF-8\"' ELSE '' END || '?><!--c--><r a=\"&quot;' || k || '\"><e/><?p d?>t</r>' AS source FROM c")
def g2_generate(spark, d):
    """Declaration, comment, instruction, empty element and quotes as they are written (G2, G3, G7)."""
    return generate(parse(_customers(spark, d, "concat('<?xml version=\"1.0\"', if(k % 2 = 0, ' encoding=\"latin1\"', ''), '?><!--c--><r a=\\'\"', k, '\\'><e></e><?p   d?>t</r>')")))


@_query("SELECT k AS doc_id, unnest([0, 1, 2, 3]) AS node_id, unnest(['r', NULL, 'p', 'k']) AS name, unnest([NULL, 0, 0, 0]) AS parent_id, unnest([0, 0, 1, 2]) AS sib_pos, unnest([NULL, 'a' || k, 'd ', NULL]) AS text FROM c")
def t1_nodes(spark, d):
    """Node rows of a document: kinds in order, positions among siblings, instruction data without its leading blanks (T1-T3)."""
    return parse(_customers(spark, d, "concat('<r>a', k, '<?p  d ?><k/></r>')")).nodes.select("doc_id", "node_id", "name", "parent_id", "sib_pos", "text")


@_query("SELECT k AS doc_id, 'v' || k AS value FROM c WHERE k % 3 <> 0")
def t5_lookup(spark, d):
    """Children by name and attributes by local name."""
    corpus = parse(_customers(spark, d, "concat('<r xmlns:p=\"u\"><', if(k % 3 = 0, 'j', 'k'), ' p:id=\"v', k, '\"/></r>')"))
    found = corpus.each(lambda n: (n["local"] == "k") & (n["depth"] == 1), value=lambda n: F.get(F.filter(n["attrs"], lambda a: a["local"] == "id"), F.lit(0))["value"])
    return found.select("doc_id", "value")


@_query("SELECT k AS doc_id, unnest(['comment', 'start', 'text', 'reference', 'empty', 'end']) AS kind, unnest(['<!--c-->', '<r a=\">\">', 't' || k, '&amp;', '<k/>', '</r>']) AS text FROM c")
def l6_tokens(spark, d):
    """The pieces of documents."""
    return tokens(_customers(spark, d, "concat('<!--c--><r a=\">\">t', k, '&amp;<k/></r>')")).select("doc_id", "kind", "text")


_NOTE = "<!ELEMENT note (to,body?)><!ELEMENT to (#PCDATA)><!ELEMENT body (p*)><!ELEMENT p (#PCDATA|b)*><!ELEMENT b (#PCDATA)><!ATTLIST note id CDATA #IMPLIED>"


def _project(spark, d, source: str, schema):
    return project(_customers(spark, d, source), schema)


@_query("SELECT k AS doc_id, CASE WHEN k % 5 = 0 THEN 'INVALID' ELSE 'VALID' END AS verdict, CASE WHEN k % 5 <> 0 THEN 'note' END AS root FROM c")
def p1_project(spark, d):
    return _project(spark, d, "concat('<', if(k % 5 = 0, 'other', 'note'), '><to>x</to></', if(k % 5 = 0, 'other', 'note'), '>')", compile_dtd(_NOTE)).verdicts.select("doc_id", "verdict", "root")


@_query("SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN NULL ELSE ' a' || k || 'c' END AS text FROM c")
def p3_leaf_rule(spark, d):
    """A leaf's value is all text in it, as it stands; blank text is no value, and markup in it isn't looked at."""
    schema = compile_ebnf("r = [l] ; l = text ;")
    return _project(spark, d, "concat('<r><l>', if(k % 3 = 0, ' \\n', concat(' a', k, '<zz y=\"1\"/><zz>c</zz>')), '</l></r>')", schema).relation("L", ["text"]).select("doc_id", "text")


@_query("SELECT k AS doc_id, unnest(['a', 'b', 'c']) AS name, unnest([NULL, 'entry', NULL]) AS wrapper FROM c")
def p4_placement(spark, d):
    """A plain field comes before a wrapper's variant."""
    schema = compile_ebnf("r = {b | c}, [a], [c] ; a = text ; b = text ; c = text ;")
    return _project(spark, d, "concat('<r><a>', k, '</a><b/><c/></r>')", schema).placed.where("parent_id IS NOT NULL").select("doc_id", "name", "wrapper")


@_query("SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN 'INVALID' ELSE 'VALID' END AS verdict FROM c")
def p7_foreign_markup(spark, d):
    """What is in a namespace is passed over whole, with what lies in it, even where its local name is known."""
    schema = compile_ebnf("r = [a] ; a = [b] ; b = text ;")
    schema.ns_extensible = True
    return _project(spark, d, "concat('<r xmlns:x=\"u\"><x:a x:q=\"1\"><zz/></x:a><', if(k % 4 = 0, 'q', 'a'), ' x:y=\"2\"/></r>')", schema).verdicts.select("doc_id", "verdict")


@_query("SELECT k AS doc_id, unnest([1, 2]) AS node_id, unnest(['r>z', 'a@q']) AS what FROM c")
def p9_unknown_markup(spark, d):
    return _project(spark, d, "concat('<r><z><y/></z><a q=\"', k, '\"/></r>')".replace("<z><y/></z><a", "<z/><a"), compile_ebnf("r = [a] ; a = at_p, [b] ; b = text ;")).unknown


@_query("SELECT k AS doc_id, 'v' || k AS text FROM c")
def p13_local_names(spark, d):
    return _project(spark, d, "concat('<w:r xmlns:w=\"u\"><w:l>v', k, '</w:l></w:r>')", compile_ebnf("r = [l] ; l = text ;")).relation("L", ["text"]).select("doc_id", "text")


@_query("SELECT k AS doc_id, 'x' || k AS first, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n FROM c")
def s9_typed_json(spark, d):
    """The typed value of a document, as JSON and as VARIANT."""
    p = _project(spark, d, "concat('<note id=\"1\"><to>t</to><body><p>x', k, '</p>', if(k % 2 = 0, '<p>y</p>', ''), '</body></note>')", compile_ebnf("note = at_id, to, [body] ; to = text ; body = {p} ; p = text ;"))
    first = F.variant_get(p.variant(), "$.body.p[0].text", "string").alias("first")
    return p.docs.select("doc_id", first, F.json_array_length(F.get_json_object("value", "$.body.p")).alias("n"))


def _schema_case(name: str, make, rows: list[tuple]):
    """Registers the table of a compiled schema with what it must hold: (type, field, target, repeated, wrapper)."""

    def query(spark, d):
        found = [(r[0], r[1], r[4], r[5], r[7]) for r in make().rows()]
        return spark.createDataFrame(found, "type string, field string, target string, repeated boolean, wrapper string")

    query.__name__ = name
    QUERIES[name] = query
    sql = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    values = ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)
    ORACLE_SQL[name] = f"SELECT CAST(type AS VARCHAR) AS type, field, CAST(target AS VARCHAR) AS target, repeated, CAST(wrapper AS VARCHAR) AS wrapper FROM (VALUES {values}) t(type, field, target, repeated, wrapper)"


_XS = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{}</xs:schema>'
_schema_case("k2_compile_dtd", lambda: compile_dtd("<!ELEMENT a (b*,c?)><!ELEMENT b (#PCDATA)><!ATTLIST a y CDATA #IMPLIED x CDATA #IMPLIED>"), [("A", "x", None, False, None), ("A", "y", None, False, None), ("A", "b", "B", True, None), ("A", "c", None, False, None), ("B", "text", None, False, None)])
_schema_case("k3_mixed_content", lambda: compile_dtd("<!ELEMENT a (#PCDATA|b)*><!ELEMENT b EMPTY>"), [("A", "text", None, True, "entry"), ("A", "b", "B", True, "entry")])
_schema_case("k4_particles", lambda: compile_dtd("<!ELEMENT a ((b|c),(b|d)*)><!ELEMENT b EMPTY><!ELEMENT c EMPTY><!ELEMENT d EMPTY>"), [("A", "b", "B", False, None), ("A", "c", "C", False, None), ("A", "b", "B", True, "entry"), ("A", "d", "D", True, "entry")])
_schema_case("k6_undeclared_child", lambda: compile_dtd("<!ELEMENT a (z+)>"), [("A", "z", None, True, None)])
_schema_case("k7_compile_grammar", lambda: compile_ebnf("a = at_id, {b}, [c] ; b = text ;"), [("A", "id", None, False, None), ("A", "b", "B", True, None), ("A", "c", None, False, None), ("B", "text", None, False, None)])
_schema_case("k8_compile_xsd", lambda: compile_xsd(_XS.format('<xs:element name="a"><xs:complexType><xs:sequence><xs:element name="b" type="xs:string" maxOccurs="9"/></xs:sequence><xs:attribute name="i"/></xs:complexType></xs:element>')), [("A", "i", None, False, None), ("A", "b", "B", True, None), ("B", "text", None, False, None)])
_schema_case("k9_imports", lambda: compile_xsd(_XS.format('<xs:include schemaLocation="o"/><xs:import schemaLocation="none"/><xs:element name="a"><xs:complexType><xs:sequence><xs:element ref="b"/></xs:sequence></xs:complexType></xs:element>'), {"o": _XS.format('<xs:element name="b" type="xs:int"/>')}.get), [("A", "b", "B", False, None), ("B", "text", None, False, None)])
_schema_case("k11_derivation", lambda: compile_xsd(_XS.format('<xs:complexType name="t"><xs:complexContent><xs:restriction base="u"><xs:sequence><xs:element name="x" type="xs:string"/></xs:sequence></xs:restriction></xs:complexContent></xs:complexType><xs:element name="a" type="t"/>')), [("X", "text", None, False, None), ("A", "x", "X", False, None)])
_schema_case("k12_attribute_groups", lambda: compile_xsd(_XS.format('<xs:attributeGroup name="g"><xs:attribute name="p"/><xs:attributeGroup ref="g"/></xs:attributeGroup><xs:element name="a"><xs:complexType><xs:attributeGroup ref="g"/><xs:anyAttribute/></xs:complexType></xs:element>')), [("A", "p", None, False, None)])
_schema_case("k13_groups", lambda: compile_xsd(_XS.format('<xs:group name="g"><xs:choice><xs:element name="x" type="xs:string"/><xs:element name="y" type="xs:string"/></xs:choice></xs:group><xs:element name="a"><xs:complexType><xs:group ref="g" maxOccurs="unbounded"/></xs:complexType></xs:element>')), [("X", "text", None, False, None), ("Y", "text", None, False, None), ("A", "x", "X", True, "entry"), ("A", "y", "Y", True, "entry")])
_schema_case("k15_substitution", lambda: compile_xsd(_XS.format('<xs:element name="h" type="xs:string"/><xs:element name="m" substitutionGroup="h" type="xs:string"/><xs:element name="a"><xs:complexType><xs:sequence><xs:element ref="h"/></xs:sequence></xs:complexType></xs:element>')), [("H", "text", None, False, None), ("M", "text", None, False, None), ("A", "h", "H", False, None), ("A", "m", "M", False, None)])


@_query("SELECT 'dtd' AS language, 'no element declarations' AS error UNION ALL SELECT 'xsd', 'not a schema' UNION ALL SELECT 'ebnf', 'no rules'")
def k19_compile_errors(spark, d):
    """Errors of compilation stand in the reply."""
    rows = [(x, compile_schema(source, x).error) for x, source in (("dtd", "<!ENTITY e 'x'>"), ("xsd", "<a/>"), ("ebnf", " "))]
    return spark.createDataFrame(rows, "language string, error string")
