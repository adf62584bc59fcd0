"""Schema compilers (driver side) and what they give for known shapes."""

import pytest

from arborq.plans.formats import format_schema
from arborq.plans.schema import SchemaError, compile_dtd, compile_ebnf, compile_xsd, pascal, snake

XS = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'


def shape(schema, name):
    return [(f.name, f.target, f.repeated, [v.name for v in f.variants]) for f in schema.types[name]]


def test_names():
    assert [pascal(x) for x in ("pPr", "a-b", "text_input")] == ["PPr", "AB", "TextInput"]
    assert [snake(x) for x in ("isPermaLink", "isPermalink", "pPr")] == ["is_perma_link", "is_permalink", "p_pr"]


def test_dtd():
    s = compile_dtd("<!ELEMENT note (to,body?,(x|y)*)><!ELEMENT to (#PCDATA)><!ELEMENT body (#PCDATA|to)*><!ELEMENT x EMPTY><!ELEMENT y EMPTY><!ATTLIST note b CDATA #IMPLIED a CDATA #IMPLIED>")
    assert shape(s, "Note") == [("a", None, False, []), ("b", None, False, []), ("to", "To", False, []), ("body", "Body", False, []), ("entry", None, True, ["x", "y"])]
    assert shape(s, "Body") == [("entry", None, True, ["text", "to"])]
    assert shape(s, "To") == [("text", None, False, [])]
    with pytest.raises(SchemaError):
        compile_dtd("<!-- none -->")


def test_ebnf():
    s = compile_ebnf("a = at_id, {b | c}, [d] ; b = text ; c = at_x, text ;")
    assert shape(s, "A") == [("id", None, False, []), ("entry", None, True, ["b", "c"]), ("d", None, False, [])]


def test_xsd_groups_and_substitution():
    s = compile_xsd(
        XS + '<xs:group name="g"><xs:sequence><xs:element name="u" type="xs:string"/></xs:sequence></xs:group><xs:attributeGroup name="ag"><xs:attribute name="k"/></xs:attributeGroup>'
        '<xs:element name="head" type="xs:string"/><xs:element name="sub" substitutionGroup="head" type="xs:string"/>'
        '<xs:element name="r"><xs:complexType><xs:sequence><xs:group ref="g"/><xs:element ref="head" maxOccurs="unbounded"/><xs:any/></xs:sequence><xs:attributeGroup ref="ag"/></xs:complexType></xs:element></xs:schema>'
    )
    assert shape(s, "R") == [("k", None, False, []), ("u", "U", False, []), ("entry", None, True, ["head", "sub"])]


def test_xsd_import():
    files = {"b.xsd": XS + '<xs:element name="b" type="xs:string"/></xs:schema>', "bad.xsd": "<nope/>"}
    s = compile_xsd(XS + '<xs:import schemaLocation="b.xsd"/><xs:include schemaLocation="bad.xsd"/><xs:include schemaLocation="none"/><xs:element name="a"><xs:complexType><xs:sequence><xs:element ref="b"/></xs:sequence></xs:complexType></xs:element></xs:schema>', files.get)
    assert shape(s, "A") == [("b", "B", False, [])] and "B" in s.types


def test_formats():
    assert len(format_schema("rss-2.0").types) == 33
    assert format_schema("docx").struct("Document") is None  # tables hold tables
    assert format_schema("xlsx").struct("Table") is not None
    with pytest.raises(KeyError):
        format_schema("none")
