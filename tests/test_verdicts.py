"""Labelled documents in both modes: (source, verdict when validating, verdict when not)."""

from arborq.operators.process import process

EL = "<!ELEMENT r (k)><!ELEMENT k EMPTY>"
V, I, N, W, X = "VALID", "INVALID", "NOT_WELL_FORMED", "WELL_FORMED", "CANNOT_VALIDATE"
CASES = [
    (f"<!DOCTYPE r [{EL}]><r><k/></r>", V, W),
    ("<!DOCTYPE r [<!ELEMENT r (k+,m?)><!ELEMENT k EMPTY><!ELEMENT m EMPTY>]><r><k/><k/><m/></r>", V, W),
    ('<!DOCTYPE r [<!ELEMENT r (#PCDATA)><!ATTLIST r n ID #IMPLIED>]><r n="q1">txt</r>', V, W),
    ('<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r c (red|blue) "red">]><r/>', V, W),
    ('<!DOCTYPE r [<!ELEMENT r (k)><!ELEMENT k EMPTY><!ENTITY z "<k/>">]><r>&z;</r>', V, W),
    ('<!DOCTYPE r [<!ENTITY % d "<!ELEMENT r EMPTY>">%d;]><r/>', V, W),
    ('<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r xmlns CDATA #IMPLIED>]><r xmlns="urn:t"/>', V, W),
    ('<!DOCTYPE q:r [<!ELEMENT q:r EMPTY><!ATTLIST q:r xmlns:q CDATA #IMPLIED>]><q:r xmlns:q="urn:t"/>', V, W),
    (f"<!DOCTYPE r [{EL}]><r><z/></r>", I, W),
    (f"<!DOCTYPE r [{EL}]><r>t<k/></r>", I, W),
    ("<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r n ID #REQUIRED>]><r/>", I, W),
    ('<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r v CDATA #FIXED "on">]><r v="off"/>', I, W),
    ("<!DOCTYPE r [<!ELEMENT r EMPTY>]><s/>", I, W),
    ("<r/>", I, W),
    ('<!DOCTYPE r [<!ELEMENT r (#PCDATA)><!ATTLIST r n ID #IMPLIED>]><r n="x:y">txt</r>', I, W),
    ("<r></s>", N, N),
    ("<r>&q;</r>", N, N),
    ('<r p="1" p="1"/>', N, N),
    ("<a:b:r/>", N, N),
    ("<w:r/>", N, N),
    ('<r xmlns:xmlns="urn:t"/>', N, N),
    ('<!DOCTYPE r [<!ELEMENT r EMPTY><!ENTITY x:y "t">]><r/>', N, N),
    ("<?x:y d?><r/>", N, N),
    ("<r>]]></r>", N, N),
    ("<r>\x01</r>", N, N),
    ('<?xml version="1.1"?><r>&#1;</r>', I, W),
    ('<!DOCTYPE r SYSTEM "x"><r/>', X, W),
    ("<!DOCTYPE r [<!ELEMENT r EMPTY>%u;]><r/>", X, W),
    ('<!DOCTYPE r [<!ELEMENT r EMPTY><!ATTLIST r n IDREF #IMPLIED>]><r n="none"/>', I, W),
    ('<!DOCTYPE r [<!ELEMENT r (k,k)><!ELEMENT k EMPTY><!ATTLIST k n ID #IMPLIED>]><r><k n="a"/><k n="a"/></r>', I, W),
    ("<!DOCTYPE r [<!ELEMENT r EMPTY><!ELEMENT r EMPTY>]><r/>", I, W),
    ('<r xmlns:a="u"><b xmlns:a=""/></r>', N, N),
    ('<?xml version="1.1"?><r xmlns:a="u"><b xmlns:a=""/></r>', I, W),
    ('<r xmlns:a="u" xmlns:b="u" a:x="1" b:x="2"/>', N, N),
    ('<!DOCTYPE r [<!ENTITY a "&b;"><!ENTITY b "&a;">]><r>&a;</r>', N, N),
    ("", N, N),
    (None, N, N),
]


def test_both_modes(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id int, source string")
    for validating, want in ((True, 1), (False, 2)):
        got = {r.doc_id: r for r in process(df, validating=validating).collect()}
        wrong = [(CASES[i][0], CASES[i][want], got[i].verdict, got[i].reason) for i in range(len(CASES)) if got[i].verdict != CASES[i][want]]
        assert not wrong


def test_bytes(spark):
    rows = [(1, "<r>é</r>".encode("utf-16")), (2, '<?xml version="1.0" encoding="latin1"?><r>é</r>'.encode("latin-1")), (3, b"\xef\xbb\xbf<r/>"), (4, b"<r>\xff</r>")]
    got = {r.doc_id: r.verdict for r in process(spark.createDataFrame(rows, "doc_id int, source binary")).collect()}
    assert got == {1: W, 2: W, 3: W, 4: N}


def test_hard_documents_stop_nothing(spark):
    """Long references, deep entities, empty entities by the billion, deep models and elements, and ids that repeat or are null."""
    chain = "".join(f'<!ENTITY e{i} "&e{i + 1};">' for i in range(3000)) + '<!ENTITY e3000 "x">'
    grow = lambda first: f'<!ENTITY a "{first}">' + "".join(f'<!ENTITY {chr(98 + i)} "{("&" + chr(97 + i) + ";") * 10}">' for i in range(20))
    deep = "(" * 4000 + "k" + ")" * 4000
    rows = [
        (1, "<a>&#" + "9" * 5000 + ";</a>", N, N),
        (1, "<a>&#x" + "0" * 5000 + "41;</a>", I, W),
        (None, f"<!DOCTYPE a [{chain}]><a b='&e0;'>&e0;</a>", I, W),
        (None, f"<!DOCTYPE a [{grow('')}]><a b='&t;'>&t;</a>", I, W),
        (2, f"<!DOCTYPE a [{grow('x' * 9)}]><a>&t;</a>", "LIMIT_EXCEEDED", "LIMIT_EXCEEDED"),
        (2, f"<!DOCTYPE r [<!ELEMENT r {deep}><!ELEMENT k EMPTY>]><r><k/></r>", V, W),
        (3, "<a>" * 50_000 + "</a>" * 50_000, I, W),
        (3, "<a>" + "x&amp;" * 50_000 + "</a>", I, W),
        (4, "<!DOCTYPE r [<!ELEMENT r ((x|y)*,(x|y)*,x)><!ELEMENT x EMPTY><!ELEMENT y EMPTY>]><r>" + "<x/><y/>" * 10_000 + "<x/></r>", V, W),
        (4, "<!DOCTYPE r [<!ELEMENT r ((x|y)*,(x|y)*,x)><!ELEMENT x EMPTY><!ELEMENT y EMPTY>]><r>" + "<x/><y/>" * 10_000 + "</r>", I, W),
    ]
    df = spark.createDataFrame([(r[0], i, r[1]) for i, r in enumerate(rows)], "doc_id int, n int, source string")
    for validating, want in ((True, 2), (False, 3)):
        got = {r.n: (r.doc_id, r.verdict) for r in process(df, validating=validating, keep=["n"]).collect()}
        assert got == {i: (r[0], r[want]) for i, r in enumerate(rows)}
    raised = process(df.where("n = 4"), limit=100).first()
    assert raised.verdict == "LIMIT_EXCEEDED"
