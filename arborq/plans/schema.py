"""Schema compilers: DTD, EBNF vocabulary or XSD -> types with fields. Runs on the driver; the result is a small table."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from arborq.functions import chars as C
from arborq.functions.scanner import DTD, Rejected, Scan, scan


@dataclass
class Field:
    """A string (attribute, text, child without type) or a message. ``variants`` are those of a repeated or grouped
    choice's wrapper; ``oneof`` numbers the choice that a field belongs to."""

    name: str
    target: str | None = None
    repeated: bool = False
    oneof: int | None = None
    variants: list[Field] = field(default_factory=list)
    attribute: bool = False


@dataclass
class Schema:
    """``types``: fields by type name. ``root``: the only root type allowed, or None for any. ``open`` tolerates all unknown
    markup, ``ns_extensible`` what is in a namespace."""

    types: dict[str, list[Field]]
    root: str | None = None
    ns_extensible: bool = False
    open: bool = False
    pre_validate: Callable | None = None

    def rows(self) -> list[tuple]:
        """``(type, field, ordinal, kind, target, repeated, oneof, wrapper)``; variants name their wrapper."""
        out = []
        for t, fields in self.types.items():
            n = 0
            for f in fields:
                for v, wrapper in [(x, f.name) for x in f.variants] or [(f, None)]:
                    out.append((t, v.name, n, "message" if v.target else "attribute" if v.attribute else "string", v.target, f.repeated or v.repeated, v.oneof, wrapper))
                    n += 1
        return out

    def has_root(self, local: str) -> bool:
        """Whether documents with a root of this local name belong to the schema."""
        return pascal(local) in self.types

    def struct(self, type_name: str, _open: tuple = ()):
        """The Spark type of an element, or None where types refer to themselves."""
        from pyspark.sql import types as T

        if type_name in _open:
            return None
        fields = []
        for f in self.types[type_name]:
            members = []
            for v in f.variants or [f]:
                kind = self.struct(v.target, (*_open, type_name)) if v.target else T.StringType()
                if kind is None:
                    return None
                members.append(T.StructField(v.name, T.ArrayType(kind) if v.repeated and not f.variants else kind))
            fields += members if not f.variants else [T.StructField(f.name, T.ArrayType(T.StructType(members)) if f.repeated else T.StructType(members))]
        return T.StructType(fields)


class SchemaError(ValueError):
    pass


def words(name: str) -> list[str]:
    """Parts of a name: cut at ``- _`` blank, and between a lower and an upper letter."""
    return [w for w in re.split(r"[-_ ]|(?<=[a-z0-9])(?=[A-Z])", name) if w]


def pascal(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in words(name))


def snake(name: str) -> str:
    return "_".join(w.lower() for w in words(name))


# ------------------------------------------------------------- particles: ("seq"|"alt", items) ("rep"|"opt", item) ("ref", name) ("text",)


class _Lowering:
    def __init__(self, declared: set[str]):
        self.declared = declared

    def leaf(self, node) -> Field:
        if node[0] == "ref" and node[1] in self.declared:
            return Field(snake(node[1]), pascal(node[1]))
        return Field("text" if node[0] == "text" else snake(node[1]))

    def fields(self, node, attributes: list[Field] = ()) -> list[Field]:
        self.groups = 0
        out = list(attributes)
        if node is not None:
            self._add(node, out)
        seen: dict[str, int] = {}
        for f in out:
            seen[f.name] = seen.get(f.name, 0) + 1
            if seen[f.name] > 1:
                f.name = f"{f.name}_{seen[f.name]}"
        return out

    def _members(self, node) -> list[Field]:
        """Leaves of a choice: nested choices and occurrences fold in, repeated names merge."""
        out: dict[tuple, Field] = {}

        def visit(n):
            if n[0] in ("ref", "text"):
                f = self.leaf(n)
                out.setdefault((f.name, f.target), f)
            elif n[0] in ("opt", "rep"):
                visit(n[1])
            else:
                for x in n[1]:
                    visit(x)

        visit(node)
        return list(out.values())

    def _add(self, node, out: list[Field]):
        kind = node[0]
        if kind in ("ref", "text"):
            out.append(self.leaf(node))
        elif kind == "seq":
            for x in node[1]:
                self._add(x, out)
        elif kind == "opt":
            self._add(node[1], out)
        elif kind == "alt":
            if len(node[1]) == 1:
                return self._add(node[1][0], out)
            self.groups += 1
            for f in self._members(node):
                f.oneof = self.groups
                out.append(f)
        else:  # rep
            inner = node[1]
            while inner[0] in ("opt", "rep") or inner[0] in ("seq", "alt") and len(inner[1]) == 1:
                inner = inner[1] if inner[0] in ("opt", "rep") else inner[1][0]
            if inner[0] in ("ref", "text"):
                f = self.leaf(inner)
                f.repeated = True
                out.append(f)
            elif inner[1]:
                out.append(Field("entry" if inner[0] == "alt" else "seq1", repeated=True, variants=self._members(inner)))


_MODEL_TOKEN = re.compile(f"({C.NAME})|[(),|?*+]")


def parse_model(model: str):
    """Particle tree of a content model without white space; groups of one item are that item, however deep."""
    groups: list[list] = [[",", []]]
    for m in _MODEL_TOKEN.finditer(model):
        token, items = m[0], groups[-1][1]
        if m[1]:
            items.append(("ref", token))
        elif token == "(":
            groups.append([",", []])
        elif token == ")":
            sep, own = groups.pop()
            groups[-1][1].append(own[0] if len(own) == 1 else ("seq" if sep == "," else "alt", own))
        elif token in "?*+":
            items[-1] = ("opt" if token == "?" else "rep", items[-1])
        else:
            groups[-1][0] = token
    return groups[0][1][0]


def compile_dtd(source: str) -> Schema:
    """Types of an external subset (bare declarations); the first declaration of a name binds."""
    try:
        dtd = DTD(source, bare=True)
    except Rejected as e:
        raise SchemaError(str(e)) from None
    elements = {}
    for _, name, kind, model in dtd.elements:
        elements.setdefault(name, (kind, model))
    if not elements:
        raise SchemaError("no element declarations")
    attributes: dict[str, list[str]] = {}
    for _, element, name, *_ in dtd.attlists:
        own = attributes.setdefault(element, [])
        if name not in own:
            own.append(name)
    lower = _Lowering(set(elements))
    types = {}
    for name in sorted(elements):
        kind, model = elements[name]
        attrs = [Field(snake(a), attribute=True) for a in sorted(attributes.get(name, ()))]
        if kind == "MIXED":
            names = [x for x in re.split(r"[()|*]", model) if x and x != "#PCDATA"]
            node = ("rep", ("alt", [("text",), *(("ref", x) for x in names)])) if names else ("text",)
        else:
            node = parse_model(model) if kind == "CHILDREN" else None
        types[pascal(name)] = lower.fields(node, attrs)
    return Schema(types)


_TOKEN = re.compile(r"\(\*.*?\*\)|\s+|([A-Za-z_][A-Za-z0-9_:.-]*)|(\"[^\"]*\"|'[^']*')|([=,;|()\[\]{}])", re.S)


def compile_ebnf(source: str) -> Schema:
    """Types of a vocabulary of rules ``name = body ;``: ``at_x`` is attribute x; ``text`` and names without a rule are strings;
    ``e:text`` is an element of that name."""
    tokens, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise SchemaError(f"bad grammar at {at}")
        at = m.end()
        if m.lastindex:
            tokens.append(m[m.lastindex])
    rules: dict[str, object] = {}
    pos = 0

    def alternatives():
        nonlocal pos
        items = [sequence()]
        while pos < len(tokens) and tokens[pos] == "|":
            pos += 1
            items.append(sequence())
        return ("alt", items) if len(items) > 1 else items[0]

    def sequence():
        nonlocal pos
        items = []
        while pos < len(tokens) and tokens[pos] not in ";|)]}":
            if tokens[pos] == ",":
                pos += 1
                continue
            token = tokens[pos]
            pos += 1
            if token in "([{":
                inner = alternatives()
                if pos >= len(tokens) or tokens[pos] != {"(": ")", "[": "]", "{": "}"}[token]:
                    raise SchemaError("group without end")
                pos += 1
                items.append(inner if token == "(" else ("opt" if token == "[" else "rep", inner))
            elif token[0] not in "\"'":
                items.append(("text",) if token == "text" else ("ref", token.removeprefix("e:")))
        return ("seq", items)

    while pos < len(tokens):
        name = tokens[pos]
        if pos + 1 >= len(tokens) or tokens[pos + 1] != "=":
            raise SchemaError(f"rule expected at {name}")
        pos += 2
        rules[name.removeprefix("e:")] = alternatives()
        if pos >= len(tokens) or tokens[pos] != ";":
            raise SchemaError(f"rule {name} has no end")
        pos += 1
    if not rules:
        raise SchemaError("no rules")
    lower = _Lowering(set(rules))
    types = {}
    for name, node in rules.items():
        fields = lower.fields(node)
        for f in fields:
            if f.name.startswith("at_") and not f.target:
                f.name, f.attribute = f.name[3:], True
        types[pascal(name)] = fields
    return Schema(types)


# ------------------------------------------------------------------------------------------------ XSD


class _Element:
    def __init__(self, s: Scan, node):
        self.scan, self.node = s, node
        self.local = node[7].split(":")[-1]
        self.attrs = {a[1]: a[2] for a in node[9]}

    def children(self):
        return [_Element(self.scan, n) for n in self.scan.nodes if n[2] == self.node[0] and n[6] == "element"]

    def child(self, *names):
        return next((c for c in self.children() if c.local in names), None)

    def inside(self):
        return [_Element(self.scan, n) for n in self.scan.nodes[self.node[0] + 1 : self.node[1] + 1] if n[6] == "element"]


def _local(name: str) -> str:
    return name.split(":")[-1]


def file_resolver(base: str) -> Callable[[str], str | None]:
    """Reads imports below a folder; empty locations and URLs are left out."""
    import pathlib

    def read(location: str):
        if not location or "://" in location:
            return None
        path = pathlib.Path(base) / location
        return path.read_text() if path.is_file() else None

    return read


def compile_xsd(source: str, resolver: Callable[[str], str | None] = lambda _: None) -> Schema:
    """Types of all named elements anywhere in a schema and what it includes or imports; the first of a local name counts.
    What ``resolver`` doesn't find or can't be read is left out."""

    def root_of(text: str):
        s = scan(text)
        if s.verdict:
            raise SchemaError(s.reason)
        root = _Element(s, next(n for n in s.nodes if n[6] == "element"))
        if root.local != "schema":
            raise SchemaError("not a schema")
        return root

    roots, visited, queue = [root_of(source)], set(), []
    queue = [roots[0]]
    while queue:
        for c in queue.pop(0).children():
            location = c.attrs.get("schemaLocation", "")
            if c.local in ("include", "import") and location not in visited:
                visited.add(location)
                text = resolver(location)
                if text is not None:
                    try:
                        roots.append(root_of(text))
                        queue.append(roots[-1])
                    except SchemaError:
                        pass
    named: dict[str, dict[str, _Element]] = {k: {} for k in ("complexType", "simpleType", "group", "attributeGroup")}
    elements: dict[str, _Element] = {}
    substitutes: dict[str, list[str]] = {}
    for root in roots:
        for c in root.children():
            if c.local in named and "name" in c.attrs:
                named[c.local].setdefault(c.attrs["name"], c)
            if c.local == "element" and "substitutionGroup" in c.attrs:
                substitutes.setdefault(_local(c.attrs["substitutionGroup"]), []).append(c.attrs.get("name", ""))
        for c in root.inside():
            if c.local == "element" and "name" in c.attrs:
                elements.setdefault(c.attrs["name"], c)

    def occurs(c: _Element, node):
        if c.attrs.get("maxOccurs", "") not in ("", "0", "1"):
            return ("rep", node)
        return ("opt", node) if c.attrs.get("minOccurs") == "0" else node

    def attributes(c: _Element, seen=()) -> list[Field]:
        out = []
        for x in c.children():
            if x.local == "attribute" and "name" in x.attrs:
                out.append(Field(snake(x.attrs["name"]), attribute=True))
            elif x.local == "attributeGroup" and "ref" in x.attrs:
                ref = _local(x.attrs["ref"])
                if ref not in seen and ref in named["attributeGroup"]:
                    out += attributes(named["attributeGroup"][ref], (*seen, ref))
        return out

    def group(c: _Element, seen=()):
        items = [x for x in (member(m, seen) for m in c.children()) if x is not None]
        return ("alt" if c.local == "choice" else "seq", items) if items else None

    def member(m: _Element, seen):
        if m.local == "element":
            if "ref" in m.attrs:
                ref = _local(m.attrs["ref"])
                node = ("alt", [("ref", x) for x in (ref, *substitutes[ref])]) if ref in substitutes else ("ref", ref)
            else:
                node = ("ref", m.attrs.get("name", ""))
            return occurs(m, node)
        if m.local == "group" and "ref" in m.attrs:
            ref = _local(m.attrs["ref"])
            if ref in seen or ref not in named["group"]:
                return None
            inner = named["group"][ref].child("sequence", "choice", "all")
            node = group(inner, (*seen, ref)) if inner else None
        elif m.local in ("sequence", "choice", "all"):
            node = group(m, seen)
        else:
            return None
        return occurs(m, node) if node else None

    def complex_type(c: _Element, lower: _Lowering) -> list[Field]:
        body, simple = c, c.child("simpleContent")
        content = simple or c.child("complexContent")
        if content:
            body = content.child("extension", "restriction") or content
        inner = body.child("sequence", "choice", "all", "group")
        node = ("text",) if simple else member(inner, ()) if inner else None
        return lower.fields(node, attributes(body))

    lower = _Lowering(set(elements))
    types = {}
    for name, c in elements.items():
        inline, kind = c.child("complexType"), _local(c.attrs.get("type", ""))
        if inline:
            fields = complex_type(inline, lower)
        elif c.child("simpleType"):
            fields = [Field("text")]
        elif kind in named["complexType"]:
            fields = complex_type(named["complexType"][kind], lower)
        else:
            fields = [Field("text")] if kind else []
        types.setdefault(pascal(name), fields)
    if not types:
        raise SchemaError("no elements")
    return Schema(types)


def compile_source(source: str, language: str = "ebnf", **flags) -> Schema:
    """Compiles by language (``dtd``, ``xsd``, else EBNF); flags are those of :class:`Schema`."""
    resolver = flags.pop("resolver", None)
    try:
        if language == "dtd":
            schema = compile_dtd(source)
        elif language == "xsd":
            schema = compile_xsd(source, resolver or (lambda _: None))
        else:
            schema = compile_ebnf(source)
    except RecursionError:
        raise SchemaError("nested too deeply") from None
    for k, v in flags.items():
        setattr(schema, k, v)
    return schema


@dataclass
class CompileReply:
    """The schema, or what is wrong with its source; ``rows`` describes its types."""

    schema: Schema | None
    error: str = ""

    @property
    def rows(self) -> list[tuple]:
        return self.schema.rows() if self.schema else []


def compile_schema(source: str, language: str = "ebnf", **flags) -> CompileReply:
    """Compiles without raising: an error stands in the reply."""
    try:
        return CompileReply(compile_source(source, language, **flags))
    except SchemaError as e:
        return CompileReply(None, str(e))


#: Endings of files that hold a format's schema, in the order they are looked for, and their languages.
ENDINGS = ((".ebnf", "ebnf"), (".xsd", "xsd"), (".dtd", "dtd"))


class Registry:
    """Schemas by name, compiled on first use: from files ``<name>.ebnf``, ``.xsd`` or ``.dtd`` below a folder, or added.
    ``flags``: those of :class:`Schema` for a name."""

    def __init__(self, folder: str | None = None, flags: dict[str, dict] | None = None):
        self.folder, self.flags, self.known = folder, flags or {}, {}

    def add(self, name: str, schema: Schema) -> None:
        self.known[name] = schema

    def get(self, name: str) -> Schema:
        if name not in self.known:
            import pathlib

            for ending, language in ENDINGS if self.folder else ():
                path = pathlib.Path(self.folder) / f"{name}{ending}"
                if path.is_file():
                    more = {"resolver": file_resolver(self.folder)} if language == "xsd" else {}
                    self.known[name] = compile_source(path.read_text(), language, **more, **self.flags.get(name, {}))
                    break
            else:
                raise KeyError(f"unknown format {name}")
        return self.known[name]
