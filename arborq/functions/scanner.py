"""The one Python pass over a document: bytes -> node rows, declaration rows and the first scan error.

Pure Python, without Spark and without recursion over elements or entities. Names are resolved, and validity is judged,
from these rows in the same task (see :mod:`.checks`): a document's rows never leave it to be related to each other."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from . import chars as C

#: Characters that the entities of one document may expand to by default; with more it is LIMIT_EXCEEDED.
MAX_EXPANSION = 5_000_000
MAX_PE_ROUNDS = 64

_S = re.compile(C.SPACE + "+")
_OPT_S = re.compile(C.SPACE + "*")
_NAME = re.compile(C.NAME)
_NMTOKEN = re.compile(C.NMTOKEN)
_ILLEGAL = {False: re.compile(C.ILLEGAL_10), True: re.compile(C.ILLEGAL_11)}
_REFERENCE = re.compile(f"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|({C.NAME}));")
_MARKUP = re.compile("[<&]")
_PIECE = re.compile(f"<!\\[CDATA\\[.*?\\]\\]>|<!--.*?-->|{_REFERENCE.pattern}", re.S)
_DECL = re.compile(
    "<\\?xml(?:\\s+version\\s*=\\s*(?:'(1\\.[0-9]+)'|\"(1\\.[0-9]+)\"))(?:\\s+encoding\\s*=\\s*(?:'([A-Za-z][A-Za-z0-9._-]*)'|\"([A-Za-z][A-Za-z0-9._-]*)\"))?"
    "(?:\\s+standalone\\s*=\\s*(?:'(yes|no)'|\"(yes|no)\"))?\\s*\\?>".replace("\\s", C.SPACE)
)


class Rejected(Exception):
    """The document is not well-formed."""


class LimitExceeded(Exception):
    """The document's entities expand beyond the limit; nothing is said about the rest of it."""


class CannotValidate(Exception):
    """Validity can't be judged without what lies outside the document."""


@dataclass
class Scan:
    """Rows of one document. ``nodes``: (node_id, end_id, parent_id, depth, sib_pos, region, kind, name, text, attrs) in
    pre-order, with ``attrs`` (pos, name, value)."""

    version: str = ""
    encoding: str = ""
    standalone: str = ""
    v11: bool = False
    verdict: str | None = None
    reason: str | None = None
    nodes: list = field(default_factory=list)
    root_type: str | None = None
    external_subset: bool = False
    elements: list = field(default_factory=list)
    attlists: list = field(default_factory=list)
    entities: list = field(default_factory=list)
    notations: list = field(default_factory=list)
    dtd: object = None


# ---------------------------------------------------------------- input normalisation


def declared(head: str, name: str) -> str:
    """The pseudo-attribute in an XML declaration: what stands between the next two quotes behind the name."""
    if not head.startswith("<?xml"):
        return ""
    end = head.find("?>")
    at = head.find(name, 0, end) if end >= 0 else -1
    if at < 0:
        return ""
    quotes = [i for i in range(at + len(name), end) if head[i] in "'\""]
    return head[quotes[0] + 1 : quotes[1]] if len(quotes) > 1 else ""


def decode(source: bytes | str) -> tuple[str, bool]:
    """Text without byte order mark, line ends as they are; and whether it is XML 1.1. Invalid UTF-8 is rejected."""
    if isinstance(source, str):
        text = source.removeprefix("\ufeff")
    elif source[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw = source[2 : len(source) - (len(source) % 2)]
        text = raw.decode("utf-16-le" if source[0] == 0xFF else "utf-16-be", "replace")
    else:
        raw = source.removeprefix(b"\xef\xbb\xbf")
        head = raw[: raw.find(b"?>") + 2].decode("latin-1") if raw.startswith(b"<?xml") else ""
        if declared(head, "encoding").lower() in ("iso-8859-1", "latin-1", "latin1"):
            text = raw.decode("latin-1")
        else:
            try:
                text = raw.decode()
            except UnicodeDecodeError as e:
                raise Rejected(f"illegal byte at offset {e.start}") from None
    return text, declared(text, "version") == "1.1"


def line_ends(text: str, v11: bool) -> str:
    text = text.replace("\r\n", "\n")
    if v11:
        text = text.replace("\r\u0085", "\n").replace("\u0085", "\n").replace("\u2028", "\n")
    return text.replace("\r", "\n")


# ---------------------------------------------------------------- declarations


class DTD:
    """Declarations of a DOCTYPE body (``r [ .. ]``) or, with ``bare``, of an external subset."""

    def __init__(self, text: str, bare: bool = False):
        self.text, self.at = text, 0
        self.root = self.system = self.public = None
        self.internal = ""
        self.elements, self.attlists, self.entities, self.notations, self.targets = [], [], [], [], []
        self.has_pe = False
        self.order = 0
        if bare:
            self._declarations(len(text))
            return
        self._space()
        self.root = self._name()
        save = self.at
        if self._space() and self._looking("SYSTEM", "PUBLIC"):
            self.public, self.system = self._external()
        else:
            self.at = save
        self._space()
        if self._take("["):
            begin, end = self.at, text.rfind("]")
            if end < begin:
                raise Rejected("malformed DOCTYPE")
            self.internal = text[begin:end]
            self._declarations(end)
            self._need("]")
        self._space()
        if self.at != len(text):
            raise Rejected("malformed DOCTYPE")

    def _space(self) -> bool:
        m = _OPT_S.match(self.text, self.at)
        self.at = m.end()
        return m.end() > m.start()

    def _must_space(self):
        if not self._space():
            raise Rejected("malformed DOCTYPE: white space expected")

    def _looking(self, *words) -> bool:
        return any(self.text.startswith(w, self.at) for w in words)

    def _take(self, word: str) -> bool:
        if self.text.startswith(word, self.at):
            self.at += len(word)
            return True
        return False

    def _need(self, word: str):
        if not self._take(word):
            raise Rejected(f"malformed DOCTYPE: {word} expected")

    def _match(self, pattern) -> str:
        m = pattern.match(self.text, self.at)
        if not m:
            raise Rejected("malformed DOCTYPE: name expected")
        self.at = m.end()
        return m[0]

    def _name(self) -> str:
        return self._match(_NAME)

    def _literal(self) -> str:
        quote = self.text[self.at : self.at + 1]
        end = self.text.find(quote, self.at + 1) if quote in ("'", '"') and quote else -1
        if end < 0:
            raise Rejected("malformed DOCTYPE: literal expected")
        out = self.text[self.at + 1 : end]
        self.at = end + 1
        return out

    def _external(self, need_system: bool = True):
        if self._take("SYSTEM"):
            self._must_space()
            return None, self._literal()
        self._need("PUBLIC")
        self._must_space()
        public = self._literal()
        if not re.fullmatch(C.PUBID, public):
            raise Rejected("illegal character in public identifier")
        save = self.at
        if self._space() and self._looking("'", '"'):
            return public, self._literal()
        if need_system:
            raise Rejected("malformed DOCTYPE: system literal expected")
        self.at = save
        return public, None

    def _declarations(self, end: int):
        while self.at < end:
            self.order += 1
            if self._space():
                continue
            if self._take("%"):
                self._name()
                self._need(";")
                self.has_pe = True
            elif self._take("<!--"):
                stop = self.text.find("--", self.at)
                if stop < 0 or not self.text.startswith("-->", stop):
                    raise Rejected("malformed DOCTYPE: comment")
                self.at = stop + 3
            elif self._take("<?"):
                self.targets.append(self._name())
                stop = self.text.find("?>", self.at)
                if stop < 0 or (stop > self.at and not self._space()):
                    raise Rejected("malformed DOCTYPE: processing instruction")
                self.at = stop + 2
            elif self._take("<!ELEMENT"):
                self._must_space()
                name = self._name()
                self._must_space()
                begin = self.at
                kind = next((k for k in ("EMPTY", "ANY") if self._take(k)), None) or self._model()
                self.elements.append((self.order, name, kind, re.sub(C.SPACE, "", self.text[begin : self.at])))
                self._space()
                self._need(">")
            elif self._take("<!ATTLIST"):
                self._must_space()
                element = self._name()
                while True:
                    spaced = self._space()
                    if self._take(">"):
                        break
                    if not spaced:
                        raise Rejected("malformed DOCTYPE: attribute list")
                    self.order += 1
                    name = self._name()
                    self._must_space()
                    kind, values = self._attribute_type()
                    self._must_space()
                    default, value = next(((d, None) for d in ("REQUIRED", "IMPLIED") if self._take("#" + d)), (None, None))
                    if default is None:
                        default = "FIXED" if self._take("#FIXED") else "DEFAULT"
                        if default == "FIXED":
                            self._must_space()
                        value = self._literal()
                        if "<" in value:
                            raise Rejected("< in a default value")
                    self.attlists.append((self.order, element, name, kind, values, default, value))
            elif self._take("<!ENTITY"):
                self._must_space()
                parameter = self._take("%")
                if parameter:
                    self._must_space()
                    self.has_pe = True
                name = self._name()
                self._must_space()
                value = public = system = ndata = None
                if self._looking("'", '"'):
                    value = self._literal()
                else:
                    public, system = self._external()
                    save = self.at
                    if not parameter and self._space() and self._take("NDATA"):
                        self._must_space()
                        ndata = self._name()
                    else:
                        self.at = save
                self._space()
                self._need(">")
                self.entities.append((self.order, name, parameter, value, system, ndata))
            elif self._take("<!NOTATION"):
                self._must_space()
                name = self._name()
                self._must_space()
                self._external(need_system=False)
                self._space()
                self._need(">")
                self.notations.append((self.order, name))
            else:
                raise Rejected("malformed DOCTYPE")
        if self.at > end:
            raise Rejected("malformed DOCTYPE")

    def _model(self) -> str:
        """MIXED or CHILDREN; groups nest and don't mix separators."""
        self._need("(")
        self._space()
        if self._take("#PCDATA"):
            named = False
            while True:
                self._space()
                if self._take(")"):
                    break
                self._need("|")
                self._space()
                self._name()
                named = True
            if not self._take("*") and named:
                raise Rejected("malformed DOCTYPE: mixed content")
            return "MIXED"
        open_groups: list[str | None] = [None]
        want_item = True
        while open_groups:
            self._space()
            if want_item:
                if self._take("("):
                    open_groups.append(None)
                    continue
                self._name()
                self._take("?") or self._take("*") or self._take("+")
                want_item = False
            elif self._take(")"):
                open_groups.pop()
                self._take("?") or self._take("*") or self._take("+")
            else:
                sep = "|" if self._take("|") else "," if self._take(",") else None
                if sep is None or open_groups[-1] not in (None, sep):
                    raise Rejected("malformed DOCTYPE: content model")
                open_groups[-1] = sep
                want_item = True
        return "CHILDREN"

    def _attribute_type(self):
        for kind in ("CDATA", "IDREFS", "IDREF", "ID", "ENTITIES", "ENTITY", "NMTOKENS", "NMTOKEN"):
            if self._take(kind):
                return kind, []
        notation = self._take("NOTATION")
        if notation:
            self._must_space()
        self._need("(")
        values = []
        while True:
            self._space()
            values.append(self._name() if notation else self._match(_NMTOKEN))
            self._space()
            if self._take(")"):
                return ("NOTATION" if notation else "ENUM"), values
            self._need("|")


def doctype_end(text: str, at: int) -> int:
    """Place of the ``>`` that closes a DOCTYPE, past quotes, comments, instructions and brackets; -1 if there is none."""
    depth = 0
    while at < len(text):
        c = text[at]
        if text.startswith("<!--", at):
            at = text.find("-->", at + 4)
            if at < 0:
                return -1
            at += 3
            continue
        if text.startswith("<?", at):
            at = text.find("?>", at)
            if at < 0:
                return -1
            at += 2
            continue
        if c in "'\"":
            at = text.find(c, at + 1)
            if at < 0:
                return -1
        elif c == "<" or c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif c == ">":
            if depth == 0:
                return at
            depth -= 1
        at += 1
    return -1


_PE_DEF = re.compile(f"<!ENTITY{C.SPACE}+%{C.SPACE}+({C.NAME}){C.SPACE}+(?:(\"[^\"]*\"|'[^']*')|(SYSTEM|PUBLIC))")
_SKIP_OR_PE = re.compile(f"<!--.*?-->|<\\?.*?\\?>|\"[^\"]*\"|'[^']*'|%({C.NAME});", re.S)


def expand_parameters(body: str) -> str:
    """A DOCTYPE body with its parameter entities put in; later definitions win."""
    for _ in range(MAX_PE_ROUNDS):
        known: dict[str, str | None] = {}
        for m in _PE_DEF.finditer(body):
            known[m[1]] = m[2][1:-1] if m[2] else None
        missing = []

        def put(m, known=known, missing=missing):
            if m[1] is None:
                return m[0]
            if known.get(m[1]) is None:
                missing.append(m[1])
                return m[0]
            return f" {known[m[1]]} "

        after = _SKIP_OR_PE.sub(put, body)
        if missing:
            raise CannotValidate(f"unresolved parameter entity {missing[0]}")
        if after == body:
            return body
        if len(after) > MAX_EXPANSION:
            break
        body = after
    raise CannotValidate("parameter entities don't end")


# ---------------------------------------------------------------- entities


class Entities:
    """The general entities of a DOCTYPE. ``memo`` holds replacement texts, by use in content or in attributes."""

    def __init__(self, dtd: DTD | None, v11: bool, limit: int = MAX_EXPANSION):
        self.v11, self.limit = v11, limit
        self.table: dict[str, tuple] = {}
        self.lenient = bool(dtd and (dtd.system or dtd.has_pe))
        self.spent = 0
        self.memo: tuple[dict, dict] = ({}, {})
        self.declared_at: dict[str, int] = {}
        for order, name, parameter, value, system, ndata in dtd.entities if dtd else ():
            if not parameter and name not in self.table:
                self.table[name] = value, system, ndata
                self.declared_at[name] = order

    def char(self, m) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        code = int(digits, 16 if m[1] else 10) if len(digits) <= 7 else -1
        if not C.legal_reference(code, self.v11):
            raise Rejected("illegal character reference")
        return chr(code)

    def check_literal(self, value: str, entity: bool = True):
        """Reference syntax and characters inside an entity value or a default."""
        at = 0
        while (at := value.find("&", at)) >= 0:
            m = _REFERENCE.match(value, at)
            if not m:
                raise Rejected("bad reference in a literal")
            if not m[3]:
                self.char(m)
            at = m.end()
        if entity and "%" in value:
            raise Rejected("parameter reference in an internal entity value")

    def _value(self, name: str, attribute: bool) -> str | None:
        """The literal of an entity; None where a reference to it stays as it is (outside, or unknown but tolerated)."""
        if name not in self.table:
            if self.lenient:
                return None
            raise Rejected(f"undeclared entity {name}")
        value, system, ndata = self.table[name]
        if ndata is not None:
            raise Rejected(f"reference to unparsed entity {name}")
        if system is not None and attribute:
            raise Rejected(f"external entity {name} in an attribute")
        return value if system is None else None

    def expand(self, name: str, attribute: bool) -> str | None:
        """Replacement text, with all that it refers to put in; None where the reference stays as it is."""
        memo = self.memo[attribute]
        if name not in memo:
            self._fill(name, attribute, memo)
        out = memo[name]
        if out is not None:
            self._spend(len(out))
        return out

    def _spend(self, size: int):
        self.spent += size
        if self.spent > self.limit:
            raise LimitExceeded("entities expand too far")

    def _fill(self, name: str, attribute: bool, memo: dict):
        """Replacement texts of an entity and of those that it needs, innermost first."""
        frames: list[list] = []  # name, literal, place in it, parts, size
        opened = set()

        def enter(name):
            value = self._value(name, attribute)
            if value is None:
                memo[name] = None
            else:
                frames.append([name, value, 0, [], 0])
                opened.add(name)

        enter(name)
        while frames:
            frame = frames[-1]
            own, value, at, parts, _ = frame
            m = _PIECE.search(value, at)
            if m is None:
                memo[own] = "".join(parts) + value[at:]
                opened.discard(own)
                frames.pop()
                continue
            if m[0][0] == "<":
                new = m[0]
            elif m[3] is None:
                c = self.char(m)
                new = m[0] if ord(c) < 32 or 0x7F <= ord(c) < 0xA0 or c == "&" else c
            elif m[3] in C.PREDEFINED:
                new = m[0]
            else:
                if m[3] in opened:
                    raise Rejected(f"entity {m[3]} refers to itself")
                if m[3] not in memo:
                    enter(m[3])
                    if m[3] not in memo:
                        continue  # this reference is met again when the inner text is there
                new = m[0] if memo[m[3]] is None else memo[m[3]]
            parts += [value[at : m.start()], new]
            frame[2] = m.end()
            frame[4] += m.start() - at + len(new)
            if frame[4] > self.limit:
                raise LimitExceeded("entities expand too far")

    def attribute(self, raw: str) -> str:
        """Value with references put in and white space as blanks; characters referred to directly stay."""
        out, at = [], 0
        while at < len(raw):
            next_ = raw.find("&", at)
            if next_ < 0:
                next_ = len(raw)
            out.append(raw[at:next_].translate({9: " ", 10: " ", 13: " "}))
            at = next_
            if at == len(raw):
                break
            m = _REFERENCE.match(raw, at)
            if not m:
                raise Rejected("bad reference in an attribute value")
            if m[3] is None:
                out.append(self.char(m))
            elif m[3] in C.PREDEFINED:
                out.append(C.PREDEFINED[m[3]])
            else:
                text = self.expand(m[3], True)
                if text is None:
                    out.append(m[0])
                elif "<" in text:
                    raise Rejected(f"< by entity {m[3]} in an attribute value")
                else:
                    out.append(self._resolved(text.translate({9: " ", 10: " ", 13: " "})))
            at = m.end()
        return "".join(out)

    def _resolved(self, text: str) -> str:
        def put(m):
            return self.char(m) if m[3] is None else C.PREDEFINED.get(m[3], m[0])

        if re.search("&(?!#|[^;]*;)", text):
            raise Rejected("bad reference in an entity")
        return _REFERENCE.sub(put, text)


# ---------------------------------------------------------------- the document


class _Builder:
    def __init__(self, out: Scan, entities: Entities, types: dict):
        self.out, self.entities, self.types = out, entities, types
        self.open: list[list] = []  # node id, name, number of children
        self.top = {"prolog": 0, "body": 0, "epilog": 0}

    def add(self, kind, name=None, text=None, attrs=(), region="body"):
        node = len(self.out.nodes)
        if self.open:
            parent, pos = self.open[-1][0], self.open[-1][2]
            self.open[-1][2] += 1
        else:
            parent, pos = None, self.top[region]
            self.top[region] += 1
        self.out.nodes.append([node, node, parent, len(self.open), pos, region, kind, name, text, list(attrs)])
        return node

    def content(self, text: str, at: int, until_closed: bool) -> int:
        """Parses content; ``until_closed``: up to the end of the element that is open, else to the end of the text."""
        floor, nodes = len(self.open) - (1 if until_closed else 0), self.out.nodes
        while at < len(text):
            if text[at] == "&":
                m = _REFERENCE.match(text, at)
                if not m:
                    raise Rejected(f"bad reference at {at}")
                at = m.end()
                if m[3] is None:
                    self.add("text", text=self.entities.char(m))
                elif m[3] in C.PREDEFINED:
                    self.add("text", text=C.PREDEFINED[m[3]])
                else:
                    inner = self.entities.expand(m[3], False)
                    if inner is None:
                        self.add("text", text=m[0])
                    elif "<" in inner or "&" in inner:
                        self.content(inner, 0, False)
                    elif "]]>" in inner:
                        raise Rejected("]]> in character data")
                    elif inner:
                        self.add("text", text=inner)
                continue
            if text[at] != "<":
                found = _MARKUP.search(text, at)
                end = found.start() if found else len(text)
                run = text[at:end]
                if "]]>" in run:
                    raise Rejected("]]> in character data")
                self.add("text", text=run)
                at = end
                continue
            if text.startswith("</", at):
                name = _NAME.match(text, at + 2)
                if not name or len(self.open) <= floor:
                    raise Rejected("unexpected end tag")
                at = _OPT_S.match(text, name.end()).end()
                if not text.startswith(">", at):
                    raise Rejected("bad end tag")
                at += 1
                node, opened, _ = self.open.pop()
                if opened != name[0]:
                    raise Rejected(f"end tag {name[0]} for element {opened}")
                nodes[node][1] = len(nodes) - 1
                if until_closed and len(self.open) == floor:
                    return at
            elif text.startswith("<![CDATA[", at):
                end = text.find("]]>", at + 9)
                if end < 0:
                    raise Rejected("CDATA section without end")
                self.add("cdata", text=text[at + 9 : end])
                at = end + 3
            elif text.startswith("<!", at) or text.startswith("<?", at):
                at = self.misc(text, at, "body")
            else:
                at = self.start_tag(text, at)
        if until_closed or len(self.open) != floor:
            raise Rejected("element without end tag")
        return at

    def misc(self, text: str, at: int, region: str) -> int:
        if text.startswith("<!--", at):
            end = text.find("--", at + 4)
            if end < 0 or not text.startswith("-->", end):
                raise Rejected("bad comment")
            self.add("comment", text=text[at + 4 : end], region=region)
            return end + 3
        name = _NAME.match(text, at + 2) if text.startswith("<?", at) else None
        if not name:
            raise Rejected(f"bad markup at {at}")
        end = text.find("?>", name.end())
        if end < 0 or end > name.end() and not _S.match(text, name.end()):
            raise Rejected("bad processing instruction")
        if name[0].lower() == "xml":
            raise Rejected("processing instruction target xml")
        self.add("pi", name=name[0], text=text[name.end() : end].lstrip(" \t\r\n"), region=region)
        return end + 2

    def start_tag(self, text: str, at: int) -> int:
        """One start or empty tag; leaves the element open if it isn't empty."""
        name = _NAME.match(text, at + 1)
        if not name:
            raise Rejected(f"bad markup at {at}")
        at, attrs, seen = name.end(), [], set()
        while True:
            space = _OPT_S.match(text, at)
            here = space.end()
            if text.startswith("/>", here) or text.startswith(">", here):
                node = self.add("element", name=name[0], attrs=attrs)
                if text[here] == "/":
                    return here + 2
                self.open.append([node, name[0], 0])
                return here + 1
            key = _NAME.match(text, here)
            if not key or here == at:
                raise Rejected(f"bad tag {name[0]}")
            at = _OPT_S.match(text, key.end()).end()
            if not text.startswith("=", at):
                raise Rejected("attribute without value")
            at = _OPT_S.match(text, at + 1).end()
            quote = text[at : at + 1]
            end = text.find(quote, at + 1) if quote and quote in "'\"" else -1
            if end < 0:
                raise Rejected("attribute value without quotes")
            raw = text[at + 1 : end]
            if "<" in raw:
                raise Rejected("< in an attribute value")
            if key[0] in seen:
                raise Rejected(f"attribute {key[0]} twice")
            seen.add(key[0])
            value = self.entities.attribute(raw)
            kind = self.types.get((name[0], key[0]), "CDATA")
            if kind != "CDATA":
                value = " ".join(x for x in re.split(C.SPACE + "+", value) if x)
            attrs.append((len(attrs), key[0], value))
            at = end + 1


def scan(source: bytes | str | None, validating: bool = False, limit: int = MAX_EXPANSION) -> Scan:
    """Rows and verdict of one document. ``verdict`` is None if nothing is wrong so far; then namespaces and validity follow.
    A null document is not well-formed. No document raises an error."""
    out = Scan()
    try:
        if source is None:
            raise Rejected("no document")
        text, out.v11 = decode(source)
        bad = _ILLEGAL[out.v11].search(text)
        if bad:
            raise Rejected(f"illegal character at {bad.start()}")
        _document(line_ends(text, out.v11), out, validating, limit)
    except Rejected as e:
        out.verdict, out.reason, out.nodes = "NOT_WELL_FORMED", str(e), []
    except LimitExceeded as e:
        out.verdict, out.reason, out.nodes = "LIMIT_EXCEEDED", str(e), []
    except CannotValidate as e:
        out.verdict, out.reason = "CANNOT_VALIDATE", str(e)
    return out


#: DOCTYPEs up to so many characters are kept with what was found of them, as documents of one kind share theirs.
_KEPT_DOCTYPE = 1 << 16


def _doctype(body: str, v11: bool, limit: int):
    """The declarations of a DOCTYPE, its entities and attribute types; raises what is wrong with them."""
    dtd = DTD(body)
    _check_declarations(dtd)
    entities = Entities(dtd, v11, limit)
    _check_entities(dtd, entities)
    types: dict = {}
    for _, element, name, kind, _, _, _ in dtd.attlists:
        types.setdefault((element, name), kind)
    return dtd, entities, types


@functools.lru_cache(maxsize=64)
def _kept_doctype(body: str, v11: bool, limit: int):
    try:
        return _doctype(body, v11, limit)
    except (Rejected, LimitExceeded) as e:
        return type(e), str(e)


@functools.lru_cache(maxsize=64)
def _expanded(body: str) -> DTD:
    return DTD(expand_parameters(body))


def _document(text: str, out: Scan, validating: bool, limit: int):
    at = 0
    if _S.match(text[5:6] or "x") and text.startswith("<?xml"):
        m = _DECL.match(text)
        if not m:
            raise Rejected("bad XML declaration")
        out.version, out.encoding, out.standalone = (m[i] or m[i + 1] or "" for i in (1, 3, 5))
        at = m.end()
    builder = _Builder(out, Entities(None, out.v11, limit), {})
    dtd = None
    while True:
        at = _OPT_S.match(text, at).end()
        if text.startswith("<!DOCTYPE", at):
            end = doctype_end(text, at + 9)
            if dtd is not None or end < 0:
                raise Rejected("bad DOCTYPE")
            body = text[at + 9 : end]
            found = (_kept_doctype if len(body) <= _KEPT_DOCTYPE else _doctype)(body, out.v11, limit)
            if len(found) == 2:
                raise found[0](found[1])
            dtd, builder.entities, builder.types = found
            builder.entities.spent = 0
            at = end + 1
        elif text.startswith("<!--", at) or text.startswith("<?", at):
            at = builder.misc(text, at, "prolog")
        else:
            break
    if not text.startswith("<", at):
        raise Rejected("no root element")
    at = builder.start_tag(text, at)
    if builder.open:
        at = builder.content(text, at, True)
    while True:
        at = _OPT_S.match(text, at).end()
        if at == len(text):
            break
        if not (text.startswith("<!--", at) or text.startswith("<?", at)):
            raise Rejected("content behind the root element")
        at = builder.misc(text, at, "epilog")
    if dtd is not None:
        out.root_type, out.external_subset = dtd.root, dtd.system is not None
        if validating and dtd.has_pe and not out.external_subset:
            dtd = _expanded(body)
        _fill(out, dtd)


def _fill(out: Scan, dtd: DTD):
    out.dtd = dtd
    out.elements, out.attlists, out.notations = dtd.elements, dtd.attlists, dtd.notations
    out.entities = [(o, n, s is not None, d) for o, n, p, v, s, d in dtd.entities if not p]


def _check_declarations(dtd: DTD):
    for target in dtd.targets:
        if target.lower() == "xml":
            raise Rejected("processing instruction target xml")
    for kind, names in (("PI target", dtd.targets), ("entity", [e[1] for e in dtd.entities]), ("notation", [n[1] for n in dtd.notations])):
        for name in names:
            if ":" in name:
                raise Rejected(f"colon in {kind} name {name}")


def _check_entities(dtd: DTD, entities: Entities):
    for _, _, _, value, _, _ in dtd.entities:
        if value is not None:
            entities.check_literal(value)
    for order, _, _, _, _, _, value in dtd.attlists:
        if value is None:
            continue
        entities.check_literal(value, entity=False)
        for m in _REFERENCE.finditer(value):
            if m[3] and m[3] not in C.PREDEFINED:
                if entities.declared_at.get(m[3], order + 1) > order and not (entities.lenient and m[3] not in entities.table):
                    raise Rejected(f"entity {m[3]} in a default is not declared before it")
                entities.expand(m[3], True)
