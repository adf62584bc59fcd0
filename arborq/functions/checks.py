"""Namespaces and validity of a scanned document, from its own rows.

Every violation is ``(stage, node_id, ord, verdict, reason)``; the first in that order decides. Stages: 1 the scan, 10
namespaces, 20 whether it can be validated, 21 declarations, 22 the root, 23 elements and attributes, 24 references to IDs."""

from __future__ import annotations

import functools
import re

from . import chars as C
from .automata import content_model
from .scanner import DTD, MAX_EXPANSION, Scan, scan

_QNAME = re.compile(f"{C.NCNAME}(?::{C.NCNAME})?")
_NCNAME, _NMTOKEN = re.compile(C.NCNAME), re.compile(C.NMTOKEN)
_DATA = re.compile("[^ \\t\\r\\n]")
_GAP = re.compile("[ \\t\\r\\n]+")
_RESERVED = (C.XML_URI, C.XMLNS_URI)


@functools.lru_cache(maxsize=1 << 16)
def split_name(name: str) -> tuple[str, str, bool]:
    """Prefix (empty without one), local part, and whether the name is a QName."""
    prefix, colon, local = name.partition(":")
    return (prefix, local, _QNAME.fullmatch(name) is not None) if colon else ("", name, _QNAME.fullmatch(name) is not None)


def resolve(out: Scan) -> tuple[list, list]:
    """``(names, violations)``: for each node None or, for an element, ``(prefix, local, uri, attributes)`` with
    ``(prefix, local, uri)`` of each attribute. One pass in document order; declarations go out of scope with their element."""
    names: list = []
    found: list = []

    def say(node, ord_, reason):
        found.append((10, node, ord_, "NOT_WELL_FORMED", reason))

    bound: dict[str, str] = {"xml": C.XML_URI}
    open_: list[tuple[int, list]] = []  # last node in scope, and what was bound before
    for node, end, _, _, _, _, kind, name, _, attrs in out.nodes:
        while open_ and open_[-1][0] < node:
            for prefix, uri in reversed(open_.pop()[1]):
                if uri is None:
                    del bound[prefix]
                else:
                    bound[prefix] = uri
        if kind != "element":
            if kind == "pi" and ":" in name:
                say(node, 8, f"colon in instruction target {name}")
            names.append(None)
            continue
        before = []
        for _, key, uri in attrs:
            if key.startswith("xmlns") and (len(key) == 5 or key[5] == ":"):
                prefix = key[6:]
                if prefix == "xmlns" or (prefix == "xml") != (uri == C.XML_URI) or uri in _RESERVED and prefix != "xml":
                    say(node, 1, f"reserved namespace at prefix {prefix}")
                if prefix and not uri and not out.v11:
                    say(node, 2, f"prefix undeclared in XML 1.0: {prefix}")
                if prefix != "xml":
                    before.append((prefix, bound.get(prefix)))
                    bound[prefix] = uri
        if before and end > node:
            open_.append((end, before))
        prefix, local, good = split_name(name)
        if not good or prefix == "xmlns":
            say(node, 4, f"bad element name {name}")
        uri = bound.get(prefix)
        if not uri:
            uri = None
            if prefix:
                say(node, 5, f"undeclared prefix of element {name}")
        own, seen = [], {}
        for _, key, _ in attrs:
            a_prefix, a_local, good = split_name(key)
            if not good:
                say(node, 3, f"bad attribute name {key}")
            a_uri = None
            if a_prefix and a_prefix != "xmlns":
                a_uri = bound.get(a_prefix) or None
                if a_uri is None:
                    say(node, 6, f"undeclared prefix of attribute {key}")
                else:
                    seen.setdefault((a_uri, a_local), []).append(key)
            own.append((a_prefix, a_local, a_uri))
        for keys in seen.values():
            if len(keys) > 1:
                say(node, 7, f"attribute twice by its expanded name: {min(keys)}")
        names.append((prefix, local, uri, own))
        if before and end == node:
            for prefix, uri in reversed(before):
                if uri is None:
                    del bound[prefix]
                else:
                    bound[prefix] = uri
    return names, found


def _words(value: str) -> list[str]:
    return [w for w in _GAP.split(value) if w]


def illegal_value(value: str, kind: str, allowed: list[str]) -> bool:
    """Whether ``value`` breaks the lexical rule of an attribute type."""
    if kind == "CDATA":
        return False
    words = _words(value)
    one = " ".join(words)
    if kind in ("ID", "IDREF", "ENTITY"):
        return not _NCNAME.fullmatch(one)
    if kind in ("IDREFS", "ENTITIES"):
        return not words or not all(map(_NCNAME.fullmatch, words))
    if kind == "NMTOKEN":
        return not _NMTOKEN.fullmatch(one)
    if kind == "NMTOKENS":
        return not words or not all(map(_NMTOKEN.fullmatch, words))
    return one not in allowed


class Rules:
    """A DOCTYPE's declarations, ready for documents: the first declaration of each name binds. ``violations``: of the
    declarations themselves."""

    def __init__(self, dtd: DTD):
        say = lambda ord_, reason: self.violations.append((21, 0, ord_, "INVALID", reason))
        self.violations: list = []
        self.elements: dict[str, tuple] = {}
        for _, name, kind, model in dtd.elements:
            if name in self.elements:
                say(1, f"element declared twice: {name}")
            allowed = re.sub("[()*]", "", model).split("|") if kind == "MIXED" else ()
            if len(allowed) > len(set(allowed)):
                say(2, f"name twice in mixed content of {name}")
            self.elements.setdefault(name, (kind, frozenset(allowed), model))
        self.attributes: dict[str, dict[str, tuple]] = {}
        for _, element, name, kind, allowed, default, value in dtd.attlists:
            fixed = value if value is None or kind == "CDATA" else " ".join(_words(value))
            self.attributes.setdefault(element, {}).setdefault(name, (kind, allowed, default, fixed))
        notations = {n for _, n in dtd.notations}
        self.unparsed: set[str] = set()
        known: set[str] = set()
        for _, name, parameter, _, _, notation in dtd.entities:
            if parameter:
                continue
            if notation is not None:
                if notation not in notations:
                    say(4, f"undeclared notation {notation}")
                if name not in known:
                    self.unparsed.add(name)
            known.add(name)
        self.required: dict[str, list[str]] = {}
        for element, own in self.attributes.items():
            ids = [n for n, (kind, *_) in own.items() if kind == "ID"]
            if len(ids) > 1:
                say(5, f"two ID attributes for {element}")
            for name, (kind, allowed, default, fixed) in own.items():
                if kind == "NOTATION":
                    for x in allowed:
                        if x not in notations:
                            say(3, f"undeclared notation {x}")
                if kind == "ID" and default in ("FIXED", "DEFAULT"):
                    say(6, f"default for ID attribute {name}")
                if fixed is not None and illegal_value(fixed, kind, allowed):
                    say(7, f"illegal default of {name}")
                if default == "REQUIRED":
                    self.required.setdefault(element, []).append(name)


_rules = functools.lru_cache(maxsize=64)(Rules)


def validate(out: Scan) -> list[tuple]:
    """Violations of validity constraints, in no order."""
    if out.root_type is None:
        return [(20, 0, 0, "INVALID", "no DTD")]
    if out.external_subset:
        return [(20, 0, 0, "CANNOT_VALIDATE", "external subset")]
    rules = _rules(out.dtd)
    found = list(rules.violations)
    say = lambda stage, node, ord_, reason: found.append((stage, node, ord_, "INVALID", reason))
    children: dict[int, list[str]] = {}
    filled, data = set(), set()  # elements that hold content at all, or character data
    for node, _, parent, _, _, _, kind, name, text, _ in out.nodes:
        if parent is None:
            if kind == "element" and name != out.root_type:
                say(22, node, 1, f"unexpected root {name}")
        elif kind == "element":
            children.setdefault(parent, []).append(name)
            filled.add(parent)
        elif kind in ("text", "cdata"):
            filled.add(parent)
            if kind == "cdata" or _DATA.search(text):
                data.add(parent)
    ids: dict[str, list[int]] = {}
    refs: list[tuple[int, str]] = []
    none: list[str] = []
    for node, _, _, _, _, _, kind, name, _, attrs in out.nodes:
        if kind != "element":
            continue
        declared = rules.elements.get(name)
        if declared is None:
            say(23, node, 1, f"undeclared element {name}")
        else:
            content, allowed, model = declared
            own = children.get(node, none)
            if content == "EMPTY":
                if node in filled:
                    say(23, node, 2, f"content in empty element {name}")
            elif content == "MIXED":
                if own and not allowed.issuperset(own):
                    say(23, node, 2, f"element not allowed in {name}")
            elif content != "ANY":
                if node in data:
                    say(23, node, 2, f"character data in {name}")
                if not content_model(model).accepts(own):
                    say(23, node, 3, f"content of {name}")
        types = rules.attributes.get(name, {})
        for _, key, value in attrs:
            declared = types.get(key)
            if declared is None:
                say(23, node, 4, f"undeclared attribute {key}")
                continue
            kind, allowed, default, fixed = declared
            if default == "FIXED" and value != fixed:
                say(23, node, 6, f"fixed attribute differs: {key}")
            if illegal_value(value, kind, allowed):
                say(23, node, 7, f"illegal value of {key}")
            if kind == "ID":
                ids.setdefault(value, []).append(node)
            elif kind in ("IDREF", "IDREFS"):
                refs += [(node, w) for w in _words(value)]
            elif kind in ("ENTITY", "ENTITIES"):
                for w in _words(value):
                    if w not in rules.unparsed:
                        say(23, node, 9, f"no unparsed entity {w}")
        if name in rules.required:
            have = {key for _, key, _ in attrs}
            for key in rules.required[name]:
                if key not in have:
                    say(23, node, 5, f"required attribute missing: {key}")
    for word, nodes in ids.items():
        if len(nodes) > 1:
            say(23, nodes[1], 8, f"ID twice: {word}")
    for node, word in refs:
        if word not in ids:
            say(24, node, 1, f"IDREF without ID: {word}")
    return found


def judge(source: bytes | str | None, validating: bool = False, limit: int = MAX_EXPANSION) -> tuple[Scan, list, list[tuple]]:
    """A document's rows, its resolved names, and its violations, the deciding one first."""
    out = scan(source, validating, limit)
    if out.verdict and not out.nodes:
        return out, [], [(1, -1, 0, out.verdict, out.reason)]
    names, found = resolve(out)
    if out.verdict:
        found.append((20, -1, 0, out.verdict, out.reason))
    elif validating:
        found += validate(out)
    return out, names, sorted(found)


def root_name(out: Scan) -> str | None:
    return next((n[7] for n in out.nodes if n[2] is None and n[6] == "element"), None)


def verdict_of(out: Scan, found: list[tuple], validating: bool) -> tuple[str, str | None, str | None]:
    """``(verdict, reason, root)``; the root is that of an accepted document."""
    if found:
        return found[0][3], found[0][4], None
    return "VALID" if validating else "WELL_FORMED", None, root_name(out)
