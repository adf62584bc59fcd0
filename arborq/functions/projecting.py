"""Projection of one scanned document into a schema: placed elements, unknown markup and the merged typed value."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from arborq.plans.schema import Schema, pascal, snake

from .scanner import Scan

_BLANK = re.compile("[ \\t\\r\\n]*")


@dataclass
class _Type:
    slots: dict  # type of a child -> (field, repeated, oneof, wrapper)
    texts: frozenset  # string fields
    leaf: bool
    choices: dict  # number of a choice -> its fields


class Layout:
    """A schema's types as look-up tables."""

    def __init__(self, schema: Schema):
        self.root, self.open, self.ns_extensible, self.check = schema.root, schema.open, schema.ns_extensible, schema.pre_validate
        self.types: dict[str, _Type] = {}
        self.names: dict[str, tuple[str, str]] = {}
        for name, fields in schema.types.items():
            slots, choices = {}, {}
            for f in fields:  # a plain field comes before a wrapper's variant
                if f.target and not f.variants:
                    slots.setdefault(f.target, (f.name, f.repeated, f.oneof, None))
                if f.oneof is not None:
                    choices.setdefault(f.oneof, []).append(f.name)
            for f in fields:
                for v in f.variants:
                    if v.target:
                        slots.setdefault(v.target, (v.name, f.repeated, None, f.name))
            texts = frozenset(f.name for f in fields if not f.target and not f.variants and not f.repeated)
            self.types[name] = _Type(slots, texts, "text" in texts and not slots, choices)

    def mangled(self, local: str) -> tuple[str, str]:
        """Type and field name."""
        found = self.names.get(local)
        if found is None:
            if len(self.names) > 1 << 16:
                self.names.clear()
            found = self.names[local] = pascal(local), snake(local)
        return found


class Projected:
    """``placed``: (node_id, end_id, parent_id, name, local, type, field, wrapper, repeated, oneof, values) with the element's
    own string fields. ``unknown``: (node_id, what). ``value``: the merged message of the root."""

    def __init__(self):
        self.placed: list[tuple] = []
        self.unknown: list[tuple[int, str]] = []
        self.value: dict = {}
        self.why: str | None = None


def _message(into: dict, slot, choices) -> dict:
    """The message that a child fills: a new one of a repeated field, else the one that is there. The last variant of a
    choice takes the place of the others."""
    field, repeated, oneof, wrapper = slot
    if wrapper is not None:
        new: dict = {}
        if repeated:
            into.setdefault(wrapper, []).append({field: new})
            return new
        held = into.setdefault(wrapper, {})
        if field not in held:
            held.clear()
        return held.setdefault(field, new)
    if oneof is not None:
        for other in choices.get(oneof, ()):
            if other != field:
                into.pop(other, None)
    if repeated:
        into.setdefault(field, []).append(new := {})
        return new
    return into.setdefault(field, {})


def place(out: Scan, names: list, layout: Layout) -> Projected:
    """Elements by local name, parents before children: an element fills the field of its parent's type whose type is its
    own. Elements with a string field ``text`` and no message field are leaves: their descendant text is the value, if
    it is not blank, and nothing in them is looked at. Nor is what lies in unknown markup, or (with ``ns_extensible``) in a
    namespace."""
    got = Projected()
    root = next(i for i, n in enumerate(out.nodes) if n[2] is None and n[6] == "element")
    kind = layout.mangled(names[root][1])[0]
    if kind not in layout.types or layout.root not in (None, kind):
        got.why = f"no type for root {out.nodes[root][7]}"
        return got
    open_: dict[int, tuple[str, dict]] = {}  # elements whose children are looked at
    at = root
    last = out.nodes[root][1]
    while at <= last:
        node, end, parent, _, _, _, what, name, _, attrs = out.nodes[at]
        if what != "element":
            at += 1
            continue
        _, local, uri, own = names[at]
        if at == root:
            slot, message = (None, None, None, None), got.value
        else:
            if layout.ns_extensible and uri is not None:
                at = end + 1
                continue
            above, into = open_[parent]
            kind = layout.mangled(local)[0]
            slot = layout.types[above].slots.get(kind)
            if slot is None or kind not in layout.types:
                got.unknown.append((node, f"{out.nodes[parent][7]}>{name}"))
                at = end + 1
                continue
            message = _message(into, slot, layout.types[above].choices)
        own_type = layout.types[kind]
        values: dict[str, str] = {}
        for (_, key, value), (a_prefix, a_local, a_uri) in zip(attrs, own, strict=True):
            if a_prefix == "xmlns" or key == "xmlns" or layout.ns_extensible and a_uri is not None:
                continue
            field = layout.mangled(a_local)[1]
            if field in own_type.texts:
                values[field] = value
            else:
                got.unknown.append((node, f"{name}@{key}"))
        if own_type.leaf:
            text = "".join(n[8] for n in out.nodes[at + 1 : end + 1] if n[6] in ("text", "cdata"))
            if not _BLANK.fullmatch(text):
                values["text"] = text
            at = end + 1
        else:
            open_[node] = kind, message
            at += 1
        message.update(values)
        got.placed.append((node, end, parent, name, local, kind, slot[0], slot[3], bool(slot[1]), slot[2], list(values.items())))
    if layout.check:
        got.why = layout.check(out, names)
    if got.why is None and got.unknown and not layout.open:
        got.why = "unknown markup: " + ", ".join(sorted({w for _, w in got.unknown}))
    return got


def as_json(value: dict) -> str | None:
    """None where messages nest too deeply to be written."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None
