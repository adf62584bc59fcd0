"""Content models as position automata: a set of positions moves from child to child, so every model is decided in one
walk over the children, however long, ambiguous or deeply nested."""

from __future__ import annotations

import functools
import re

from . import chars as C

_TOKEN = re.compile(f"({C.NAME})|[(),|?*+]")
#: Sets of positions that a model remembers moves of; then it starts anew.
MAX_STATES = 4096


class ContentModel:
    """Of a model without white space, such as ``(a,(b|c)*)``. Built without recursion."""

    def __init__(self, model: str):
        self.names: list[str] = []
        self.follow: list[set[int]] = []
        groups: list[list] = [[None, None]]  # (separator, item) of each open group; an item is (nullable, first, last)
        item = None
        for m in _TOKEN.finditer(model):
            token = m[0]
            if m[1]:
                p = len(self.names)
                self.names.append(token)
                self.follow.append(set())
                item = (False, {p}, {p})
            elif token == "(":
                groups.append([None, None])
            elif token in "?*+":
                nullable, first, last = item
                if token != "?":
                    for p in last:
                        self.follow[p] |= first
                item = (nullable or token != "+", first, last)
            else:
                group = groups[-1]
                group[1] = item if group[1] is None else self._joined(group[0], group[1], item)
                if token == ")":
                    item = groups.pop()[1]
                else:
                    group[0] = token
        self.nullable, self.first, self.last = item
        self.forget()

    def _joined(self, separator, a, b):
        if separator == "|":
            return a[0] or b[0], a[1] | b[1], a[2] | b[2]
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def forget(self):
        self.moves: dict[frozenset | None, dict[str, frozenset]] = {None: {}}

    def accepts(self, children: list[str]) -> bool:
        """Whether a sequence of child names fits the model."""
        state = None  # before the first child
        for name in children:
            known = self.moves[state]
            after = known.get(name)
            if after is None:
                reach = self.first if state is None else set().union(*(self.follow[p] for p in state))
                after = known[name] = frozenset(q for q in reach if self.names[q] == name)
                if after not in self.moves:
                    if len(self.moves) > MAX_STATES:
                        self.forget()
                    self.moves[after] = {}
            if not after:
                return False
            state = after
        return self.nullable if state is None else not self.last.isdisjoint(state)


@functools.lru_cache(maxsize=1024)
def content_model(model: str) -> ContentModel:
    return ContentModel(model)
