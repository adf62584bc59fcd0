"""Personal data: pattern rules, and a character-level bidirectional LSTM with a CRF that adds spans.

The network is trained here, in numpy, from labelled spans: those of the rules in a bounded sample of
texts, and variants of them that the rules miss (a phone number without its plus, a card with other separators, an
address with blanks or words for its signs). It reads all of every text, in windows of ``WINDOW`` characters that
overlap. Each window is decoded with the CRF (Viterbi; it is left out where a bound on all paths shows that
nothing but "all outside" can win). A span counts where the best path beats the one without it by a margin, which
is set on texts held out from training so that 98 % of what is added there is right, and where its middle lies nearer to the
window's centre than to its neighbours'; one that a window's edge cuts off is joined with the pieces that go on in the next
windows. Spans of a text are then reconciled from left to right: the rules' spans stay, added ones never
overlap them or each other."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean, table
from ._words import chunks

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 512, 448
#: Characters of a window that is learned from.
LEARNED = 96
OUTSIDE, TAGS = 0, 1 + 2 * len(KINDS)

# Each pattern runs in linear time. email: only an at sign can start a search, its local part is looked up backwards.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by the rules, in order; leftmost and non-overlapping for each kind."""
    out = []
    if not _ANCHOR.search(text):
        return out
    after = at = 0
    while (at := text.find("@", max(at, after))) >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, found.end()))
            after = found.end()
        at += 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# Characters: ASCII as they are, line feeds and tabs as blanks, other letters and other signs as one each.
N_CHARS = 130


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 32, 32, np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129))).astype(np.int16)


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, forward pass and decoding; see :func:`train`."""

    def __init__(self, hidden: int = 8, seed: int = 10):
        rng = np.random.Generator(np.random.PCG64(seed))
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (N_CHARS, 4 * h))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"x{d}"][:, h : 2 * h] += 1.0  # remember by default
        self.p["w"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.p["o"] = np.zeros(TAGS)
        self.p["a"] = np.zeros((TAGS, TAGS))
        #: A tag inside a kind follows a tag of that kind only.
        self.ban = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.ban[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = -1e4
        self.start = np.where([t and t % 2 == 0 for t in range(TAGS)], -1e4, 0.0)
        #: What a span must beat its absence by, and what was measured with it on texts held out: (precision, recall, spans).
        self.margin, self.held_out = 0.0, (0.0, 0.0, 0)
        #: Characters of an added span at most.
        self.longest = 1 << 30

    def lstm(self, chars, d, keep=None):
        """Hidden states (time, batch, hidden) of one direction; ``keep`` collects what training needs."""
        x, u, h = self.p[f"x{d}"], self.p[f"u{d}"], self.hidden
        steps = range(chars.shape[1]) if d == "f" else range(chars.shape[1] - 1, -1, -1)
        out = np.zeros((chars.shape[1], len(chars), h), u.dtype)
        state = cell = np.zeros((len(chars), h), u.dtype)
        for t in steps:
            gates = x[chars[:, t]] + state @ u
            ifo = _sigmoid(gates[:, : 3 * h])
            g = np.tanh(gates[:, 3 * h :])
            before, prev = cell, state
            cell = ifo[:, h : 2 * h] * before + ifo[:, :h] * g
            squashed = np.tanh(cell)
            state = ifo[:, 2 * h :] * squashed
            out[t] = state
            if keep is not None:
                keep.append((t, prev, before, ifo, g, squashed))
        return out

    def lstm_grad(self, chars, d, keep, d_out, grads):
        u, h = self.p[f"u{d}"], self.hidden
        d_state = d_cell = np.zeros((len(chars), h), u.dtype)
        of_gates, of_prev, of_char = [], [], []
        for t, prev, before, ifo, g, squashed in reversed(keep):
            d_state = d_state + d_out[t]
            i, f, o = ifo[:, :h], ifo[:, h : 2 * h], ifo[:, 2 * h :]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            d_gates = np.concatenate([d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - g**2)], 1)
            of_gates.append(d_gates)
            of_prev.append(prev)
            of_char.append(chars[:, t])
            d_state, d_cell = d_gates @ u.T, d_cell * f
        gates, char = np.concatenate(of_gates), np.concatenate(of_char)
        grads[f"u{d}"] += np.concatenate(of_prev).T @ gates
        order = np.argsort(char, kind="stable")
        kinds, first = np.unique(char[order], return_index=True)
        grads[f"x{d}"][kinds] += np.add.reduceat(gates[order], first)

    def single(self):
        """The network in single precision, for decoding. As s(z) = (1 + tanh(z / 2)) / 2, all gates take one tanh. What reads a state
        is halved, as states are doubled there, and the gates stand apart (gate, character or state, hidden), so that each is one piece of memory."""
        h = self.hidden
        half = np.where(np.arange(4 * h) < 3 * h, 0.5, 1.0)
        gates = lambda x: np.ascontiguousarray(x.reshape(len(x), 4, h).transpose(1, 0, 2))
        by = {"x": half, "u": half * 0.5}
        self.fast = {k: (gates(x * by[k[0]]) if k[0] in by else x * 0.5 if k == "w" else x).astype(np.float32) for k, x in self.p.items()}
        return self

    def _states(self, chars, d):
        """Twice the hidden states (time, batch, hidden) of one direction."""
        x, u, h = self.fast[f"x{d}"], self.fast[f"u{d}"], self.hidden
        n, size = chars.shape
        out = np.empty((size, n, h), np.float32)
        state, cell, work = (np.zeros((n, h), np.float32) for _ in range(3))
        gates, more = (np.empty((4, n, h), np.float32) for _ in range(2))
        columns = np.ascontiguousarray(chars.T).astype(np.int64)
        for t in range(size) if d == "f" else range(size - 1, -1, -1):
            np.take(x, columns[t], 1, out=gates, mode="clip")
            np.matmul(state, u, out=more)
            gates += more
            np.tanh(gates, out=gates)
            gates[:3] += 1
            cell *= gates[1]
            np.multiply(gates[0], gates[3], out=work)
            cell += work
            cell *= 0.5
            np.tanh(cell, out=work)
            state = np.multiply(work, gates[2], out=out[t])
        return out

    def emissions(self, chars):
        """(tag, time, batch)."""
        h, w = self.hidden, self.fast["w"].T
        out = w[:, :h] @ self._states(chars, "f").reshape(-1, h).T
        out += w[:, h:] @ self._states(chars, "b").reshape(-1, h).T
        out += self.fast["o"][:, None]
        return out.reshape(TAGS, chars.shape[1], len(chars))

    def loss_and_grads(self, chars, tags):
        """Mean negative log-likelihood of the CRF, and its gradient."""
        n, steps = chars.shape
        keep = {d: [] for d in "fb"}
        hidden = np.concatenate([self.lstm(chars, d, keep[d]) for d in "fb"], 2)
        e = hidden @ self.p["w"] + self.p["o"]
        kind = e.dtype
        a, start = self.p["a"] + self.ban.astype(kind), self.start.astype(kind)
        step, rows, tiny = np.exp(a), np.arange(n), np.finfo(kind).tiny
        log_sum = lambda x, m: (top := x.max(1, keepdims=True)) + np.log(np.exp(x - top) @ m + tiny)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + start
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1], step) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(e[t + 1] + beta[t + 1], step.T)
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        d_e = np.exp(alpha + beta - z[None, :, None])
        d_a = np.exp(alpha[:-1, :, :, None] + a + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        gold = start[tags[:, 0]] + e[np.arange(steps)[:, None], rows, tags.T].sum(0) + a[tags[:, :-1], tags[:, 1:]].sum(1)
        d_e[np.arange(steps)[:, None], rows, tags.T] -= 1
        d_a -= np.bincount((tags[:, :-1] * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["a"], grads["o"] = d_a / n, d_e.sum((0, 1)) / n
        grads["w"] = np.einsum("tbh,tbk->hk", hidden, d_e) / n
        d_hidden = d_e @ self.p["w"].T / n
        for i, d in enumerate("fb"):
            self.lstm_grad(chars, d, keep[d], d_hidden[:, :, i * self.hidden : (i + 1) * self.hidden], grads)
        return float((z - gold).mean()), grads

    def decode(self, chars, margin: float | None = None) -> np.ndarray:
        """Best tags (batch, time), without spans that beat their absence by less than ``margin`` (the network's own, if
        None). Spans at an edge of the window stay, since what lies beyond may tell more.

        A window gets a full search only where an upper bound on the gain of any span over "outside" is above zero: the
        best opening tag, then the best tag of any kind each time, with the largest transitions."""
        margin = self.margin if margin is None else margin
        e = self.emissions(chars)
        a = self.p["a"] + self.ban
        still = a[OUTSIDE, OUTSIDE]
        best_of = lambda tags: functools.reduce(np.maximum, (e[t] for t in tags))
        opened, going = best_of(range(1, TAGS, 2)), best_of(range(2, TAGS, 2))
        opened = opened - e[OUTSIDE]
        going = np.maximum(opened, going - e[OUTSIDE])
        enter, stay, leave = (float(x.max() - still) for x in (a[OUTSIDE, 1::2], a[1:, 1:], a[1:, OUTSIDE]))
        now = opened[0]  # nothing stands before the first character, so nothing is saved or spent
        best = now + leave
        for t in range(1, len(opened)):
            now = np.maximum(now + stay + going[t], enter + opened[t])
            best = np.maximum(best, now + leave)
        out = np.zeros(chars.shape, np.int64)
        open_ = np.flatnonzero(np.maximum(best, now) > 0)
        if len(open_):
            out[open_] = self._viterbi(np.ascontiguousarray(e[:, :, open_].transpose(1, 2, 0)), a, margin)
        return out

    def _viterbi(self, e, a, margin) -> np.ndarray:
        score = e[0] + self.start
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            x = score[:, :, None] + a
            back[t] = x.argmax(1)
            score = x.max(1) + e[t]
        size, n = e.shape[:2]
        tags, each = np.empty((size, n), np.int64), np.arange(n)
        tags[-1] = score.argmax(1)
        for t in range(size - 1, 0, -1):
            tags[t - 1] = back[t, each, tags[t]]
        tags = tags.T
        for r in np.flatnonzero(tags.any(1)).tolist():
            row = tags[r]
            for _, s, end in spans_of(row):
                if s == 0 or end == size:
                    continue
                path = row[s - 1 : end + 1] if end < size else np.append(row[s - 1 : end], OUTSIDE)
                own = e[np.arange(s, end), r, row[s:end]].sum() + a[path[:-1], path[1:]].sum()
                none = e[s:end, r, OUTSIDE].sum() + a[path[0], OUTSIDE] + (end - s - 1) * a[OUTSIDE, OUTSIDE] + a[OUTSIDE, path[-1]]
                if own - none < margin and not (path[-1] and path[-1] % 2 == 0):
                    row[s:end] = OUTSIDE
        return tags


def spans_of(row: np.ndarray) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of a row of tags."""
    out = []
    for s in np.flatnonzero(row % 2 == 1).tolist():
        e = s + 1
        while e < len(row) and row[e] == row[s] + 1:
            e += 1
        out.append((int(row[s] - 1) // 2, s, e))
    return out


def train(chars, tags, *, steps: int = 600, batch: int = 32, rate: float = 0.02, seed: int = 10, net: Network | None = None) -> Network:
    """Adam over random batches of labelled windows, in single precision. ``net``: goes on from there."""
    net, rng = net or Network(seed=seed), np.random.Generator(np.random.PCG64(seed))
    net.p = {k: x.astype(np.float32) for k, x in net.p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(chars), batch)
        _, grads = net.loss_and_grads(chars[pick], tags[pick])
        size = np.sqrt(sum((g * g).sum() for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net.single()


def tag_row(size: int, spans) -> np.ndarray:
    """Tags of a text by its spans; of overlapping spans the first counts."""
    tags = np.zeros(size, np.int64)
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not tags[start:end].any():
            tags[start] = 1 + 2 * kind
            tags[start + 1 : end] = 2 + 2 * kind
    return tags


def _variant(kind: int, old: str, rng) -> str:
    """One rewriting of a span that the rules miss."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    if kind == 0:
        at, dot = pick((" @ ", "."), ("@ ", " . "), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."), (" AT ", " DOT "))
        local, _, host = old.partition("@")
        return local + at + host.replace(".", dot)
    if kind == 1:
        return old.replace(".", pick(" . ", "[.]", " dot ", "-"))
    if kind == 2:
        d = _DIGITS.sub("", old)
        return pick(".", "/", "  ", " - ").join(d[i : i + 4] for i in range(0, len(d), 4))
    return pick(old[1:], "00" + old[1:], old[1:].split(" ", 1)[-1], old.replace("+", "+ "), re.sub("[ ()-]+", ".", old[1:]))


def vary(text: str, spans, rng) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with one rewriting of each span that the rules would miss, and the spans' new places."""
    out, at, moved, size = [], 0, [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start < at:
            continue
        new = _variant(kind, text[start:end], rng)
        out += [text[at:start], new]
        size += start - at
        moved.append((kind, size, size + len(new)))
        size += len(new)
        at = end
    return "".join(out) + text[at:], moved


def training_windows(texts: list[str], seed: int = 10, rules: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: around each rule's span (with ``rules``), around its variant, around digits without a span, and anywhere."""
    rng = np.random.Generator(np.random.PCG64(seed))
    chars, tags = [], []
    for text in texts:
        spans = base_spans(text)
        for s, own in ([(text, spans)] if rules or not spans else []) + ([vary(text, spans, rng)] if spans else []):
            ids, marks = char_ids(s), tag_row(len(s), own)
            middles = [(a + b) // 2 for _, a, b in own] or [m.start() for m in _ANCHOR.finditer(s)][:2]
            for middle in [*middles, int(rng.integers(0, len(s) + 1))]:
                begin = max(0, min(middle - int(rng.integers(20, LEARNED - 20)), len(ids) - LEARNED))
                piece, mark = ids[begin : begin + LEARNED], marks[begin : begin + LEARNED].copy()
                if len(mark) and mark[0] and mark[0] % 2 == 0:
                    # a span that begins before the window begins with it
                    mark[0] -= 1
                chars.append(np.pad(piece, (0, LEARNED - len(piece)), constant_values=32))
                tags.append(np.pad(mark, (0, LEARNED - len(mark))))
    return (np.array(chars), np.array(tags)) if chars else (np.zeros((0, LEARNED), np.int16), np.zeros((0, LEARNED), np.int64))


def repeated_words(texts: list[str], most: int = 300, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Windows without a span in which one or two words of a text stand over and over, as junk has them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    chars = []
    for text in texts[:most]:
        words = [w for w in text.split()[:200] if not _ANCHOR.search(w)]
        if words:
            own = " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(1, 3)))) + " "
            lead = " ".join(words[:5])[: int(rng.integers(0, LEARNED // 2))]
            chars.append(char_ids((lead + own * LEARNED)[:LEARNED]))
    return np.array(chars, np.int16).reshape(-1, LEARNED), np.zeros((len(chars), LEARNED), np.int64)


def mistaken(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows around what the network takes for spans in texts where the rules have none there, with the rules' tags."""
    base = [base_spans(t) for t in texts]
    chars, tags = [], []
    for text, own, wrong in zip(texts, base, added_spans(net, texts, base), strict=True):
        ids, marks = char_ids(text), tag_row(len(text), own)
        for _, a, b in wrong:
            begin = max(0, min((a + b - LEARNED) // 2, len(ids) - LEARNED))
            piece, mark = ids[begin : begin + LEARNED], marks[begin : begin + LEARNED].copy()
            if len(mark) and mark[0] and mark[0] % 2 == 0:
                mark[0] -= 1
            chars.append(np.pad(piece, (0, LEARNED - len(piece)), constant_values=32))
            tags.append(np.pad(mark, (0, LEARNED - len(mark))))
    return np.array(chars, np.int16).reshape(-1, LEARNED), np.array(tags, np.int64).reshape(-1, LEARNED)


def calibrate(net: Network, chars, tags, precision: float = 0.98) -> Network:
    """Sets the smallest margin of a grid with which so many of the spans found in windows of texts that taught nothing are
    the labelled ones (spans at a window's edge don't count); the last one, where none does."""
    inside = lambda rows: {(r, *s) for r, row in enumerate(rows) for s in spans_of(row) if s[1] > 0 and s[2] < len(row)}
    gold = inside(tags)
    for margin in (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0):
        found = inside(net.decode(chars, margin))
        right = len(found & gold)
        net.margin, net.held_out = margin, (right / max(len(found), 1), right / max(len(gold), 1), len(gold))
        if right >= precision * len(found):
            break
    return net


def _fits(kind: int, found: str) -> bool:
    """A card's digits pass Luhn's test: of numbers of 16 digits that stand in ``sf0.1`` outside the rules' spans none is
    a card by it, and no network of this size can learn it. Spans of all kinds stay within a line."""
    return "\n" not in found and (kind != 2 or luhn(_DIGITS.sub("", found)))


def _joined(spans, cut):
    """``spans`` and, of those that a window's edge cuts off, what they are with the pieces of their kind that go on beyond it."""
    edges = {(k, a, b): (left, right) for k, a, b, left, right in cut}
    pieces = {(*s, *edges.get(s, (False, False))) for s in spans} | set(cut)
    out = list(spans)
    for kind, start, end in spans:
        left, right = edges.get((kind, start, end), (False, False))
        a, b = start, end
        while right:
            b, right = max(((y, r) for k, x, y, l, r in pieces if k == kind and y > b and (x < b or x == b and l)), default=(b, False))
        while left:
            a, go = min(((x, not l) for k, x, y, l, r in pieces if k == kind and x < a and (y > a or y == a and r)), default=(a, True))
            left = not go
        if (a, b) != (start, end):
            out.append((kind, a, b))
    return out


def added_spans(net: Network, texts: list[str], base: list[list[tuple[int, int, int]]], batch: int = 768) -> list[list[tuple[int, int, int]]]:
    """Spans that the network adds to the rules' ones, for each text."""
    edge = (WINDOW - STRIDE) / 2
    coded = [char_ids(t) for t in texts]
    counts = [max(1, -(-(len(ids) - (WINDOW - STRIDE)) // STRIDE)) if len(ids) else 0 for ids in coded]
    # windows of a size stand together, so that the last ones of texts are not filled up with blanks
    size = lambda w: min(WINDOW, len(coded[w[0]]) - w[1] * STRIDE)
    todo = sorted(((i, k) for i, n in enumerate(counts) for k in range(n)), key=size)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    cut: list[list[tuple[int, int, int, bool, bool]]] = [[] for _ in texts]
    for lo in range(0, len(todo), batch):
        part = todo[lo : lo + batch]
        chars = np.full((len(part), min(WINDOW, size(part[-1]) + 1)), 32, np.int16)
        for row, (i, k) in zip(chars, part, strict=True):
            piece = coded[i][k * STRIDE : k * STRIDE + WINDOW]
            row[: len(piece)] = piece
        tags = net.decode(chars)
        for r in np.flatnonzero(tags.any(1)).tolist():
            i, k = part[r]
            begin = k * STRIDE
            for kind, s, e in spans_of(tags[r]):
                middle = (s + e) / 2
                if (k == 0 or middle >= edge) and (k == counts[i] - 1 or middle < WINDOW - edge):
                    found[i].append((kind, begin + s, begin + e))
                left, right = s == 0 and begin > 0, e == WINDOW and begin + WINDOW < len(coded[i])
                if left or right:
                    cut[i].append((kind, begin + s, begin + e, left, right))
    found = [_joined(spans, pieces) if pieces else spans for spans, pieces in zip(found, cut, strict=True)]
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        taken = sorted((a, b) for _, a, b in own)
        added: list[tuple[int, int, int]] = []
        end = -1
        for kind, a, b in sorted(set(spans), key=lambda s: (s[1], -s[2])):
            b = min(b, len(text))
            if a < end or any(x < b and a < y for x, y in taken) or b - a > net.longest or not _fits(kind, text[a:b]):
                continue
            added.append((kind, a, b))
            end = b
        out.append(added)
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def learn(texts: list[str], *, steps: int = 600) -> Network | None:
    """A network from labelled windows, then from these and what it mistook in the same texts; its margin is set on every
    fifth text, which teaches nothing. None if the rules find nothing in the others."""
    own, held = [t for i, t in enumerate(texts) if i % 5], texts[::5]
    chars, tags = training_windows(own)
    if not tags.any():
        return None
    chars, tags = (np.concatenate(x) for x in zip((chars, tags), repeated_words(own), strict=True))
    net = train(chars, tags, steps=2 * steps // 3)
    wrong = mistaken(net, own[:: max(1, len(own) // 400)])
    chars, tags = (np.concatenate([x, *[w] * 4]) for x, w in zip((chars, tags), wrong, strict=True))
    net = train(chars, tags, steps=steps // 3, rate=0.01, net=net)
    # nothing is known of spans far longer than those learned from
    net.longest = 2 * max(e - s for row in tags for _, s, e in spans_of(row))
    ours, repeats = training_windows(held, seed=11, rules=False), repeated_words(held, seed=11)
    return calibrate(net, *(np.concatenate(x) for x in zip(ours, repeats, strict=True)))


#: Texts that may hold a span of the rules, for Spark's engine; each pattern takes linear time.
_LIKELY = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[ -]?[0-9]){15}|\+[0-9][ ().0-9-]{6}"


def fit(docs: DataFrame, *, max_texts: int = 1500, max_chars: int = 4000, id_col: str = "doc_id", text_col: str = "text", steps: int = 600) -> Network | None:
    """A network from a bounded sample of texts of at most ``max_chars`` characters: of all that the rules' signs stand in,
    the ``max_texts`` of the smallest hashes of their ids, and a quarter as many of others. Every fifth of them
    teaches nothing but sets the margin. None if the rules find nothing in them."""
    rows = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars)).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    likely = F.col("text").rlike(_LIKELY)
    with_signs = rows.where(likely).orderBy("h", "text").limit(max_texts)
    share = min(1.0, 8 * max_texts / max(rows.count(), 1))
    others = rows.where((F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20))) & ~likely).orderBy("h", "text").limit(max_texts // 4)
    return learn([r["text"] for df in (with_signs, others) for r in df.collect()], steps=steps)


def _spans_of(net: Network | None, texts: list[str]):
    base = [base_spans(t) for t in texts]
    return base, added_spans(net, texts, base) if net is not None else [[] for _ in texts]


def find_pii(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` of every row.

    The counts and the digest are of the rules' spans; ``spans`` lists all of them, the network's
    too, as ``kind:start:end`` in code points, end exclusive, by kind and start. Null and empty texts have none. Null and
    repeated ids are carried; an empty table gives none."""

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                base, added = _spans_of(net, texts)
                counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(_listed(own).encode()).hexdigest() for own in base], pa.string())
                spans = pa.array([_listed(own + more) for own, more in zip(base, added, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *counts, sha, spans, pa.array([len(a) for a in added], pa.int64())], ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind, as ``[email]``; spans that overlap become one,
    named by the first. Other columns stay; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(at)):
                part, out = batch.slice(lo, hi - lo), []
                texts = part.column(at).cast(pa.string()).to_pylist()
                base, added = _spans_of(net, [t or "" for t in texts])
                for text, own, more in zip(texts, base, added, strict=True):
                    parts, end = [], 0
                    for kind, a, b in sorted(own + more, key=lambda s: (s[1], -s[2])):
                        if a >= end:
                            parts += [text[end:a], f"[{KINDS[kind]}]"]
                        end = max(end, b)
                    out.append(text if not parts else "".join(parts) + text[end:])
                columns = [pa.array(out, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def op10_pii(spark, sf_dir):
    """Personal data in all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))
