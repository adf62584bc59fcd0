"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across: between two characters that no
piece holds side by side. So each cut segment ("word") is encoded alone, exactly. The distinct
unseen words of a block of texts become one flat array of symbols; each round looks up all
neighbouring pairs in a hash table, takes every word's best pair (segmented minimum of the rank),
merges its occurrences from the left at once, and compacts the array until no pair is left.
Texts are bytes of Arrow columns all the way: they are cut, their words looked up and the ids of
known words put together by array operations, without a Python object for each (long words apart).

Merging several occurrences at once could differ from the library's one-by-one order if a merge
made a neighbouring pair as good as the one being merged. Words where that occurs are found and
done again with one merge a round, so the result is always the library's."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import table
from ._words import PIECE, WordTable, chunks, mix, text_bytes

#: Words that a Python worker remembers, and bytes of them with their ids in decimal (some 100 and 2 bytes each); then it starts anew.
MAX_CACHED_WORDS, MAX_CACHED_BYTES = 600_000, 32_000_000
#: Longer words, in bytes, are remembered in a dict. Words that are looked up at a time: bounds the temporary arrays.
LONG, BLOCK_WORDS = 64, 1 << 18
_NONE = np.int64(1) << np.int64(40)
SPACE = "▁"


class PairTable:
    """Open-addressing hash table from pairs of ids to (rank, merged id), probed for whole arrays."""

    def __init__(self, left, right, rank, merged):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(left))
        keys = (left << 32) | right
        at = self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = keys[todo[put]], rank[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Rank (a huge one where the pair has no piece) and merged id."""
        keys = (left << 32) | right
        at = self._slot(keys)
        got = self.keys[at]
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            open_ = open_[(got != keys[open_]) & (got != -1)]
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], _NONE), self.merged[at]


def merge_rounds(pairs: PairTable, ids, segment, single: bool = False):
    """All merge rounds over flat symbols; ``segment`` is non-decreasing. single: one merge a word and round."""
    done_ids, done_seg = [], []
    origin_ids, origin_seg = ids, segment
    unsure: list[np.ndarray] = []
    while len(ids):
        same = segment[1:] == segment[:-1]
        rank = np.full(len(ids), _NONE, np.int64)
        merged = np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(same)
        rank[inner], merged[inner] = pairs.find(ids[inner], ids[inner + 1])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(ids)))
        over = np.repeat(best == _NONE, sizes)
        done_ids.append(ids[over])
        done_seg.append(segment[over])
        live = ~over
        ids, segment, rank, merged = ids[live], segment[live], rank[live], merged[live]
        best, sizes = best[best != _NONE], sizes[best != _NONE]
        if not len(ids):
            break
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        seg = segment[hit]
        if single:
            take = hit[np.concatenate([[True], seg[1:] != seg[:-1]])]
        else:  # in a run of overlapping pairs, every second from its left
            run = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (seg[1:] != seg[:-1])])
            begin = hit[run][np.cumsum(run) - 1]
            take = hit[(hit - begin) % 2 == 0]
            many = np.concatenate([[False], segment[take][1:] == segment[take][:-1]])
            many[:-1] |= many[1:]
            m = take[many]
            if len(m):
                follows = (m + 2 < len(ids)) & (segment[np.minimum(m + 2, len(ids) - 1)] == segment[m])
                f = m[follows]
                r, _ = pairs.find(merged[f], ids[f + 2])
                unsure.append(segment[f[r <= rank[f]]])
        was = rank[take]
        ids[take] = merged[take]
        keep = np.ones(len(ids), bool)
        keep[take + 1] = False
        moved = np.cumsum(keep) - 1
        ids, segment = ids[keep], segment[keep]
        if not single and len(m):
            k = moved[m]
            was = rank[m]
            for a in (k - 1, k):
                ok = (a >= 0) & (a + 1 < len(ids))
                ok[ok] = segment[a[ok]] == segment[a[ok] + 1]
                r, _ = pairs.find(ids[a[ok]], ids[a[ok] + 1])
                unsure.append(segment[k[ok]][r <= was[ok]])
    ids, segment = np.concatenate(done_ids or [ids]), np.concatenate(done_seg or [segment])
    again = np.unique(np.concatenate(unsure)) if unsure else np.zeros(0, np.int64)
    if len(again):
        fine, redo = ~np.isin(segment, again), np.isin(origin_seg, again)
        more_ids, more_seg = merge_rounds(pairs, origin_ids[redo], origin_seg[redo], single=True)
        ids, segment = np.concatenate([ids[fine], more_ids]), np.concatenate([segment[fine], more_seg])
    order = np.argsort(segment, kind="stable")
    return ids[order], segment[order]


class PieceModel:
    """Vocabulary, pair table and cut rule of a BPE model file with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.hidden = {i for i in range(size) if sp.is_control(i)}
        self.unk = sp.unk_id()
        normal = [i for i in range(size) if not (self.is_byte[i] or i in self.hidden or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.is_byte[i]}
        scores = {i: sp.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # symbols: ids of pieces, then ids of characters that are no piece themselves
        self.n = size
        rows = [(self.id_of[p[:k]], self.id_of[p[k:]], order[scores[i]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        rows += self._through_bare_characters(order, scores)
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
        self.number = pa.array([f"{i}," for i in range(size)], pa.large_binary())
        #: Bytes that a piece stands for; 0xFF, which no text holds, for those that stand for none.
        self.raw = pa.array([bytes([int(p[3:5], 16)]) if self.is_byte[i] else b"\xff" if i in self.hidden or i == self.unk else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)], pa.large_binary())
        self.joined = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.cut = self._cut_rule()

    def _through_bare_characters(self, order, scores):
        """Merges whose parts include a character that is no piece (none in usual models)."""
        self.bare: dict[str, int] = {}
        for p in self.id_of:
            for c in p:
                if c not in self.id_of:
                    self.bare.setdefault(c, self.n + len(self.bare))
        full = self.id_of | self.bare
        return [(full[p[:k]], full[p[k:]], order[scores[i]], i) for p, i in self.id_of.items() if self.bare for k in range(1, len(p)) if p[:k] in full and p[k:] in full and (p[:k] in self.bare or p[k:] in self.bare)]

    def _cut_rule(self):
        """Whether texts may first be cut cheaply: a run of spaces with the characters up to the next space or line feed.
        Only sound where no piece holds a space behind another character, or a line feed."""
        return not any(SPACE in p[1:] and p.strip(SPACE) or "\n" in p for p in self.id_of)

    def word_bounds(self, buf, at):
        """Starts and ends of the segments of texts, which are UTF-8 with spaces and their dummy prefixes."""
        start = np.zeros(len(buf) + 1, bool)
        if self.cut and len(buf):
            space, line = buf == 0x20, buf == 0x0A
            start[1:-1] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
        start[at] = True
        bounds = np.flatnonzero(start)
        return bounds[:-1], bounds[1:]

    def _joinable(self, number, symbols):
        """Whether a piece holds each two neighbouring characters side by side."""
        pair = number[:-1].astype(np.int64) * len(symbols) + number[1:]
        if len(symbols) ** 2 > 1 << 22:  # too many for a table of all pairs
            kinds, pair = np.unique(pair, return_inverse=True)
        else:
            there = np.zeros(len(symbols) ** 2, bool)
            there[pair] = True
            kinds = np.flatnonzero(there)
            at = np.zeros(len(there), np.int32)
            at[kinds] = np.arange(len(kinds))
            pair = at[pair]
        return np.array([symbols[k // len(symbols)] + symbols[k % len(symbols)] in self.joined for k in kinds.tolist()], bool)[pair]

    def encode_words(self, buf, sizes):
        """Ids of words of so many bytes each, that follow one another in ``buf``, and their numbers; spaces stand for the space piece."""
        chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.where(chars == 0x20, np.uint32(ord(SPACE)), chars)
        lengths = np.add.reduceat((buf & 0xC0) != 0x80, np.cumsum(sizes) - sizes, dtype=np.int64)
        present = np.zeros(0x110000, bool)
        present[chars] = True
        codes = np.flatnonzero(present)
        number = np.zeros(0x110000, np.int32)
        number[codes] = np.arange(len(codes))
        inverse = number[chars]
        symbols = [chr(c) for c in codes]
        new: dict[str, int] = {}
        known = self.id_of | self.bare
        ids = np.array([known.get(s, new.setdefault(s, self.n + len(self.bare) + len(new)) if s not in known else 0) for s in symbols], np.int64)[inverse]
        word = np.repeat(np.arange(len(sizes)), lengths)
        cut = np.ones(len(ids), bool)
        if len(ids) > 1:
            cut[1:] = (word[1:] != word[:-1]) | ~self._joinable(inverse, symbols)
        segment = np.cumsum(cut) - 1
        owner = word[cut]
        ids, segment = merge_rounds(self.pairs, ids, segment)
        owner = owner[segment]
        odd = ids >= self.n
        if odd.any():
            spelled = {i: [self.byte_id[b] for b in s.encode()] if len(self.byte_id) == 256 else [self.unk] for s, i in (new | self.bare).items()}
            lists = [spelled[i] for i in ids[odd].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(x) for x in lists]
            ids, owner, odd = np.repeat(ids, times), np.repeat(owner, times), np.repeat(odd, times)
            ids[odd] = [y for x in lists for y in x]
        return ids, np.bincount(owner, minlength=len(sizes))

    def decode(self, ids: list[int], start: bool = True) -> str:
        """Text of any ids as the library decodes them; start: drop the dummy prefix of the first piece."""
        out, raw = [], bytearray()
        for i in ids:
            if self.is_byte[i]:
                raw.append(int(self.pieces[i][3:5], 16))
                start = False
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i in self.hidden:
                continue
            piece = " ⁇ " if i == self.unk else self.pieces[i].replace(SPACE, " ")
            out.append(piece[1:] if start and piece[:1] == " " and i != self.unk else piece)
            start = False
        return "".join(out) + (_utf8(raw) if raw else "")


def _utf8(raw: bytearray) -> str:
    """Each byte that starts no whole character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        size = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            out.append(raw[i : i + size].decode())
            i += size
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


_K = np.uint64(0x9E3779B97F4A7C15)
#: The lowest 0 to 8 bytes of a lane.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lanes(buf):
    """The 8 bytes from each place of ``buf`` on, as a view of a copy with zeros behind."""
    return np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=1)


def _ranges(starts, sizes):
    """All places of the ranges, one range behind the other."""
    at = np.cumsum(sizes)
    return np.repeat(starts - at + sizes, sizes) + np.arange(at[-1] if len(at) else 0)


def _taken(values: pa.Array, rows):
    """The bytes of the rows' values one behind the other, and their n + 1 offsets."""
    if not len(rows):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = values.take(pa.array(rows)).buffers()
    at = np.frombuffer(at, np.int64, len(rows) + 1)
    return np.frombuffer(data, np.uint8)[: at[-1]], at


def _sums(values, at):
    """Sums of the parts of ``values`` that the n + 1 offsets bound, 0 for empty ones."""
    out, full = np.zeros(len(at) - 1, np.int64), np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full], dtype=np.int64)
    return out


class Encoder:
    """Encodes and decodes texts with a bounded memory of words.

    A word is looked up by a hash, and its bytes are compared, 8 at a time, with those of the word found there. Long ones, and
    those whose hash is another word's, are looked up in a dict."""

    def __init__(self, path: str):
        self.model = load(path)
        self.forget()

    def forget(self):
        self.table, self.odd, self.held = WordTable(), {}, 0
        #: Of each word its bytes, whether it is decoded to itself, its lanes, its ids, and these in decimal, each with a comma behind.
        self.sizes, self.same = np.zeros(0, np.int64), np.zeros(0, bool)
        self.lanes, self.lanes_at = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, words, sizes):
        """Rows of new words of so many bytes each, that follow one another in ``words``."""
        ids, counts = self.model.encode_words(words, sizes)
        ids_at, starts = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes) - sizes
        text, text_at = _taken(self.model.number, ids)
        raw, raw_at = _taken(self.model.raw, ids)
        raw_at = raw_at[ids_at]
        same = np.diff(raw_at) == sizes
        if not (same.all() and np.array_equal(raw, words)):
            for k in np.flatnonzero(same).tolist():
                same[k] = np.array_equal(raw[raw_at[k] : raw_at[k + 1]], words[starts[k] : starts[k] + sizes[k]])
        n = np.where(sizes <= LONG, (sizes + 7) // 8, 0)
        nth = _ranges(np.zeros(len(n), np.int64), n)
        lanes = _lanes(words)[np.repeat(starts, n) + 8 * nth] & _LOW[np.minimum(np.repeat(sizes, n) - 8 * nth, 8)]
        rows = len(self.sizes) + np.arange(len(sizes))
        self.sizes, self.same = np.concatenate([self.sizes, sizes]), np.concatenate([self.same, same])
        self.lanes, self.lanes_at = np.concatenate([self.lanes, lanes]), np.concatenate([self.lanes_at, self.lanes_at[-1] + np.cumsum(n)])
        self.ids, self.ids_at = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.ids_at, self.ids_at[-1] + ids_at[1:]])
        self.text, self.text_at = np.concatenate([self.text, text]), np.concatenate([self.text_at, self.text_at[-1] + text_at[ids_at[1:]]])
        self.held += len(words) + len(text)
        return rows

    def _hashes(self, lanes, starts, sizes):
        """A hash of each word of at most LONG bytes; and in rounds which words have another lane, and that lane."""
        h, here, rounds = sizes.astype(np.uint64), np.flatnonzero(sizes <= LONG), []
        while len(here):
            k = 8 * len(rounds)
            rounds.append((here, lanes[starts[here] + k] & _LOW[np.minimum(sizes[here] - k, 8)]))
            x = (h[here] ^ rounds[-1][1]) * _K
            h[here] = x ^ (x >> np.uint64(32))
            here = here[sizes[here] > k + 8]
        return mix(h), rounds

    def _rows(self, buf, lanes, starts, ends):
        """The row of each word; new ones are learned."""
        sizes = ends - starts
        hashes, rounds = self._hashes(lanes, starts, sizes)
        right = sizes <= LONG
        short = np.flatnonzero(right)
        rows = np.full(len(starts), -1, np.int64)
        rows[short] = self.table.find(hashes[short])
        new = short[rows[short] < 0]
        if len(new):
            keys, where = np.unique(hashes[new], return_index=True)
            where = new[where]
            self.table.add(keys, self._learn(buf[_ranges(starts[where], sizes[where])], sizes[where]))
            rows[new] = self.table.find(hashes[new])
        right[short] = self.sizes[rows[short]] == sizes[short]
        for k, (here, lane) in enumerate(rounds):
            right[here] &= self.lanes.take(self.lanes_at[rows[here]] + k, mode="clip") == lane
        odd = np.flatnonzero(~right)
        if len(odd):
            words = [buf[a:b].tobytes() for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            fresh = [w for w in dict.fromkeys(words) if w not in self.odd]
            if fresh:
                got = self._learn(np.frombuffer(b"".join(fresh), np.uint8), np.array([len(w) for w in fresh], np.int64))
                self.odd.update(zip(fresh, got.tolist(), strict=True))
            rows[odd] = [self.odd[w] for w in words]
        return rows

    def encode(self, column: pa.Array):
        """Rows of the words of all texts, the n + 1 offsets of each text's words, and the texts decoded from their ids, in UTF-8; null texts are empty."""
        if len(self.sizes) > MAX_CACHED_WORDS or self.held > MAX_CACHED_BYTES:
            self.forget()
        buf, _ = text_bytes(column)
        column = column.cast(pa.large_string()).fill_null("")
        if SPACE.encode() in buf.tobytes():
            column = pc.replace_substring(column, SPACE, " ")
        none = pa.scalar("", pa.large_string())
        buf, at = text_bytes(pc.if_else(pc.equal(column, none), none, pc.binary_join_element_wise(none, column, pa.scalar(" ", pa.large_string()))))
        starts, ends = self.model.word_bounds(buf, at)
        rows, lanes = np.empty(len(starts), np.int64), _lanes(buf)
        for k in range(0, len(starts), BLOCK_WORDS):
            own = slice(k, k + BLOCK_WORDS)
            rows[own] = self._rows(buf, lanes, starts[own], ends[own])
        words_at = np.searchsorted(starts, at)
        decoded = [memoryview(buf)[a + 1 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in np.flatnonzero(_sums(~self.same[rows], words_at)).tolist():
            ids, _ = self.id_lists(rows[words_at[i] : words_at[i + 1]])
            decoded[i] = self.model.decode(ids.tolist()).encode()
        return rows, words_at, decoded

    def id_lists(self, rows):
        """The ids of the words of ``rows``, and their n + 1 offsets."""
        n = np.diff(self.ids_at)[rows]
        return self.ids[_ranges(self.ids_at[rows], n)], np.concatenate([[0], np.cumsum(n)])

    def id_texts(self, rows, words_at):
        """Each text's ids in decimal, joined by commas."""
        known = pa.Array.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(self.text_at), pa.py_buffer(self.text)])
        buf, at = _taken(known, rows)
        at = at[words_at].tolist()
        return [memoryview(buf)[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]

    def counts(self, rows, words_at):
        """Each text's number of ids."""
        return _sums(np.diff(self.ids_at).astype(np.int32)[rows], words_at)

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of each text."""
        rows, words_at, decoded = self.encode(pa.array(texts, pa.large_string()))
        return [(bytes(i).decode(), bytes(d).decode()) for i, d in zip(self.id_texts(rows, words_at), decoded, strict=True)]


def _digests(path: str):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for lo, hi in chunks(batch.column(1), 4 * PIECE):
                rows, words_at, decoded = encoder.encode(batch.column(1).slice(lo, hi - lo))
                sha = [pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (encoder.id_texts(rows, words_at), decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(encoder.counts(rows, words_at), pa.int64()), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for lo, hi in chunks(batch.column(1), 4 * PIECE):
                rows, words_at, decoded = encoder.encode(batch.column(1).slice(lo, hi - lo))
                ids, at = encoder.id_lists(rows)
                lists = pa.ListArray.from_arrays(pa.array(at[words_at], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array([bytes(d).decode() for d in decoded], pa.string())], ["id", "ids", "decoded"])

    return run


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>, decoded string)`` for every row: the ids of the whole text and
    the text decoded from them. Null texts are empty: no ids, an empty text. Other columns and
    repeated or null ids don't matter; an empty table gives none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_encoded(model or model_path()), "id long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the text of any ids, as the library decodes them. Null ids give an empty text; ids outside the vocabulary are an error."""
    path = model or model_path()

    def run(batches):
        coder = load(path)
        for batch in batches:
            texts = [coder.decode([i for i in ids or () if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of :func:`encode`'s results, digested where they are made."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(model or model_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark, sf_dir):
    """Encodes and decodes every whole text of ``documents``."""
    return token_digests(table(spark, sf_dir, "documents"))
