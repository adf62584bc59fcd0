"""Ids of a word-level BPE tokenizer file for whole Arrow columns.

Texts of ASCII and Latin-1 letters are cut to the tokenizer's own pre-tokens (runs of letters,
single digits, runs of other signs) by array operations over their bytes; a hash table keeps the
ids of the words met, and new words are merged in vectorised rounds. Any other text (or one with an
apostrophe or ``<|``, where the rules are special) goes through the tokenizers library whole. Both
ways give the library's ids."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from ._words import WordTable, range_hashes, text_bytes
from .piece_bpe import PairTable, merge_rounds

#: Words that a Python worker remembers, and ids of them (about 60 and 4 bytes each); then it starts anew.
MAX_CACHED_WORDS, MAX_CACHED_IDS = 300_000, 8_000_000

_LETTER, _DIGIT, _SPACE, _OTHER, _FOREIGN = range(5)
_CLASS = np.full(256, _FOREIGN, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_CLASS[ord("'")] = _FOREIGN
_CLASS[0x80:0xC0] = _LETTER  # continuation bytes: judged by the byte before them
_CLASS[0xC3] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rows = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
        self.forget()

    @property
    def library(self):
        """The tokenizers library's own tokenizer; loaded when a text needs it (some 60 MB)."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def forget(self):
        self.table, self.flat, self.at = WordTable(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, buf, starts, ends, hashes):
        sizes = ends - starts
        first = np.concatenate([[0], np.cumsum(sizes)])
        symbols = buf[np.repeat(starts - first[:-1], sizes) + np.arange(first[-1])]
        ids = self.inner[symbols]
        ids[first[1:] - 1] = self.last[symbols[first[1:] - 1]]
        ids, word = merge_rounds(self.pairs, ids, np.repeat(np.arange(len(sizes)), sizes))
        self.table.add(hashes, len(self.at) - 1 + np.arange(len(sizes)))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(word, minlength=len(sizes)))])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def _plain(self, buf, at) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows that hold plain texts only, and their n + 1 offsets."""
        buf = _LOWER[buf]
        high = np.flatnonzero((buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97))
        buf[high] += 32
        kind = _CLASS[buf]
        edge = np.ones(len(buf) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge[at] = True
        bounds = np.flatnonzero(edge)
        starts, ends = bounds[:-1], bounds[1:]
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        hashes = range_hashes(buf, starts, ends, lower=False)
        if self.table.n > MAX_CACHED_WORDS or len(self.flat) > MAX_CACHED_IDS:
            self.forget()
        rows = self.table.find(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, where = np.unique(hashes[new], return_index=True)
            where = new[where]
            self._learn(buf, starts[where], ends[where], fresh)
            rows[new] = self.table.find(hashes[new])
        sizes = np.diff(self.at)[rows]
        out_at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.at[rows] - out_at[:-1], sizes) + np.arange(out_at[-1])]
        return ids, out_at[np.searchsorted(starts, at)]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of each row; null rows have none."""
        buf, at = text_bytes(column)
        odd = _CLASS[buf] == _FOREIGN
        if len(buf) > 1:
            odd[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)) | (buf[:-1] == 0x3C) & (buf[1:] == 0x7C)
        foreign = np.diff(np.concatenate([[0], np.cumsum(odd)])[at]) > 0
        plain = np.flatnonzero(~foreign)
        out: list[np.ndarray] = [None] * len(column)  # type: ignore[list-item]
        if not foreign.any():
            pieces, ids_at = buf, at
        else:
            sizes = np.diff(at)[plain]
            ids_at = np.concatenate([[0], np.cumsum(sizes)])
            pieces = buf[np.repeat(at[:-1][plain] - ids_at[:-1], sizes) + np.arange(ids_at[-1])]
        if len(plain):
            ids, ends = self._plain(pieces, ids_at) if len(pieces) else (np.zeros(0, np.uint32), np.zeros(len(plain) + 1, np.int64))
            for k, i in enumerate(plain.tolist()):
                out[i] = ids[ends[k] : ends[k + 1]]
        for i in np.flatnonzero(foreign).tolist():
            out[i] = np.array(self.library.encode(buf[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        return out
