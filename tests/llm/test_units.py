"""Parts that run without Spark, against brute force, libraries or exact properties."""

import random
import re
import subprocess
import sys
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from arborq.llm import near_dup, packing, pii, piece_bpe, quality_model, toxicity
from arborq.llm._words import chunks, shingles_of, words_of
from arborq.llm.neighbours import SortedProjections
from arborq.llm.piece_bpe import Encoder, model_path
from arborq.llm.toxicity import fit_ordinal
from arborq.llm.word_bpe import WordBPE

ODD = ["", None, " ", "a", "A b\tc\x0bd\n", "é ñ ß ÀÉ", "x" * 3000, "ab" * 999, "=" * 333, "  two  spaces ", "▁x a▁b", "\xa0nb", "it's <|endoftext|>", "😀한국 日本", "\x00\r\n", "1234 5.6"]


def noise(n, seed=1, alphabet="abcdeéñ ▁\n\t.,!<>0123😀한日́"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_and_shingles():
    texts = ODD + noise(300)
    hashes, at = words_of(pa.array(texts))
    split = [[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in split]
    seen = {}
    for h, w in zip(hashes.tolist(), (w for s in split for w in s), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    _, ends = shingles_of(pa.array(texts), 4)
    want = [len({tuple(s[i : i + 4]) for i in range(len(s) - 3)}) if len(s) >= 4 else min(len(s), 1) for s in split]
    assert np.diff(ends).tolist() == want
    assert [r for r in chunks(pa.array(texts), 50)][-1][1] == len(texts)


def test_piece_encoding_is_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = ODD + noise(1500) + noise(1500, 2, " the ingan.erer")
    for text, (ids, decoded) in zip(texts, Encoder(model_path()).run([t or "" for t in texts]), strict=True):
        want = sp.encode(text or "")
        assert ids == ",".join(map(str, want)) and decoded == sp.decode(want)


def test_piece_encoding_has_no_call_for_a_word():
    """A column of 20,000 words, none of them met before, then met before, takes fewer Python and C calls than words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abdeinorst") for _ in range(12)) for _ in range(20_000)]
    column, encoder, calls = pa.array([" ".join(words[i : i + 500]) for i in range(0, 20_000, 500)]), Encoder(model_path()), [0, 0]
    for k in range(2):
        sys.setprofile(lambda frame, event, arg, k=k: calls.__setitem__(k, calls[k] + event.endswith("call")))
        try:
            encoder.run(column.to_pylist())
        finally:
            sys.setprofile(None)
    assert calls[0] < 15_000 and calls[1] < 1_500


@pytest.mark.parametrize("same_hash, words, block, long", [(False, 600_000, 1 << 18, 64), (True, 600_000, 1 << 18, 64), (False, 20, 7, 64), (False, 600_000, 1 << 18, 8), (False, 600_000, 5, 0)])
def test_piece_encoding_with_shared_hashes_and_little_memory(monkeypatch, same_hash, words, block, long):
    """Words whose hashes are the same, that are long, or don't differ but in trailing zeros, blocks within a text, and memories that start anew."""
    monkeypatch.setattr(piece_bpe, "MAX_CACHED_WORDS", words)
    monkeypatch.setattr(piece_bpe, "BLOCK_WORDS", block)
    monkeypatch.setattr(piece_bpe, "LONG", long)
    if same_hash:
        monkeypatch.setattr(piece_bpe, "mix", lambda h: h % np.uint64(3))
    sp, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path()), Encoder(model_path())
    edges = ["a\x00 a a\x00\x00 b", *("z" * n + " " + "z" * (n - 1) + "y" for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 200)), "日本" * 40 + " x", "▁", "▁▁ ", "\n\n", " \n ", "<unk> <s></s> <0x41>", "a" * 5000 + " b" * 5000]
    texts = ODD + edges + noise(300, 7) + ODD + edges
    for part in (texts[:40], [], [None], [""], texts[40:], texts):
        for text, (ids, decoded) in zip(part, encoder.run(part), strict=True):
            want = sp.encode(text or "")
            assert ids == ",".join(map(str, want)) and decoded == sp.decode(want)


def test_piece_encoding_without_byte_pieces():
    """A model whose unknown characters are lost when decoded, and one whose pieces forbid the cut at spaces."""
    model = piece_bpe.PieceModel(model_path())
    ids, counts = model.encode_words(np.frombuffer(b" the\xe6\x97\xa5", np.uint8), np.array([4, 3]))
    uncut = Encoder(model_path())
    texts = [*ODD, *noise(50, 3)]
    want = uncut.run(texts)
    uncut.model, uncut.model.cut = model, False
    uncut.forget()
    assert uncut.run(texts) == want
    model.byte_id, model.cut = {}, True
    uncut.forget()
    lost = model.decode([model.unk])
    assert uncut.run(["the \U0001f9ff the", "the"]) == [(f"{model.id_of['▁the']},{model.id_of['▁']},{model.unk},{model.id_of['▁the']}", f"the {lost} the"), (f"{model.id_of['▁the']}", "the")]
    assert counts.sum() == len(ids)


def test_word_encoding_is_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordBPE(path)
    texts = ODD + noise(800) + noise(1500, 2, "abcdeéñÉÑß .,!0123")
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [a.tolist() for a in own.encode(pa.array(texts))] == want


def test_packing_plan_places_all():
    rng = np.random.default_rng(0)
    for case in (np.zeros(2049, int), np.bincount([1] * 5, minlength=2049), np.bincount(rng.integers(1, 2049, 5000), minlength=2049), np.bincount(rng.geometric(0.01, 9000).clip(1, 2048), minlength=2049)):
        blocks = sorted(packing.plan(case))
        placed = np.zeros(2049, int)
        after = 0
        for first, times, lengths in blocks:
            assert first == after and sum(lengths) <= 2048
            after += times
            for x in lengths:
                placed[x] += times
        assert (placed == case).all()
        assert after <= -(-int(case @ np.arange(2049)) // 2048) * 1.2 + 1


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), rng.random(12) * (rng.random(12) > 0.5)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-4)


def test_base_pii_is_the_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def brute(t):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 8 <= len(d) <= 15:
                    out.append((k, *m.span()))
        return sorted(out)

    for t in noise(20000, 4, "ab.@1259-+ ()%é\n.@") + ["x 4539 1488 0343 6467 y", "+1 (499) 555-6503", "a@b.co@d.org", "1.2.3.4.5.6.7.8"]:
        assert sorted(pii.base_spans(t)) == brute(t)


def test_network_gradients_and_learning():
    rng = np.random.default_rng(0)
    net = pii.Network(hidden=3)
    chars, tags = rng.integers(32, 60, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 1, 2, 0, 0, 0]])
    _, grads = net.loss_and_grads(chars, tags)
    for k, p in net.p.items():
        i = (chars[0, 3], 2) if k in ("xf", "xb") else tuple(rng.integers(0, s) for s in p.shape)
        p[i] += 1e-5
        up = net.loss_and_grads(chars, tags)[0]
        p[i] -= 2e-5
        down = net.loss_and_grads(chars, tags)[0]
        p[i] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][i]) < 1e-4
    texts = [f"word number {i} has {'.'.join(map(str, rng.integers(1, 256, 4)))} inside and text" for i in range(150)]
    net = pii.learn(texts, steps=600)
    new = ["other words with 77.12.3.101 in them"]
    found = pii.added_spans(net, new, [[]])[0]
    assert [(pii.KINDS[k], new[0][a:b]) for k, a, b in found] == [("ip", "77.12.3.101")]


def test_ordinal_order():
    rng = np.random.default_rng(0)
    hits = rng.integers(0, 10, 400)
    grades = np.digitize(hits, [3, 5, 8])
    w, cut = fit_ordinal(np.flatnonzero(hits), np.zeros((hits > 0).sum(), int), hits[hits > 0], grades, 1)
    assert w[0] > 0 and (np.diff(cut) > 0).all()


def test_isotonic_and_statistics():
    blocks = quality_model.pool_adjacent([0.1, 0.5, 0.3, 0.9], [1, 1, 1, 1])
    assert [round(b[0], 2) for b in blocks] == [0.1, 0.4, 0.9]
    x = quality_model.statistics(pa.array(ODD))
    assert x.shape == (len(ODD), len(quality_model.STATS)) and np.isfinite(x).all()


def test_neighbours_recall():
    v = np.random.default_rng(3).normal(size=(3000, 32))
    index, hit = SortedProjections(v, 128, 9), 0
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(40):
        rows, _ = index.search(v[q], 6, share=0.6, enough=0.15)
        hit += np.isin(np.argsort(-(unit @ unit[q]))[:6], rows).sum()
    assert hit >= 0.9 * 240


def test_decoding_is_the_trained_network():
    """What is decoded from are the trained network's own emissions, in single precision, with no approximation of its functions;
    and its states take less CPU time than those of training (0.6 of it, as measured; 1.3 before)."""
    rng = np.random.default_rng(8)
    net = pii.Network(seed=4).single()
    chars = rng.integers(32, 130, (768, 60)).astype(np.int16)
    hidden = np.concatenate([net.lstm(chars, d) for d in "fb"], 2)
    want = hidden @ net.p["w"] + net.p["o"]
    assert np.abs(net.emissions(chars) - want.transpose(2, 0, 1)).max() < 1e-4
    net.p = {k: x.astype(np.float32) for k, x in net.p.items()}
    cost = {}
    for name, f in (("training", net.lstm), ("decoding", net._states)):
        times = []
        for _ in range(5):
            began = time.thread_time()
            f(chars, "f")
            times.append(time.thread_time() - began)
        cost[name] = min(times)
    assert cost["decoding"] < cost["training"], cost


def widened(index, order, v, query, share, enough):
    """Rows that ``candidates`` is to find, by widening all windows around one query step by step."""
    at, half = (query / np.linalg.norm(query)) @ index.directions, 0.7
    goal, need = min(len(v), 6 + enough * len(v)), np.ceil(share * len(at))
    while True:
        bounds = [(np.searchsorted(s, x - half, "left"), np.searchsorted(s, x + half, "right")) for s, x in zip(index.sorted, at, strict=True)]
        counts = np.bincount(np.concatenate([o[a:b] for o, (a, b) in zip(order, bounds, strict=True)]), minlength=len(v))
        if (counts >= need).sum() >= goal:
            return np.flatnonzero(counts >= need)
        half *= 1.08


def test_neighbours_collide_as_by_widening():
    rng = np.random.default_rng(5)
    for n, dim in ((1, 4), (7, 4), (900, 16)):
        v = rng.normal(size=(n, dim))
        v[n // 2 :: 5] = v[0]
        index = SortedProjections(v, 32, 9)
        order = ((v / index.norms[:, None]) @ index.directions).argsort(0, kind="stable").T
        for share, enough in ((0.6, 0.15), (0.9, 0.01), (1.0, 1.0)):
            asked = np.concatenate([v[:70], rng.normal(size=(5, dim)) + 3])
            for q, rows in zip(asked, index.candidates(asked, share=share, enough=enough), strict=True):
                assert np.array_equal(rows, widened(index, order, v, q, share, enough)), (n, share, enough)


def test_neighbours_cost_less_than_widening():
    """Less than half the CPU time of a search that widens step by step."""
    v = np.random.default_rng(6).normal(size=(1 << 14, 64))
    index = SortedProjections(v, 128, 9)
    order = np.ascontiguousarray(((v / index.norms[:, None]) @ index.directions).argsort(0, kind="stable").T.astype(np.int32))
    began = time.thread_time()
    list(index.search_all(v[:40], 6, share=0.6, enough=0.15))
    ours, began = time.thread_time() - began, time.thread_time()
    for q in v[:40]:
        widened(index, order, v, q, 0.6, 0.15)
    assert ours < (time.thread_time() - began) / 2


class Marked:
    """Decodes runs of x and @ as emails, each window for itself."""

    longest = 1000

    def decode(self, chars):
        hit = (chars == 120) | (chars == 64)
        return np.where(hit, np.where(np.pad(hit[:, :-1], ((0, 0), (1, 0))), 2, 1), 0)


@pytest.mark.parametrize("size", (20, 48, 49, 60, 96, 150))
def test_added_span_is_whole_at_every_offset(size):
    for place in (0, size // 2, size - 1):
        span = "x" * place + "@" + "x" * (size - place - 1)
        for at in range(0, 200):
            text = " " * at + span + " " * 170
            assert pii.added_spans(Marked(), [text], [[]]) == [[(0, at, at + size)]], (size, place, at)


class Passes:
    """Stands for a DataFrame, and keeps the function that is given to mapInArrow."""

    columns, schema = ["doc_id", "text"], StructType().add("doc_id", "long").add("text", "string")

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("name", ["toxicity", "quality", "personal data", "sets"])
def test_passes_over_texts_return_small_batches(name):
    """However large a batch comes in, what a worker sends back at a time is bounded, and all rows are there in their order."""
    ordinal = toxicity.OrdinalModel(toxicity.Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), np.array([5.0, 6.0, 7.0]))
    fourier = quality_model.FourierModel(np.zeros(15), np.ones(15), 8, 4.0, 2)
    passes = {"toxicity": lambda d: toxicity.mark(d, ordinal), "quality": lambda d: quality_model.mark(d, fourier), "personal data": lambda d: pii.redact(d, None), "sets": near_dup.with_set}
    texts = [None, "", *("word " * 400 for _ in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(passes[name](Passes()).run(iter([batch])))
    assert max(b.nbytes for b in out) < 3 << 19 < batch.nbytes
    whole = pa.Table.from_batches(out)
    assert whole["doc_id"].to_pylist() == batch["doc_id"].to_pylist() and whole["text"].to_pylist() == texts


def test_worker_gives_memory_back():
    """After a pass that freed 200 MB in small parts with one above them still held, the process doesn't keep them."""
    code = """
import re
import numpy as np
from arborq.llm._shared import lean

rss = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
held = []

def run(batches):
    own = [np.ones(1 << 13) for _ in range(3200)]  # 64 KB each
    held.append(np.ones(1 << 13))
    yield len(own)

before = rss()
list(lean(run)(iter([])))
print(rss() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert float(out) < 60, out
