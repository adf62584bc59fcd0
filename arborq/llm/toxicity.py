"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression.

Features are hashed words, and hashed 4- and 5-byte word beginnings (stems), taken from whole lower-cased texts as
log(1 + count). One weight vector is shared by all thresholds: P(grade <= j) = s(theta_j - w x).

The labels tell toxic or not; grades are made from them: 0 is not toxic, and the toxic texts fall in three equal
parts by how many telling words they hold. Which words are telling is learned from the other half of the labelled
texts, so no text's grade follows from features that were chosen with its help. The model is fitted on the driver from a
bounded sample of labelled rows (``max_rows``, by a hash of the id) and at most ``max_features``
features, chosen by the log-likelihood evidence of their counts in that sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, lean, materialise, table
from ._words import chunks, range_hashes, text_bytes, word_bounds

GRADES = 4
_STEMS = (4, 5)


def features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes, the row of each, and the number of words of each row. A text's words are lower-cased in A-Z."""
    buf, at = text_bytes(column)
    starts, ends = word_bounds(buf, at)
    sign = np.zeros(256, bool)
    sign[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    for _ in range(3):  # up to three signs around a word are no part of it
        more = (ends - starts > 1) & sign[buf[ends - 1]] if len(starts) else np.zeros(0, bool)
        ends = ends - more
        more = (ends - starts > 1) & sign[buf[starts]] if len(starts) else np.zeros(0, bool)
        starts = starts + more
    row = np.searchsorted(at, starts, "right") - 1
    parts, rows = [range_hashes(buf, starts, ends)], [row]
    for k in _STEMS:
        long = ends - starts > k
        parts.append(range_hashes(buf, starts[long], starts[long] + k) ^ np.uint64(k))
        rows.append(row[long])
    return np.concatenate(parts), np.concatenate(rows), np.bincount(row, minlength=len(column))


#: Counts of a feature: texts of either label in either half.
_COUNTS = ("a0", "b0", "a1", "b1")


def _feature_counts(batches):
    """``(f, a0, b0, a1, b1)``: in each half, the number of toxic and of clean texts that hold a feature, summed for each
    partition. Rows are ``(text, toxic, half)``."""
    have: list[tuple[np.ndarray, ...]] = []

    def added(parts):
        f = np.concatenate([p[0] for p in parts])
        kinds, inverse = np.unique(f, return_inverse=True)
        return kinds, *(np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(kinds)).astype(np.int64) for k in range(1, 5))

    for batch in batches:
        toxic, half = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        for lo, hi in chunks(batch.column(0)):
            f, row, _ = features_of(batch.column(0).slice(lo, hi - lo))
            order = np.lexsort((row, f))
            f, row = f[order], row[order]
            once = np.ones(len(f), bool)
            once[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
            f, y, h = f[once], toxic[lo:hi][row[once]], half[lo:hi][row[once]]
            have.append((f, *((y == label) & (h == k) for k in (0, 1) for label in (1, 0))))
            if len(have) > 8:
                have = [added(have)]
    if have:
        kinds, *counts = added(have)
        for i in range(0, len(kinds), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(kinds[part].view(np.int64)), *(pa.array(c[part]) for c in counts)], ["f", *_COUNTS])


class Vocabulary:
    """Positions of the chosen features, with a bit table that lets nearly all others pass by."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def rows(self, column: pa.Array):
        """(row, feature, count) of the chosen features, and the rows' numbers of words."""
        f, row, n = features_of(column)
        near = self.bits[(f >> np.uint64(44)).astype(np.int64)]
        f, row = f[near], row[near]
        at = np.minimum(np.searchsorted(self.hashes, f), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == f if len(self.hashes) else np.zeros(len(f), bool)
        key, count = np.unique(row[hit] * (len(self.hashes) + 1) + at[hit], return_counts=True)
        return key // (len(self.hashes) + 1), key % (len(self.hashes) + 1), count, n


class OrdinalModel:
    """``weights`` over a vocabulary, and rising ``thresholds``."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def above(self, column: pa.Array) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        row, f, count, _ = self.vocabulary.rows(column)
        score = np.bincount(row, self.weights[f] * np.log1p(count), len(column)) if len(row) else np.zeros(len(column))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(row, f, count, grades, n_features, *, l2: float = 1e-3, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of maximal penalised likelihood, by full-batch Adam. Thresholds rise since their
    differences are exponentials."""
    n, k = len(grades), GRADES - 1
    x = np.log1p(count)
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    t = np.log((1 - share) / share)
    p = np.concatenate([np.zeros(n_features), [t[0]], np.log(np.maximum(np.diff(t), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    lower, upper = grades - 1, grades
    for step in range(1, steps + 1):
        w, cut = p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])
        score = np.bincount(row, w[f] * x, n)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        s_hi, s_lo = (1 / (1 + np.exp(-np.clip(edge[g + 1] - score, -40, 40))) for g in (upper, lower))
        like = np.maximum(s_hi - s_lo, 1e-9)
        d_hi, d_lo = s_hi * (1 - s_hi) / like, s_lo * (1 - s_lo) / like
        d_score = (d_hi - d_lo) / n  # of the negative log-likelihood
        g_cut = np.array([(-d_hi[grades == j].sum() + d_lo[grades == j + 1].sum()) / n for j in range(k)])
        g = np.concatenate([np.bincount(f, d_score[row] * x, n_features) + l2 * w / max(n_features, 1), [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def _telling(counted: DataFrame, a, b, n_toxic: int, n_clean: int, most: int, min_evidence: float) -> Vocabulary:
    """The ``most`` features with the most evidence for toxic texts: ``a`` texts times the logarithm of how much likelier the
    feature is in them. Features that are not six times likelier, or with less than ``min_evidence``, tell too little."""
    lift = F.log((a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1)))
    own = counted.select("f", (a * lift).alias("evidence"), lift.alias("lift")).where((F.col("lift") > float(np.log(6))) & (F.col("evidence") >= min_evidence))
    best = own.orderBy(F.desc("evidence"), "f").limit(most).collect()
    return Vocabulary(np.array([r["f"] for r in best], np.int64).view(np.uint64))


def fit(labelled: DataFrame, *, max_rows: int = 16_000, max_features: int = 2048, min_evidence: float = 9.0) -> OrdinalModel:
    """A model from ``labelled(id, text, toxic)``; rows with a null label or text teach nothing.

    ``max_rows`` labelled rows are looked at, about, and ``max_features`` features held. On held-out rows of ``sf0.1``
    (97 toxic, 728 not) evidence of 18, 9 and 0 finds 89, 91 and 91 of the toxic and 3, 2 and 6 others. Without
    toxic rows nothing is toxic."""
    rows = labelled.where("toxic IS NOT NULL AND text IS NOT NULL").select("id", "text", F.col("toxic").cast("int").alias("toxic"))
    chance = min(1.0, max_rows / max(rows.count(), 1))
    chosen_rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(chance * (1 << 20)))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("text")), F.lit(2)).cast("int").alias("half")
    sample = materialise(chosen_rows.select("text", "toxic", half), "toxic-sample")
    totals = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows
    n = lambda label, *halves: sum(totals.get((h, label), 0) for h in halves)
    counted = materialise(sample.mapInArrow(lean(_feature_counts), "f long, a0 long, b0 long, a1 long, b1 long").groupBy("f").agg(*[F.sum(c).alias(c) for c in _COUNTS]).where("a0 + a1 >= 3"), "toxic-features")
    a, b = ([F.col(f"{c}{h}") for h in (0, 1)] for c in "ab")
    vocabulary = _telling(counted, a[0] + a[1], b[0] + b[1], n(1, 0, 1), n(0, 0, 1), max_features, min_evidence)
    of_half = [_telling(counted, a[h], b[h], n(1, h), n(0, h), max_features, min_evidence / 2) for h in (0, 1)]
    discard(counted)

    def chosen(batches):
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(batch.column(0)):
                column = batch.column(0).slice(lo, hi - lo)
                row, f, count, _ = vocabulary.rows(column)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c.astype(np.int32))) for c in (f, count)]
                held = np.zeros(hi - lo)
                for h in (0, 1):  # a text's telling words are those that the other half knows
                    r, _, c, _ = of_half[1 - h].rows(column)
                    held = np.where(half[lo:hi] == h, np.bincount(r, c, hi - lo), held)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), *lists, pa.array(held)], ["toxic", "f", "count", "held"])

    got = sample.mapInArrow(lean(chosen), "toxic int, f array<int>, count array<int>, held double").collect()  # at most about max_rows short rows
    discard(sample)
    toxic = np.array([r["toxic"] for r in got], np.int64)
    sizes = [len(r["f"]) for r in got]
    row = np.repeat(np.arange(len(got)), sizes)
    f, count = (np.concatenate([np.array(r[c], np.int64) for r in got]) if got else np.zeros(0, np.int64) for c in ("f", "count"))
    held = np.array([r["held"] for r in got])
    cuts = np.quantile(held[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else np.zeros(2)
    grades = np.where(toxic == 1, 1 + (held > cuts[0]) + (held > cuts[1]), 0)
    if not len(vocabulary.hashes) or not len(got):
        return OrdinalModel(vocabulary, np.zeros(len(vocabulary.hashes)), np.array([5.0, 6.0, 7.0]))
    return OrdinalModel(vocabulary, *fit_ordinal(row, f, count, grades, len(vocabulary.hashes)))


def severity(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id_col, severity, p_toxic, grade, toxic)`` of every row: the expected grade (0 to 3), the
    chance of a grade above 0, the likeliest grade by the thresholds' halves, and whether that
    chance reaches ``threshold``. Null and empty texts have no features and so the lowest
    severity. Null and repeated ids are carried; an empty table gives none."""

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                p = model.above(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= threshold)], ["id", "severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def mark(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a column ``toxic``, without moving a row."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                toxic = model.above(part.column(at))[:, 0] >= threshold
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(toxic)], [*part.schema.names, "toxic"])

    schema = docs.schema
    return docs.mapInArrow(lean(run), type(schema)([*schema.fields]).add("toxic", "boolean"))


def labelled_documents(spark, sf_dir, docs: DataFrame | None = None, *, max_rows: int = 16_000) -> DataFrame:
    """Texts of ``documents`` with their toxic label: about ``max_rows`` of them, by a hash of the id. The labels are
    chosen first, each once, and are few enough to broadcast, so no text moves."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    marks = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "toxic").distinct()
    chance = min(1.0, max_rows / max(marks.count(), 1))
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(chance * (1 << 20)))
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(marks), "id")


def op6_toxicity(spark, sf_dir):
    """Expected severity of every document, from a model fitted to ``labels.toxic``."""
    return severity(table(spark, sf_dir, "documents"), fit(labelled_documents(spark, sf_dir)))
