"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of the whole text are standardised; random Fourier features approximate a Gaussian
kernel over them; every partition sums its share of the normal equations, and the ridge solution
comes from the total. Raw scores are calibrated by isotonic regression (pool adjacent violators) on
labelled rows that the fit did not see, from counts in fixed bins. Only the sums (one matrix of
``n_features`` squared) and at most ``BINS`` bins reach the driver, so all labelled rows take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, fold, lean, materialise, restrict, table
from ._words import chunks, mix, range_hashes, text_bytes, word_bounds

#: Bins of the raw score between -0.5 and 1.5.
BINS = 4096

_UPPER, _DIGIT, _SYMBOL, _PUNCT, _BANG = (np.zeros(256, np.int64) for _ in range(5))
_UPPER[0x41:0x5B] = 1
_DIGIT[0x30:0x3A] = 1
_SYMBOL[[ord(c) for c in "#*$%&|<>@=_{}[]~^\\/"]] = 1
_PUNCT[[ord(c) for c in ".,;:?"]] = 1
_BANG[ord("!")] = 1
STATS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "punct", "bang", "high", "log_lines", "line_words", "repeated_lines", "distinct_words", "repeated_threes", "longest_line")


def _sums(values, at):
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(keys, row, n):
    """Number of distinct keys of each row, and the number that stand more than once (all of them)."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(k)))
    return np.bincount(r[new], minlength=n), np.bincount(r[new], np.where(size > 1, size, 0), n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of :data:`STATS` for each text; null and blank texts give the values of no words."""
    buf, at = text_bytes(column)
    n = len(column)
    size = np.diff(at).astype(float)
    starts, ends = word_bounds(buf, at)
    word_at = np.searchsorted(starts, at)
    words = np.diff(word_at).astype(float)
    some, any_word = np.maximum(size, 1), np.maximum(words, 1)
    row = np.repeat(np.arange(n), np.diff(word_at))
    h = range_hashes(buf, starts, ends)
    kinds, _ = _distinct(h, row, n)
    if len(h) > 2:
        three = np.flatnonzero(row[2:] == row[:-2])
        g = mix(h[three] ^ mix(h[three + 1] ^ mix(h[three + 2])))
        _, again = _distinct(g, row[three], n)
    else:
        again = np.zeros(n)
    feed = np.zeros(len(buf) + 1, bool)
    feed[:-1] = buf == 0x0A
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    edge[1:] |= feed[:-1]
    bounds = np.flatnonzero(edge)
    first, last = bounds[:-1], bounds[1:]
    holds = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[holds], last[holds]
    line_row = np.searchsorted(at, first, "right") - 1
    line_h = range_hashes(buf, first, last - feed[last - 1]) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(line_row, minlength=n).astype(float)
    line_kinds, _ = _distinct(line_h, line_row, n)
    longest = np.zeros(n)
    np.maximum.at(longest, line_row, (last - first).astype(float))
    any_line = np.maximum(lines, 1)
    share = [_sums(t[buf], at) / some for t in (_UPPER, _DIGIT, _SYMBOL, _PUNCT, _BANG)]
    high = _sums((buf >= 0x80).astype(np.int64), at) / some
    root = lambda x: np.sqrt(np.maximum(x, 0))  # noqa: E731  spreads small shares
    return np.column_stack([np.log1p(size), np.log1p(words), _sums((ends - starts), word_at) / any_word / 10, *map(root, share), root(high), np.log1p(lines), np.log1p(words / any_line), root(1 - line_kinds / any_line) * (lines > 0), kinds / any_word, root(again / any_word), np.log1p(longest)])


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x array<double>)`` of every row."""

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                x = statistics(batch.column(1).slice(lo, hi - lo))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "id long, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS)) if len(column) else np.zeros((0, len(STATS)))


class FourierModel:
    """Standardisation, random frequencies, ridge weights and calibration steps."""

    def __init__(self, centre, spread, n_features: int, width: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centre, self.spread = centre, spread
        self.w = rng.normal(size=(len(STATS), n_features)) / width
        self.b = rng.uniform(0, 2 * np.pi, n_features)
        self.weights = np.zeros(n_features + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x):
        """The Fourier features and a constant."""
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])

    def raw(self, x):
        return self.features(x) @ self.weights

    def score(self, x):
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def pool_adjacent(value, weight):
    """Non-decreasing fit of least squares: block means and the number of members of each block."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return blocks


def fit(rows: DataFrame, *, n_features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 2) -> FourierModel:
    """A model from ``rows(x, y, calibrate boolean)``."""
    p = len(STATS)
    fit_rows = rows.where("NOT calibrate")
    moments = fit_rows.agg(F.count("*").alias("n"), *[f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return FourierModel(np.zeros(p), np.ones(p), n_features, width, seed)
    model = FourierModel(np.array([moments[f"m{i}"] for i in range(p)]), np.maximum([moments[f"s{i}"] for i in range(p)], 1e-3), n_features, width, seed)

    def sums(batches):
        a, b = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for batch in batches:
            z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            a += z.T @ z
            b += z.T @ y
        rows = np.column_stack([a, b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_features + 1)), pa.ListArray.from_arrays(pa.array(np.arange(n_features + 2) * (n_features + 2), pa.int32()), pa.array(rows.ravel()))], ["i", "v"])

    # each partition sends n_features + 1 rows; rows of the same number are summed element by element, in the order of their
    # partitions, so that a run on the same partitions gives the same bits
    zero, plus = F.array_repeat(F.lit(0.0), n_features + 2), lambda t, v: F.zip_with(t, v, lambda x, y: x + y)
    added = F.aggregate(F.sort_array(F.collect_list(F.struct("k", "v"))), zero, lambda t, e: plus(t, e["v"]))
    partial = fit_rows.select("x", F.col("y").cast("int")).mapInArrow(lean(sums), "i long, v array<double>").withColumn("k", F.spark_partition_id())
    some = partial.groupBy("i", F.floor(F.col("k") / 64).cast("int").alias("k0")).agg(added.alias("v")).withColumnRenamed("k0", "k")
    total = some.groupBy("i").agg(added.alias("v")).orderBy("i").collect()
    system = np.array([r["v"] for r in total])
    a, b = system[:, :-1], system[:, -1]
    model.weights = np.linalg.solve(a + ridge * moments["n"] / n_features * np.eye(n_features + 1), b)

    def binned(batches):
        count, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)
            count += np.bincount(at, minlength=BINS)
            good += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False).astype(float), BINS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used].astype(np.int64)), pa.array(good[used].astype(np.int64))], ["bin", "n", "good"])

    bins = rows.where("calibrate").select("x", F.col("y").cast("int")).mapInArrow(lean(binned), "bin long, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    if bins:
        centre = np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in bins])
        n, good = (np.array([r[c] for r in bins], float) for c in ("n", "good"))
        xs, ys, at = [], [], 0
        for value, _, k in pool_adjacent(good / n, n):
            xs.append(float(np.average(centre[at : at + k], weights=n[at : at + k])))
            ys.append(value)
            at += k
        model.knots = (np.array(xs), np.array(ys))
    return model


def trained(docs: DataFrame, marks: DataFrame) -> FourierModel:
    """A model from ``docs(doc_id, text)`` and ``marks(id, y)``: rows of crc32 fold 0 (modulo 5) teach nothing, fold 1
    calibrates. Only the labelled rows' statistics are computed; where the labels' ids are few enough to broadcast, no text moves."""
    marks = marks.where("y IS NOT NULL").withColumn("part", fold(F.col("id"), 5)).where("part <> 0")
    ids = marks.select("id").distinct()
    known = restrict(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), ids, ids.count(), "id")
    stats = text_statistics(known, id_col="id")
    rows = materialise(stats.join(marks, "id").select("x", "y", (F.col("part") == 1).alias("calibrate")), "quality-rows")
    model = fit(rows)
    discard(rows)
    return model


def labels(spark, sf_dir) -> DataFrame:
    """``(id, y)``; rows of ``labels`` that say the same of a document count once."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("y")).distinct()


def mark(docs: DataFrame, model: FourierModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with the columns ``score`` and ``predicted``, without moving a row. Null texts score as empty ones."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                score = model.score(statistics(part.column(at)))
                more = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "score", "predicted"])

    schema = docs.schema
    return docs.mapInArrow(lean(run), type(schema)([*schema.fields]).add("score", "double").add("predicted", "integer"))


def score_documents(spark, sf_dir, docs: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``. Null texts score as empty
    ones; null ids are carried (and never held out); repeated rows are scored each."""
    out = mark(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), trained(docs, labels(spark, sf_dir)), threshold=threshold)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_quality_model(spark, sf_dir):
    """Quality scores of all ``documents``, learned from ``labels.quality``."""
    return score_documents(spark, sf_dir, table(spark, sf_dir, "documents"))
