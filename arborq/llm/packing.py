"""Pattern packing of documents into sequences by non-negative least squares.

Only the histogram of lengths (at most ``seq_len`` numbers) reaches the driver, whatever the
corpus. There the lengths fall into classes of a few tokens; patterns of one to three classes that
fill a sequence are enumerated; their repeat counts are fitted to the histogram by non-negative
least squares and rounded; what is left, longest first, goes to the tightest open space, patterns'
own gaps included. The plan is made of blocks ("so many sequences with these lengths"), so its size
depends on the lengths that occur and not on the number of documents.

Each piece then finds its place from its length and its rank among the pieces of that length; ranks
come from counts of each partition, so no length, however common, meets in one task. These counts are one row a
partition and join the pieces by it: broadcast up to ``MAX_BROADCAST_PARTS`` partitions, by shuffle beyond. The blocks of
a length are arrays of a broadcast row, in which Spark looks a rank up by halving: no piece meets a Python worker again."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import lean, materialise, table
from ._words import chunks

#: Classes of lengths for the fit.
CLASSES = 128
#: Bytes of text that are cut at a time (or one text): the temporary arrays of learning ever new words are some 100 times as large.
CUT_BYTES = 1 << 18
#: Counts of so many partitions are broadcast at most (8 bytes a length: 34 MB for 2048 tokens); those of more join by shuffle.
MAX_BROADCAST_PARTS = 2048


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    resid = b.astype(float)
    eps = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ resid
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= eps:
            break
        active.append(j)
        while True:
            own = a[:, active]
            gram = own.T @ own
            gram[np.diag_indices_from(gram)] += 1e-9
            z = np.linalg.solve(gram, own.T @ b)
            if z.min() > 0:
                break
            now = x[active]
            low = z <= 0
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            now = now + step * (z - now)
            x[:] = 0
            keep = now > 1e-12 * max(1.0, now.max())
            keep[-1] &= z[-1] > 0
            x[[k for k, ok in zip(active, keep, strict=True) if ok]] = now[keep]
            active = [k for k, ok in zip(active, keep, strict=True) if ok]
            if not active:
                z = np.zeros(0)
                break
        x[:] = 0
        x[active] = z
        resid = b - a @ x
    return x


def _patterns(classes: int) -> np.ndarray:
    """Rows of up to three classes (0: none) that sum to ``classes``, largest first."""
    rows = [(classes, 0, 0)] + [(classes - b - c, b, c) for c in range(classes // 3 + 1) for b in range(max(c, 1), (classes - c) // 2 + 1) if classes - b - c >= b]
    return np.array(rows)


def plan(hist: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """``hist[l]`` pieces of length l -> blocks (first sequence, number of sequences, lengths in order). All pieces are placed."""
    top = len(hist) - 1
    left = hist.astype(np.int64).copy()
    blocks: list[tuple[int, int, list[int]]] = []
    sequences = 0
    if left[top]:
        blocks.append((0, int(left[top]), [top]))
        sequences, left[top] = int(left[top]), 0
    width = -(-top // CLASSES)
    classes = top // width
    by_class = np.zeros(classes + 2, np.int64)  # the last one: longer than any class of the fit
    cls = np.minimum(-(-np.arange(top + 1) // width), classes + 1)
    fits = np.flatnonzero((cls <= classes) & (np.arange(top + 1) > 0))
    np.add.at(by_class, cls[fits], left[fits])
    rows = _patterns(classes)
    a = np.zeros((classes + 1, len(rows)))
    for k in range(3):
        np.add.at(a, (rows[:, k], np.arange(len(rows))), 1.0)
    a[0] = 0
    rows, a = rows[keep := ((a > 0) <= (by_class[:-1] > 0)[:, None]).all(0)], a[:, keep]
    scale = float(by_class.max(initial=0))
    fitted = nnls(a, by_class[:-1] / scale) * scale if len(rows) and scale else np.zeros(len(rows))
    open_: dict[int, list[tuple[int, int, list[int]]]] = {}
    for i in np.argsort(-fitted, kind="stable").tolist():
        want = [int(c) for c in rows[i] if c]
        times = int(fitted[i] + 0.5)
        while times > 0:  # the longest lengths of each class first, in blocks of equal lengths
            lengths: list[int] = []
            use: dict[int, int] = {}
            for k, c in enumerate(want):
                most = top - sum(lengths) if k == len(want) - 1 else min(c * width, top)  # the last one may take the slack
                length = next((x for x in range(most, (c - 1) * width, -1) if left[x] > use.get(x, 0)), 0)
                if not length:
                    break
                use[length] = use.get(length, 0) + 1
                lengths.append(length)
            if len(lengths) < len(want):
                break
            n = min(times, *(int(left[x]) // k for x, k in use.items()))
            for x, k in use.items():
                left[x] -= n * k
            for x in lengths:
                by_class[cls[x]] -= n
            open_.setdefault(top - sum(lengths), []).append((sequences, n, lengths))
            sequences, times = sequences + n, times - n
    gaps = sorted(open_)
    for length in range(top, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = top // length
                for times, held in ((n // each, each), (1, n % each)):
                    if times and held:
                        _put(open_, gaps, top - held * length, (sequences, times, [length] * held))
                        sequences += times
                break
            gap = gaps[at]
            first, times, lengths = open_[gap].pop()
            k = min(n, times)
            if times > k:
                open_[gap].append((first + k, times - k, lengths))
            elif not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            _put(open_, gaps, gap - length, (first, k, [*lengths, length]))
            n -= k
    return blocks + [b for own in open_.values() for b in own]


def _put(open_, gaps, gap, block):
    if gap not in open_:
        open_[gap] = []
        bisect.insort(gaps, gap)
    open_[gap].append(block)


def _places(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first rank), and for each the first sequence and the offset."""
    used: dict[int, int] = {}
    rows = []
    for first, times, lengths in sorted(blocks):
        at = 0
        for x in lengths:
            rows.append((x << 40 | used.get(x, 0), first, at))
            used[x] = used.get(x, 0) + times
            at += x
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def _cutter(path: str, seq_len: int, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        from .word_bpe import WordBPE

        part, seen, coder = TaskContext.get().partitionId(), np.zeros(seq_len + 1, np.int64), WordBPE(path)
        for batch in batches:
            for lo, hi in chunks(batch.column(1), CUT_BYTES):
                ids_of = coder.encode(batch.column(1).slice(lo, hi - lo))
                rows, parts = [], []
                for row, own in enumerate(ids_of):
                    full = np.append(own, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(full), seq_len)):
                        ids = full[start : start + seq_len]
                        rows.append((row, piece, start, len(ids), zlib.crc32(ids.tobytes()), part, seen[len(ids)]))
                        seen[len(ids)] += 1
                        if with_ids:
                            parts.append(ids)
                cols = np.array(rows, np.int64).T
                out = [batch.column(0).slice(lo, hi - lo).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *map(pa.array, cols[2:])]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    at = np.concatenate([[0], np.cumsum(cols[3])])
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)
            del batch  # else it stays while the next one is read

    return run


def _starts(spark, places, seq_len: int) -> tuple[DataFrame, int]:
    """``places`` as ``(length, starts)``, a row for each length with the struct of its blocks' first ranks, first sequences and
    offsets; and the most blocks of a length."""
    keys, *rest = places
    at = np.searchsorted(keys, np.arange(seq_len + 2) << 40)
    columns = [keys & ((1 << 40) - 1), *rest]

    @F.arrow_udf("firsts array<long>, sequences array<long>, offsets array<long>")
    def place(length: pa.Array) -> pa.Array:
        own = length.to_numpy(zero_copy_only=False)
        lists = [pa.array([c[at[x] : at[x + 1]] for x in own], pa.list_(pa.int64())) for c in columns]
        return pa.StructArray.from_arrays(lists, ["firsts", "sequences", "offsets"])

    lengths = spark.range(1, seq_len + 1, numPartitions=1).select(F.col("id").alias("length"))
    return lengths.withColumn("starts", place("length")), int(np.diff(at).max())


def _last_at_most(values, most: int, x):
    """Position of the last of the rising ``values`` (at most ``most``, the first one at most ``x``) that isn't above ``x``, in log2 steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, most.bit_length()) - 1, -1, -1)])
    return F.reduce(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step) <= x, at + step).otherwise(at))


def _before(counts: DataFrame, seq_len: int) -> DataFrame:
    """``(part, before)``: for each partition, by length, how many pieces of that length the partitions before it hold."""
    so_far = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    own = counts.select("part", F.struct(F.col("length").cast("int").alias("length"), so_far.alias("k")).alias("e"))

    def dense(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, seq_len + 1), np.int64)
            for row, entries in zip(out, batch.column(1).to_pylist(), strict=True):
                for e in entries:
                    row[e["length"]] = e["k"]
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * (seq_len + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(out.ravel()))], ["part", "before"])

    lists = own.groupBy("part").agg(F.collect_list("e").alias("own"))  # at most seq_len entries
    return materialise(lists.mapInArrow(lean(dense), "part long, before array<long>"), "before")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, *, tokenizer: str | None = None, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids])``: every piece of every row.

    A row's ids are its text's, then ``end_id``; only longer ones are cut, into pieces of
    ``seq_len``. Null and empty texts are the end id alone. Repeated rows are packed each; null
    ids are carried. Sequences are numbered from 0 and filled from offset 0 without gaps. An
    empty table gives none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids array<int>" * with_ids
    pieces = materialise(rows.mapInArrow(lean(_cutter(tokenizer or tokenizer_path(), seq_len, end_id, with_ids)), schema), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    hist = np.zeros(seq_len + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most seq_len rows
        hist[r["length"]] = r["n"]
    starts, most = _starts(docs.sparkSession, _places(plan(hist)), seq_len)
    before = _before(counts, seq_len)
    # nothing of a piece goes through Python here: a row that waits for a worker is kept whole, its ids and ``before`` too
    ranked = pieces.join(F.broadcast(before) if before.count() <= MAX_BROADCAST_PARTS else before, "part")
    ranked = ranked.withColumn("rank", F.get("before", F.col("length").cast("int")) + F.col("nth")).drop("before")
    placed = ranked.join(F.broadcast(starts), "length").withColumn("at", _last_at_most(F.col("starts.firsts"), most, F.col("rank")))
    sequence = F.get("starts.sequences", "at") + F.col("rank") - F.get("starts.firsts", "at")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, sequence.alias("sequence_id"), F.get("starts.offsets", "at").alias("offset"))


def op7_packing(spark, sf_dir):
    """Packs all ``documents`` into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
