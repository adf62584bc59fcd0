"""Approximate nearest neighbours by collision counting over query-centred windows.

Each of ``projections`` random directions keeps one sorted array of its projections, with no buckets. A query opens
a window around its own projection in each of them, and widens all windows step by step (virtual
rehashing). A vector that lies in at least ``share`` of the windows collides often enough to be
verified; widening ends when ``6 + enough * rows`` vectors have been, or the windows cover everything. Collisions are counted by
comparing the ranks of all vectors with the windows' ends, 16 directions at a time.
Verified vectors get their exact cosine in double precision.

Vectors lie in blocks of bounded size, each with its own sorted arrays; every block meets every
block of queries. The work is rows times queries (the job has them grow together); a block is copied, and its arrays
sorted, once for each ``QUERY_ROWS`` queries. Equal vectors are one row of the index with their smallest ids (as many as a result
can need), so a vector that a third of the table shares costs as much as any other."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, table

#: Vectors of a block, and queries that meet it together (at 64 numbers each some 25 MB with its arrays, and 17 MB).
BLOCK_ROWS, QUERY_ROWS = 1 << 14, 1 << 15


def _valid(batches):
    """Rows with a usable vector: ``(id, h, vec)``; ``h`` is a digest of the vector."""
    import xxhash

    for batch in batches:
        column = batch.column(1).cast(pa.list_(pa.float64()))
        ids, vecs, hashes = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), column, strict=True):
            if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy() + 0.0  # -0.0 is 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                vecs.append(x)
                hashes.append(xxhash.xxh3_128_digest(x.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(vecs, pa.list_(pa.float64()))], ["id", "h", "vec"])


class SortedProjections:
    """The index of one block of vectors."""

    #: Queries whose windows are looked up together, and directions whose ranks are compared together (half a MB of a block).
    GROUP, TILE = 64, 16

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.directions = np.random.Generator(np.random.PCG64(seed)).normal(size=(vectors.shape[1], projections))
        values = (vectors / self.norms[:, None]) @ self.directions
        n = len(vectors)
        #: The place of each vector in each sorted array: it lies in a window if that place does.
        self.ranks = np.empty((projections, n), np.uint16 if n < 1 << 16 else np.uint32)
        for rank, order in zip(self.ranks, values.argsort(0, kind="stable").T, strict=True):
            rank[order] = np.arange(n)
        self.sorted = np.ascontiguousarray(np.sort(values, 0).T)

    def _windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First places and sizes of the windows around ``at``, (queries, directions)."""
        lo, hi = (np.array([s.searchsorted(x, side) for s, x in zip(self.sorted, (at + by).T, strict=True)]).T for by, side in ((-half, "left"), (half, "right")))
        return lo.astype(self.ranks.dtype), (hi - lo).astype(self.ranks.dtype)

    def _counts(self, lo: np.ndarray, sizes: np.ndarray, work: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """In how many windows each vector lies."""
        counts = np.zeros(self.ranks.shape[1], np.uint8 if len(lo) < 256 else np.uint32)
        for t in range(0, len(lo), self.TILE):
            ranks = self.ranks[t : t + self.TILE]
            past, inside = (w[: len(ranks)] for w in work)
            np.subtract(ranks, lo[t : t + self.TILE, None], out=past)  # wraps below the window
            np.less(past, sizes[t : t + self.TILE, None], out=inside)
            counts += inside.view(np.uint8).sum(0, dtype=counts.dtype)
        return counts

    def candidates(self, queries: np.ndarray, *, share: float, enough: float, first: float = 0.7, widen: float = 1.08):
        """For each query, the rows that share enough windows with it, once they are widened so often that there are enough of them.

        Rows only come in as windows widen, so how often is sought from where the query before ended, up or down."""
        n, m = self.ranks.shape[1], len(self.ranks)
        need, goal = int(np.ceil(share * m)), min(n, 6 + enough * n)
        halves, often = [first], 0
        work = np.empty((self.TILE, n), self.ranks.dtype), np.empty((self.TILE, n), bool)
        for g in range(0, len(queries), self.GROUP):
            group = queries[g : g + self.GROUP]
            at = np.array([(q / np.sqrt((q * q).sum())) @ self.directions for q in group])
            windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i in range(len(group)):

                def found(k):
                    while len(halves) <= k:
                        halves.append(halves[-1] * widen)
                    if k not in windows:
                        windows[k] = self._windows(at, halves[k])
                    lo, sizes = windows[k]
                    rows = np.flatnonzero(self._counts(lo[i], sizes[i], work) >= need)  # noqa: B023
                    return rows, len(rows) >= goal or int(sizes[i].min()) == n  # noqa: B023

                rows, ends = found(often)
                while ends and often and (less := found(often - 1))[1]:
                    rows, often = less[0], often - 1
                while not ends:
                    often += 1
                    rows, ends = found(often)
                yield rows

    def search_all(self, queries: np.ndarray, k: int, **how):
        """For each query, rows and cosines of the ``k`` nearest found, at least; equal ones at the end stay."""
        for query, rows in zip(queries, self.candidates(queries, **how), strict=True):
            size = np.sqrt((query * query).sum())
            if len(rows) > k:  # what may be among them by a product, which sums in another order; then the exact ones
                own = self.vectors[rows]
                rough = (own @ query) / (self.norms[rows] * size)
                rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
            score = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * size)
            if len(rows) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[keep], score[keep]
            yield rows, score

    def search(self, query: np.ndarray, k: int, **how) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`search_all` of one query."""
        return next(self.search_all(query[None], k, **how))


def nearest(vectors: DataFrame, *, every: int = 50, k: int = 5, projections: int = 128, share: float = 0.6, enough: float = 0.15, seed: int = 9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every row whose id is divisible by
    ``every``, among all rows but itself (fewer, if there are fewer); ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, as
    queries or candidates, nor do rows with a null id; vectors of different lengths never meet. Rows that repeat an id
    count as one: that of the smallest digest, where their vectors differ. Other columns are ignored; an empty table gives none."""
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(_valid, "id long, h binary, vec array<double>"), "vectors")
    differ = rows.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("id", "least")
    rows = rows.join(differ, "id", "left").where("least IS NULL OR h = least").select("id", "h", "vec") if differ.limit(1).count() else rows
    first = lambda ids: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(ids)))), 1, k + 1)
    # the k + 1 smallest ids of each distinct vector: within hash parts first, so that no vector's rows meet in one task
    parts = rows.groupBy("h", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("part")).agg(first(F.array("id")).alias("ids"), F.first("vec").alias("vec"))
    parts = parts.groupBy("h", (F.col("part") % 64).alias("part")).agg(first("ids").alias("ids"), F.first("vec").alias("vec"))
    index = materialise(parts.groupBy("h").agg(first("ids").alias("ids"), F.first("vec").alias("vec")), "index")
    asked = materialise(rows.where(F.col("id") % every == 0).select("id", "h").distinct(), "queries")
    queries = materialise(index.join(asked.select("h").distinct(), "h", "left_semi").select("h", "vec"), "query-vectors")

    blocks, query_blocks = (max(1, -(-df.count() // most)) for df, most in ((index, BLOCK_ROWS), (queries, QUERY_ROWS)))
    size = F.size("vec").alias("size")
    left = index.select("h", "ids", "vec", size, F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    right = queries.select(F.col("h").alias("q"), "vec", size, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("h"), F.lit(query_blocks)).cast("int").alias("part"))

    def search(key, data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asking):
            block = SortedProjections(np.stack(data["vec"].to_list()), projections, seed)
            for q, (found, score) in zip(asking["q"], block.search_all(np.stack(asking["vec"].to_list()), k + 1, share=share, enough=enough), strict=True):
                out += [(q, data["ids"].iat[r], s) for r, s in zip(found.tolist(), score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["q", "ids", "score"])

    keys = ["block", "part", "size"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "q binary, ids array<long>, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("q", "ids", "score")
    each = asked.join(top, asked.h == top.q).select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir):
    """The 5 nearest of every 50th row of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"))
