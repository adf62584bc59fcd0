"""MinHash near-duplicate detection with tensored banding.

A plain banding index with T tables of r rows needs T*r minhashes. Here two small collections of
m half keys (``half_rows`` minhashes each) are made, and the table keys are all m*m pairs of a
left and a right half key: T = m*m tables of 2*half_rows rows from 2*m*half_rows minhashes, about a square
root of the usual work. A pair with similarity s meets in some table with probability
(1 - (1 - s^half_rows)^m)^2; for the defaults and s = 0.8 that is 0.9996, 0.99998 at 0.85.

Only *live* half keys (held by two or more different texts) are paired, which gives the same
tables but spares almost all rows of an ordinary corpus.

Hot groups: texts with equal shingle sets collapse to one representative before any table is
built. Within a table's bucket no pairs are enumerated: in round 0 its members are verified
against the smallest one. Members of buckets that then hold more than one component still are
compared exactly, in buckets of their rarest shingles (a prefix filter with bounds on size and
position), against the smallest member of each of 32, 1024, ... hash classes (each member, where a
bucket has no more of them), always skipping members that are already in the pivot's component.
So copies merge after one comparison each, texts that merely share a passage are hardly ever
compared, and a bucket is finished only when its members form one component or each of them was a
pivot: no link between members is lost and nothing is capped. Links are confirmed on full sets. A
bucket's members, and the pairs of a pivot, are dealt over several tasks by salt, and the few pivots (a
pivot's set once for each salt) go to all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, hot_keys, lean, materialise, replicate, restrict, spread, table
from ._words import chunks, mix, shingles_of
from .components import connected_components

#: Growth of the number of pivots of a bucket from round to round.
PIVOT_STEP = 32


def _sketcher(k: int, half_rows: int, m: int, seed: int):
    def run(batches):
        import xxhash

        rng = np.random.Generator(np.random.PCG64(seed))
        factors = rng.integers(1, 2**63, 2 * m * half_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(1, 2**63, 2 * m, dtype=np.uint64)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi in chunks(column):
                g, at = shingles_of(column.slice(lo, hi - lo), k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((len(full), 2 * m), np.uint64)
                if len(full):
                    for j, factor in enumerate(factors):
                        low = np.minimum.reduceat(g * factor, at[:-1][full])
                        key = keys[:, j // half_rows]
                        keys[:, j // half_rows] = mix(key + low) if j % half_rows else mix(low + salt[j // half_rows])
                raw, sets = memoryview(g), [None] * len(n)
                for i in full:
                    sets[i] = xxhash.xxh3_128_digest(raw[at[i] : at[i + 1]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * 2 * m)]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(sets, pa.binary()), lists], ["id", "n", "set", "keys"])

    return run


def _set_maker(k: int):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi in chunks(column):
                g, at = shingles_of(column.slice(lo, hi - lo), k)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], ["rep", "items"])

    return run


def with_set(docs: DataFrame, *, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with ``set``, the digest of each text's shingle set (empty for an empty set)."""
    at = docs.columns.index(text_col)

    def run(batches):
        import xxhash

        for batch in batches:
            for lo, hi in chunks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                g, ends = shingles_of(part.column(at), shingle)
                raw = memoryview(g)
                digests = [xxhash.xxh3_128_digest(raw[a:b]) if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())], [*part.schema.names, "set"])

    schema = docs.schema
    return docs.mapInArrow(lean(run), type(schema)([*schema.fields]).add("set", "binary"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, half_rows: int = 4, collections: int = 16, seed: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept, set`` (a digest; null for an empty set).

    Texts are lower-cased in A-Z and cut to words at space and \\t..\\r; a row's set holds its
    distinct ``shingle``-word shingles (fewer words: the whole sequence as one). Two rows are
    linked when 100 * intersection >= percent * union. ``component_id`` is the smallest id
    reachable, ``kept`` tells whether that is the row's own id.

    Null, empty and blank texts have an empty set, are linked with nothing and kept. Rows with a
    null id are linked with nothing: ``component_id`` is null, ``kept`` true. Rows that repeat an
    id are judged by their own texts under the common id; ``kept`` can be true for several of them. Other columns are ignored; an empty table gives none."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialise(source.mapInArrow(lean(_sketcher(shingle, half_rows, collections, seed)), "id long, n long, set binary, keys array<long>"), "sketch")

    # one representative for all rows with the same set
    classes = materialise(sketches.where("n > 0 AND id IS NOT NULL").groupBy("set").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.min("n").alias("n")), "classes")
    halves = classes.select("rep", "n", F.posexplode("keys").alias("pos", "half"))
    lefts, rights = (F.collect_list(F.when((F.col("pos") < collections) == left, F.col("half"))).alias(name) for name, left in (("lefts", True), ("rights", False)))
    sides = _held_twice(halves, "half").groupBy("rep", "n").agg(lefts, rights).where("size(lefts) > 0 AND size(rights) > 0")
    each = sides.select("rep", "n", F.explode("lefts").alias("l"), "rights").select("rep", "n", "l", F.explode("rights").alias("r"))
    rows = materialise(each.select(F.xxhash64("l", "r").alias("key"), "rep", "n"), "tables")
    members = materialise(_held_twice(rows, "key"), "members")
    discard(rows)

    reps = materialise(members.select("rep").distinct(), "reps")
    texts = restrict(source.withColumnRenamed("id", "rep"), reps, reps.count(), "rep")
    sets = materialise(texts.mapInArrow(lean(_set_maker(shingle)), "rep long, items array<long>").dropDuplicates(["rep"]), "sets")
    discard(reps)

    links = _verified_links(members, sets, percent)
    discard(members)
    discard(sets)
    names = classes.select("set", "rep").join(links.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("comp", "rep").alias("component_id"))
    merged = sketches.select("id", "n", F.when(F.col("n") > 0, F.col("set")).alias("set")).join(names, "set", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return merged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"), "set")


def _held_twice(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` stands in two rows at least."""
    held = materialise(rows.groupBy(key).agg(F.count("*").alias("held")).where("held > 1"), "held")
    hot = hot_keys(held, key, "held")
    return spread(rows, hot, key, "rep").join(replicate(held.select(key), hot, key), [key, "salt"]).drop("salt")


def _rare_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """``(key, rep, n, pos)``: the shingles among each set's first n - ceil(n * percent / 100) + 1
    in the order of rising frequency among ``sets``. Two sets of the wanted similarity share one of
    them at least, and the first that they share tells how much can follow (``pos`` from 0).
    Shingles of one set alone come first in that order and are only counted."""
    tokens = sets.select("rep", F.size("items").alias("n"), F.explode("items").alias("key"))
    held = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(held, "key").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    first = ranked.withColumn("alone", F.col("n") - F.size("own")).withColumn("room", F.expr(f"n - (n * {percent} + 99) div 100 + 1 - alone")).where("room > 0")
    return first.select("rep", "n", "alone", F.posexplode(F.slice("own", 1, F.col("room").cast("int")))).select(F.col("col.key").alias("key"), "rep", "n", (F.col("alone") + F.col("pos")).alias("pos"))


def _with_salt(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` with a salt that spreads large buckets, the buckets' sizes ``(key, held)``, and the hot keys."""
    sizes = materialise(members.groupBy("key").agg(F.count("*").alias("held")), "sizes")
    hot = hot_keys(sizes, "key", "held")
    return spread(members, hot, "key", "rep"), sizes, hot


def _mixed(named: DataFrame, hot: DataFrame) -> DataFrame:
    """The members of buckets that hold two components or more."""
    keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return named.join(replicate(keys, hot, "key"), ["key", "salt"], "left_semi")


def _with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, n_pairs: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar enough. ``a`` is a pivot, which many pairs may share: each pair fetches
    ``b``'s set first, and then meets ``a``'s, which is sent once for each salt."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = restrict(sets, wanted, 2 * n_pairs, "rep")
    left, right = (own.select(F.col("rep").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", "n")
    both = F.size(F.array_intersect("items_a", "items_b"))
    met = spread(pairs, hot, "a", "b").join(right, "b").join(replicate(left, hot, "a"), ["a", "salt"])
    return met.where(100 * both >= percent * (F.size("items_a") + F.size("items_b") - both)).select("a", "b")


def _verified_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, comp)`` of the representatives that are linked with another one."""
    links = labels = done = None
    pivots_per_key = 1
    members, sizes, hot = _with_salt(members.withColumn("pos", F.lit(0)))
    while True:
        if labels is None:
            named = members.withColumn("comp", F.col("rep"))
        elif pivots_per_key == PIVOT_STEP:  # from here on, buckets are those of rare shingles
            left = materialise(_mixed(_with_labels(members, labels), hot).select("rep").distinct(), "left")
            rare = materialise(_rare_tokens(restrict(sets, left, left.count(), "rep"), percent), "rare")
            members, sizes, hot = _with_salt(rare)
            named = _mixed(_with_labels(members, labels), hot)
        else:
            named = _mixed(_with_labels(members, labels), hot)
        base = materialise(named.join(replicate(sizes, hot, "key"), ["key", "salt"]), "named")
        part = F.when(F.col("held") <= pivots_per_key, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep"), F.lit(pivots_per_key)))
        chosen = base.groupBy("key", part.alias("part")).agg(F.min_by(F.struct("rep", "comp", "n", "pos"), "rep").alias("p"))
        pivots = chosen.select("key", *[F.col(f"p.{x}").alias(f"p_{x}") for x in ("rep", "comp", "n", "pos")])
        alike = f"100 * least(n, p_n) >= {percent} * greatest(n, p_n)"
        room = f"{100 + percent} * least(n - pos, p_n - p_pos) >= {percent} * (n + p_n)"
        met = base.join(replicate(pivots, hot, "key"), ["key", "salt"]).where(f"comp <> p_comp AND {alike} AND {room}")
        pairs = met.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        n_pairs = pairs.count()
        if n_pairs:
            found = materialise(_confirmed(pairs, sets, percent, n_pairs), "found")
            links = found if links is None else links.union(found)
        if labels is None or n_pairs and found.limit(1).count():
            labels = connected_components(links if links is not None else pairs)
        open_buckets = pivots_per_key == 1 or base.where(F.col("held") > pivots_per_key).limit(1).count()
        done = pairs if done is None else done.union(pairs)
        discard(base)
        if not open_buckets:
            return labels
        pivots_per_key *= PIVOT_STEP


def op4_near_dup(spark, sf_dir):
    """Near duplicates of ``documents``: 4-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("set")
