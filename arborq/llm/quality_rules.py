"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Texts that pass the base rules become vectors of transformed statistics. The
minimum-covariance-determinant estimate is found by concentration steps: distances by the current
mean and covariance, the nearest 51 % of the group, their mean and covariance again, from three
fixed starts; after two steps the start of the smallest determinant goes on, until its determinant
stops falling. So up to 49 % of a group may be outlying, copies of one text among them.

Every language-source group has an estimate, however small: its moments are mixed with those of its
language, and these with those of all rows, by their numbers of rows against ``MEAN_PRIOR`` and
``PRIOR``. Rows whose squared Mahalanobis distance exceeds the cutoff are rejected. A covariance never gets smaller than
``FLOORS``: where nearly all texts of a group agree in a statistic (no symbols at all, say), a
plain determinant would be zero and any text that differs would be rejected.

A step is one pass: distances fall into bins of 3 %, and each bin's sums are added before they
shuffle. The bin in which the 51 % end counts in part, so copies of one text never count for more.
Estimates are one small row a group and join the rows by group and salt; nothing but two numbers a
step comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
X = ("x0", "x1", "x2", "x3")
#: Standard deviations that are added (in squares) to the estimated ones, by statistic.
FLOORS = (0.05, 0.4, 0.4, 0.05)
#: Share of a group that an estimate rests on, and what makes the covariance of that share of normal rows consistent (4 statistics).
SHARE, CONSISTENT = 0.51, 2.077
#: Rows of the wider group that a group's own rows are weighed against, for covariances and for means.
PRIOR, MEAN_PRIOR = 100.0, 25.0
SALTS = 32
#: Bins of a distance: so many for each doubling.
FINE = 24
#: A determinant that falls by less than this share has stopped falling.
STILL = 1e-3


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(hashes: Column) -> Column:
    """Number of words in 3-word windows that stand twice or more, of an array of word hashes.

    Equal windows are neighbours after sorting (window, position); the windows' positions, sorted,
    cover three words each without counting one twice. n log n steps for n words."""

    def windows(h):
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def positions(s):
        again = F.filter(s, lambda e, i: (e["g"] == F.get(s, i - 1)["g"]) | (e["g"] == F.get(s, i + 1)["g"]))
        return F.sort_array(F.transform(again, lambda e: e["i"]))

    def covered(p):
        steps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(ordered, lambda s: _let(positions(s), covered)))

    return _let(hashes, lambda h: _let(windows(h), count))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Words, characters in words, symbols, repeated lines and repeated words of every whole text; null texts have none.

    Windows are compared by a 64-bit hash of theirs: two different ones of a text of n words agree
    with a chance below n * n / 2^65."""
    named = lambda c, alias: F.col(c).cast("string").alias(alias)
    text = docs.select(F.col(id_col).alias("id"), named(lang_col, "lang"), named(source_col, "source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    hashes = F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return text.select(
        "id", "lang", "source",
        _let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeated_words(h).cast("long").alias("n_repeat_words"))).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, WORD, ""))).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _vector() -> list[Column]:
    n = F.col("n_words")
    return [
        F.log(F.col("word_chars") / n).alias("x0"),
        F.log1p(1000 * F.col("n_symbols") / F.col("word_chars")).alias("x1"),
        F.log1p(1000 * F.col("n_dup_lines") / n).alias("x2"),
        F.asin(F.sqrt(F.col("n_repeat_words") / n)).alias("x3"),
    ]


P = len(X)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MIDDLE = [f"m{i}" for i in range(P)]
SPREAD = [f"s{i}{j}" for i, j in PAIRS]
FACTOR = [f"l{i}{j}" for i, j in PAIRS]


def _salted(groups: DataFrame) -> DataFrame:
    """A group's row once for each salt, so that the rows of no group have to meet in one task."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _factor() -> dict[str, Column]:
    """The Cholesky factor of the covariance in the columns ``s00, s10, ..``, by the names of :data:`FACTOR`."""
    out: dict[str, Column] = {}
    for i in range(P):
        for j in range(i + 1):
            c = F.col(f"s{i}{j}") * CONSISTENT + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                c = c - (F.pow(out[f"l{i}{k}"], F.lit(2.0)) if i == j else out[f"l{i}{k}"] * out[f"l{j}{k}"])
            out[f"l{i}{j}"] = F.sqrt(F.greatest(c, F.lit(FLOORS[i] ** 2 / 4))) if i == j else c / out[f"l{j}{j}"]
    return out


def _with_factor(moments: DataFrame, *keys: str) -> DataFrame:
    """``keys``, moments, factor, and ``det``, half the logarithm of the determinant."""
    factor = _factor()
    det = sum((F.log(factor[f"l{i}{i}"]) for i in range(1, P)), F.log(factor["l00"]))
    return moments.select(*keys, *MIDDLE, *SPREAD, *[c.alias(name) for name, c in factor.items()], det.alias("det"))


def _distance() -> Column:
    """The squared Mahalanobis distance of a row joined with its group's means and factor."""
    z: list[Column] = []
    for i, x in enumerate(X):
        off = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            off = off - F.col(f"l{i}{j}") * z[j]
        z.append(off / F.col(f"l{i}{i}"))
    return sum((F.pow(c, F.lit(2.0)) for c in z[1:]), F.pow(z[0], F.lit(2.0)))


def _starts(points: DataFrame) -> DataFrame:
    """``(grp, start, m0.., s00, s10, ..)``, from one pass: medians and quartile distances, lower quartiles with the same
    distances (what is junk has high statistics), means with the plain covariance."""
    quartiles = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, x in enumerate(X)]
    plain = [F.covar_pop(X[i], X[j]).alias(f"s{i}{j}") for i, j in PAIRS]
    seen = materialise(points.groupBy("grp").agg(*quartiles, *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *plain), "mcd-starts")
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0)) for i in range(P)]
    diagonal = [(spread[i] if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS]
    at = lambda k: [F.col(f"q{i}")[k].alias(f"m{i}") for i in range(P)]
    by_rank = [seen.select("grp", F.lit(start).alias("start"), *at(k), *diagonal) for start, k in ((0, 1), (1, 0))]
    return by_rank[0].union(by_rank[1]).union(seen.select("grp", F.lit(2).alias("start"), *MIDDLE, *SPREAD))


def _step(points: DataFrame, now: DataFrame) -> DataFrame:
    """``(grp, start, was, n, m0.., s00, .., l00, .., det)`` of the ``ceil(SHARE * n)`` rows of each group and start that are
    nearest by the moments and factor ``now``, in one pass over the rows: the bin of distances in which they end counts by the part that is left.

    Sums are of differences from the means before, which are near. ``was`` is the determinant by ``now``."""
    z = [F.col(x) - F.col(m) for x, m in zip(X, MIDDLE, strict=True)]
    names = ["k", *[f"t{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
    known = now.select("grp", "start", *MIDDLE, *FACTOR)
    far = points.join(_salted(known), ["grp", "salt"]).withColumn("d2", _distance())
    nth = F.floor(F.log2(F.greatest("d2", F.lit(1e-9))) * FINE).cast("int")
    sums = [F.count("*").alias("k"), *[F.sum(z[i]).alias(f"t{i}") for i in range(P)], *[F.sum(z[i] * z[j]).alias(f"q{i}{j}") for i, j in PAIRS]]
    bins = far.groupBy("grp", "start", nth.alias("bin")).agg(*sums)
    group = Window.partitionBy("grp", "start")
    bins = bins.withColumns({"n": F.sum("k").over(group), "before": F.sum("k").over(group.orderBy("bin")) - F.col("k")})
    w = F.least(F.greatest((F.ceil(F.col("n") * SHARE) - F.col("before")) / F.col("k"), F.lit(0.0)), F.lit(1.0))
    total = bins.groupBy("grp", "start").agg(F.first("n").alias("n"), *[F.sum(w * F.col(c)).alias(c) for c in names])
    means = [F.col(f"t{i}") / F.col("k") for i in range(P)]
    moments = total.join(now.select("grp", "start", *MIDDLE, F.col("det").alias("was")), ["grp", "start"]).select(
        "grp", "start", "was", "n",
        *[(F.col(f"m{i}") + means[i]).alias(f"m{i}") for i in range(P)],
        *[(F.col(f"q{i}{j}") / F.col("k") - means[i] * means[j]).alias(f"s{i}{j}") for i, j in PAIRS],
    )
    return _with_factor(moments, "grp", "start", "was", "n")


def mcd_moments(points: DataFrame, most: int = 30) -> DataFrame:
    """``(grp, n, m0.., s00, ..)`` of each group of ``points(grp, salt, x0..)``: three starts with two concentration steps
    each; then that of the smallest determinant alone, until no group's determinant falls by a share of :data:`STILL` any more
    (``most`` steps at most: a guard against steps that go round, not met in practice)."""
    now = materialise(_with_factor(_starts(points), "grp", "start"), "mcd")
    for step in range(most):
        now = materialise(_step(points, now), "mcd")
        if step == 1:
            best = now.groupBy("grp").agg(F.min(F.struct("det", "start")).alias("b")).select("grp", "b.start")
            now = materialise(now.join(best, ["grp", "start"]), "mcd-best")
        elif step > 1 and not now.where(F.col("det") < F.col("was") - STILL / 2).limit(1).count():
            break
    return now.select("grp", "n", *MIDDLE, *SPREAD)


def _mixed(own: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """Moments of ``own`` mixed with those of the wider group that ``key`` names (``wide``, by its ``grp``): means with the
    weights n and :data:`MEAN_PRIOR`, covariances with the rows of the subset beyond one a statistic, and :data:`PRIOR`."""
    up = wide.select(F.col("grp").alias(key), *[F.col(c).alias(f"w_{c}") for c in MIDDLE + SPREAD])
    free = F.greatest(F.ceil(F.col("n") * SHARE) - P, F.lit(0))
    blend = lambda c, n, prior: ((n * F.col(c) + prior * F.col(f"w_{c}")) / (n + prior)).alias(c)
    both = own.join(up, key)
    return both.select("grp", "n", *[blend(m, F.col("n"), MEAN_PRIOR) for m in MIDDLE], *[blend(c, free, PRIOR) for c in SPREAD])


def mcd_estimates(points: DataFrame) -> DataFrame:
    """``(own, m0.., l00, ..)`` of every language-source group of ``points(own, lang, salt, x0..)``.

    Each row takes part in three groups: its own, its language's and that of all rows."""
    levels = F.explode(F.array(F.concat(F.lit("group "), "own"), F.concat(F.lit("language "), "spoken"), F.lit("all")))
    moments = mcd_moments(materialise(points.select(levels.alias("grp"), "salt", *X), "quality-vectors"))
    parents = materialise(points.select("own", "spoken").distinct(), "quality-groups")
    every = moments.where("grp = 'all'")
    spoken = _mixed(moments.where("grp LIKE 'language %'").withColumn("up", F.lit("all")), every, "up")
    named = parents.select(F.concat(F.lit("group "), "own").alias("grp"), F.concat(F.lit("language "), "spoken").alias("up"), "own")
    own = moments.where("grp LIKE 'group %'").join(named, "grp")
    return materialise(_with_factor(_mixed(own, spoken, "up").join(named.select("grp", "own"), "grp"), "own"), "mcd-estimates")


def quality_rules(docs: DataFrame, *, alpha: float = 0.04, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)`` of every row.

    ``base_failed``: under 50 words, or more than half of them in repeated 3-word windows.
    ``kept``: false for those, else whether the squared distance is at most ``4 / alpha``: whatever the distribution of the
    four statistics, at most a share ``alpha`` of rows of the estimated mean and covariance lies beyond that (Chebyshev's
    inequality for vectors). Every row that passes the base rules has a distance. A null language or source is a value like
    others. Null, empty and blank texts fail the base rules. Null and repeated ids are carried, ties and repeated rows are
    judged each; other columns are ignored; an empty table gives none."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    salt = F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    named = {"base_failed": failed, "salt": salt, "own": F.to_json(F.struct("lang", "source")), "spoken": F.to_json(F.struct("lang"))}
    rows = materialise(base_statistics(docs, id_col, text_col, lang_col, source_col).withColumns(named), "quality-stats")
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    points = rows.where("NOT base_failed").select(*columns, "own", "spoken", "salt", *_vector())
    found = points.join(_salted(mcd_estimates(points)), ["own", "salt"]).withColumn("d2", _distance())
    judged = found.select(*columns, (F.col("d2") <= P / alpha).alias("kept"), F.col("d2").alias("distance"))
    lost = rows.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.union(lost).withColumnRenamed("id", id_col)


def op1_quality_rules(spark, sf_dir):
    """Base rules and robust outliers over all ``documents``."""
    return quality_rules(table(spark, sf_dir, "documents"))
