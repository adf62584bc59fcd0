"""Connected components of an edge table, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import MAX_BROADCAST_IDS, discard, hot_keys, materialise, replicate, spread


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``, longs, in any direction and repeated or not -> ``(node, comp)`` for every
    node of an edge; ``comp`` is the smallest node reachable. No edges: an empty table.

    Each round takes the smallest label among a node and its neighbours, then follows the label
    once more (pointer jumping), so long chains shorten geometrically and stars end in two
    rounds. Aggregates combine before they shuffle; labels and edges stay distributed; each
    round's labels are written to the shared folder. A hub's edges and a large component's label are
    dealt over several tasks by salt. Only counts come to the driver."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = materialise(edges.select("a", "b").union(turned).where("a <> b").distinct(), "edges")
    hubs = hot_keys(both.groupBy("a").agg(F.count("*").alias("n")), "a", "n")
    salted = spread(both, hubs, "a", "b")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    labels = materialise(first.select("node", F.least("node", "comp").alias("comp")), "labels")
    while True:
        known = replicate(labels.withColumnRenamed("node", "a"), hubs, "a")
        near = salted.join(known, ["a", "salt"]).groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        step = materialise(step, "steps")
        after = _jumped(step, labels)
        changed = after.where("was <> comp").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels.select("node", "comp")


def _jumped(step: DataFrame, labels: DataFrame) -> DataFrame:
    """``step(node, was, comp)`` with each label followed once more, where it is a node with a smaller label itself. Such
    labels get few soon, and are broadcast then; while they are many, the rows of a label are dealt over several tasks."""
    moved = labels.where("node <> comp").select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    moved = materialise(moved.join(step.select("comp").distinct(), "comp", "left_semi"), "moved")
    n = moved.count()
    if not n:
        return step
    if n <= MAX_BROADCAST_IDS:
        both = step.join(F.broadcast(moved), "comp", "left")
    else:
        large = hot_keys(step.groupBy("comp").agg(F.count("*").alias("n")), "comp", "n")
        both = spread(step, large, "comp", "node").join(replicate(moved, large, "comp"), ["comp", "salt"], "left")
    return materialise(both.select("node", "was", F.coalesce("far", "comp").alias("comp")), "labels")
