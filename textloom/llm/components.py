"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step hangs nodes below the smallest neighbour; when nothing changes, every node hangs below the smallest
node of its component.  Links inside a partition are contracted first, so that dense groups shrink to trees before
anything is shuffled.  Each round is checkpointed, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import checkpointed, sweep

MAX_ROUNDS = 60


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes ``0 .. n - 1`` joined by links ``a, b``: the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:  # follow labels to their ends
            far = new[new]
            if (far == new).all():
                break
            new = far
        if (new == label).all():
            return label
        label = new


def _contract(batches):
    a, b = [], []
    for batch in batches:
        a.append(batch["a"].to_numpy())
        b.append(batch["b"].to_numpy())
        if sum(map(len, a)) > 1 << 20:
            a, b = ([x] for x in contracted(np.concatenate(a), np.concatenate(b)))
            if len(a[0]) > 1 << 19:  # trees that large are passed on
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], names=["a", "b"])
                a, b = [], []
    if a:
        x, y = contracted(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components: every node but the smallest of its component, and that smallest."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_labels(len(nodes), places[: len(a)], places[len(a) :])
    below = label < np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node in ``links`` (long columns ``a`` and ``b``); ``component`` is the smallest id."""
    tree = checkpointed(links.select("a", "b").mapInArrow(_contract, "a long, b long").distinct())
    last = None
    for _ in range(MAX_ROUNDS):
        both = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: larger neighbours hang below the smallest neighbour.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself do.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct())
        now = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components didn't settle")
    sweep(links.sparkSession)
    roots = tree.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return tree.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
