"""Embedding near-duplicates by PCA-ordered, tiled comparison.

Unit vectors are turned into the basis of their second moments, largest first, so the first dimensions carry most of each
product.  Tiles are made by median splits along the leading dimensions.  A pair of tiles whose bounding boxes cannot
reach the threshold is never formed; inside a pair, products are accumulated over leading blocks of dimensions, the rest
is bounded by the product of the suffix norms (Cauchy-Schwarz), and a block stops when no pair can reach the threshold.
Pairs that remain are decided on the input vectors in double precision, so turning and splitting never change results.
Vectors that fill all directions alike leave no pair of tiles out: then all pairs of tiles are formed and the first product, of a few
dimensions, settles nearly all pairs of vectors.  The work is quadratic there, with a small factor (see README).

Equal vectors are one class, compared once and counted with their number, so a vector that a third of all rows hold
costs one row.  Links leave a task as counts and as trees of components, never as pairs.

What is fitted on a sample: the median splits alone, on about ``SAMPLE`` rows (a bound on the driver's work; it affects
speed, not results).  Tiles have about ``TILE_ROWS`` vectors however many there are; the driver holds a box for each of them.

Edge cases: vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null
id; a shorter vector counts as zeros behind; repeated ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components, local_labels
from textloom.session import checkpointed

THRESHOLD = 0.95
TILE_ROWS, SUB_ROWS = 16_384, 512
LEADING = (4, 8, 16, 32, 64, 128, 256)
SAMPLE = 20_000
SLACK = 1e-4


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dims))
    sizes = np.diff(offs)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], sizes)] = flat[offs[0] : offs[-1]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(dims: int):
    def sums(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _unit(_matrix(batch["v"], dims))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    return sums


def splits(points: np.ndarray, depth: int) -> np.ndarray:
    """Thresholds of a binary tree, level by level, that cut along dimensions 0, 1, 2, ... at the medians."""
    tree = np.zeros((1 << depth) - 1)
    groups = [points]
    at = 0
    for level in range(depth):
        nxt = []
        for g in groups:
            x = g[:, level % g.shape[1]]
            tree[at] = np.median(x) if len(g) else 0.0
            nxt += [g[x <= tree[at]], g[x > tree[at]]]
            at += 1
        groups = nxt
    return tree


def tile_of(points: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    tile = np.zeros(len(points), dtype=np.int64)
    for level in range(depth):
        tile = 2 * tile + (points[:, level % points.shape[1]] > tree[(1 << level) - 1 + tile])
    return tile


def _place(dims: int, basis: np.ndarray, tree: np.ndarray, depth: int):
    def place(batches):
        for batch in batches:
            y = _unit(_matrix(batch["v"], dims)) @ basis
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], batch["v"], pa.array(tile_of(y, tree, depth), pa.int32())], names=["id", "n", "v", "tile"])

    return place


def _boxes(dims: int, basis: np.ndarray):
    def boxes(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            y, tile = _unit(_matrix(batch["v"], dims)) @ basis, batch["tile"].to_numpy()
            for t in np.unique(tile):
                rows = y[tile == t]
                low[t] = np.minimum(low.get(t, np.inf), rows.min(axis=0))
                high[t] = np.maximum(high.get(t, -np.inf), rows.max(axis=0))
        keys = np.array(sorted(low), dtype=np.int32)
        flat = lambda d: pa.array(np.concatenate([d[t] for t in keys]) if len(keys) else np.zeros(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(keys, dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(keys))), flat(low), flat(high)],
            names=["tile", "dim", "low", "high"],
        )

    return boxes


def box_bound(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The largest product that points of two boxes can have, for each row of the second."""
    ends = np.stack([low_a * low_b, low_a * high_b, high_a * low_b, high_a * high_b])
    return ends.max(axis=0).sum(axis=-1)


def stops_of(moments: np.ndarray) -> list[int]:
    """Where the accumulation over dimensions looks whether any pair can still reach the threshold; ``moments`` are sorted, largest first.

    The first stop has a quarter of the vectors' squared length: with less, hardly a pair of unlike vectors is settled.
    """
    share = np.cumsum(moments) / max(float(moments.sum()), 1e-300)
    return [d for d in LEADING if d < len(moments) and share[d - 1] >= 0.25] + [len(moments)]


def linked_pairs(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float, same: bool, stops: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine at or above ``threshold``; ``a, b`` are turned unit rows, ``ua, ub`` unturned ones.

    Bounds are computed in single precision with a margin (``SLACK``) far above its error; what remains is decided in doubles.
    """
    out_a, out_b = [], []
    tail = lambda x, d: np.sqrt(np.maximum(0.0, (x[:, d:] ** 2).sum(axis=1))).astype(np.float32)
    # The suffix norm is one more dimension of the first product, which so is the bound itself.
    first = lambda x: np.concatenate([x[:, : stops[0]].astype(np.float32), tail(x, stops[0])[:, None]], axis=1)
    fa, fb = first(a), first(b)
    boxes = lambda x: [(x[i : i + SUB_ROWS].min(axis=0), x[i : i + SUB_ROWS].max(axis=0)) for i in range(0, len(x), SUB_ROWS)]
    boxes_a, boxes_b = boxes(a), boxes(b)
    for i in range(0, len(a), SUB_ROWS):
        for j in range(i if same else 0, len(b), SUB_ROWS):
            if box_bound(*boxes_a[i // SUB_ROWS], *boxes_b[j // SUB_ROWS]) < threshold - SLACK:
                continue
            can = fa[i : i + SUB_ROWS] @ fb[j : j + SUB_ROWS].T >= threshold - SLACK
            rows = np.nonzero(can)
            for at, d in zip(stops[:-1], stops[1:]):
                if len(rows[0]) * 16 < can.size:  # few are left: those are settled one by one
                    break
                pa_, pb = a[i : i + SUB_ROWS], b[j : j + SUB_ROWS]
                can = pa_[:, :d] @ pb[:, :d].T + np.outer(tail(pa_, d), tail(pb, d)) >= threshold - SLACK
                rows = np.nonzero(can)
            x, y = rows[0] + i, rows[1] + j
            if same:
                x, y = x[x < y], y[x < y]
            for s in range(0, len(x), 1 << 16):
                p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                hit = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
                out_a.append(p[hit])
                out_b.append(q[hit])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _pairs_of(low: np.ndarray, high: np.ndarray, threshold: float):
    """The pairs that a tile forms with itself and later ones, one row a side."""
    used = np.flatnonzero(~np.isnan(low[:, 0]))

    def plan(batches):
        for batch in batches:
            for t in batch["id"].to_pylist():
                rest = used[used >= t]
                if not len(rest) or rest[0] != t:
                    continue
                reach = box_bound(low[t], high[t], low[rest], high[rest]) >= threshold - SLACK
                reach[0] = True
                other = rest[reach]
                pair = t * len(low) + other
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(other), t), other[1:]]), pa.int32()),
                        pa.array(np.concatenate([np.zeros(len(other)), np.ones(len(other) - 1)]).astype(np.int32)),
                        pa.array(np.concatenate([pair, pair[1:]]), pa.int64()),
                    ],
                    names=["tl_tile", "side", "pair"],
                )

    return plan


def _compare(dims: int, basis: np.ndarray, threshold: float, stops: list[int]):
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, n, side = table["id"].to_numpy(), table["n"].to_numpy(), table["side"].to_numpy()
        unit = _unit(_matrix(table["v"], dims))
        turned = unit @ basis
        cut = int(np.searchsorted(side, 1))
        same = cut == len(side)
        order_a = np.lexsort(turned[:cut, :3].T[::-1])
        order_b = order_a if same else cut + np.lexsort(turned[cut:, :3].T[::-1])
        x, y = linked_pairs(turned[order_a], turned[order_b], unit[order_a], unit[order_b], threshold, same, stops)
        x, y = order_a[x], order_b[y]
        links = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
        rows = np.flatnonzero(links)
        small = np.argsort(ids, kind="stable")  # labels are the smallest ids
        rank = np.empty(len(ids), dtype=np.int64)
        rank[small] = np.arange(len(ids))
        label = small[local_labels(len(ids), rank[x], rank[y])][rank] if len(x) else np.arange(len(ids))
        return pa.table({"id": pa.array(ids[rows], pa.int64()), "links": pa.array(links[rows].astype(np.int64)), "label": pa.array(ids[label[rows]], pa.int64())})

    return compare


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: ``id_col, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    v = vectors[vector_col]
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), F.when(fine & vectors[id_col].isNotNull(), v).alias("v"))
    classes = checkpointed(rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    stats = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    many, dims = stats[0], stats[1] or 0
    if many:
        found = _links(spark, classes, many, dims, threshold)
    else:
        found = spark.createDataFrame([], "tl_id long, links long, component long")
    c = classes.join(found, classes["id"] == found["tl_id"], "left").select(
        F.col("v").alias("tl_v"), "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")
    )
    joined = rows.join(c, rows["v"] == c["tl_v"], "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links(spark, classes: DataFrame, many: int, dims: int, threshold: float) -> DataFrame:
    """``tl_id, links, component`` of the classes that link with others."""
    cells = classes.mapInArrow(_moments(dims), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    moments = np.zeros(dims * dims)
    for cell, value in cells.collect():  # dims * dims numbers
        moments[cell] = value
    spread, turn = np.linalg.eigh(moments.reshape(dims, dims))
    basis, stops = np.ascontiguousarray(turn[:, ::-1]), stops_of(np.maximum(spread[::-1], 0))
    depth = max(0, -(-many // TILE_ROWS) - 1).bit_length()
    sample = classes.select("id", "v").sample(min(1.0, SAMPLE / many), seed=1).limit(2 * SAMPLE).toArrow() if depth else None
    points = _unit(_matrix(sample["v"], dims)) @ basis if sample is not None and sample.num_rows else np.zeros((0, dims))
    tree = splits(points[:, :8], depth)
    placed = classes.mapInArrow(_place(dims, basis[:, :8], tree, depth), f"id long, n long, v {classes.schema['v'].dataType.simpleString()}, tile int")
    boxes = placed.mapInArrow(_boxes(dims, basis), "tile int, dim int, low double, high double")
    boxes = boxes.groupBy("tile", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.full((2, 1 << depth, dims), np.nan)
    for t, d, lo, hi in boxes.collect():  # a box for TILE_ROWS vectors
        low[t, d], high[t, d] = lo, hi
    plan = spark.range(0, 1 << depth, 1, max(1, (1 << depth) // 64)).mapInArrow(_pairs_of(low, high, threshold), "tl_tile int, side int, pair long")
    dealt = placed.join(plan, placed["tile"] == plan["tl_tile"]).select("pair", "side", "id", "n", "v")
    found = checkpointed(dealt.groupBy("pair").applyInArrow(_compare(dims, basis, threshold, stops), "id long, links long, label long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("id > label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    comps = comps.withColumnRenamed("id", "tl_of")
    return counts.join(comps, counts["id"] == comps["tl_of"], "left").select(F.col("id").alias("tl_id"), "links", F.coalesce("component", "id").alias("component"))
