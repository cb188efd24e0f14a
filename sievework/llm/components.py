"""Connected components of links, by contracting the graph until no link is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, tidy, written


class Forest:
    """Union-find over the numbers 0 .. n - 1; a root is the least of its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return self.up
            self.up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.roots()
            a, b = self.up[a], self.up[b]
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.up, high, low)
            a, b = low, high


_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers that looks random; plain() undoes it."""
    x = ids.view(np.uint64) * np.uint64(_FACTORS[0])
    return ((x ^ x >> np.uint64(32)) * np.uint64(_FACTORS[1])).view(np.int64)


def plain(ids: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) * np.uint64(pow(_FACTORS[1], -1, 1 << 64))
    return ((x ^ x >> np.uint64(32)) * np.uint64(pow(_FACTORS[0], -1, 1 << 64))).view(np.int64)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)


def stars(pairs: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links, given as arrays of two columns, as stars around the least node that they connect: the
    same components from at most one link per node. They are folded every so often, so that little
    more than the distinct nodes is held."""
    held, size, most = [np.empty((0, 2), np.int64)], 0, 2_000_000

    def folded():
        nodes, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        forest = Forest(len(nodes))
        forest.join(at[:, 0], at[:, 1])
        root = nodes[forest.roots()]
        apart = root != nodes
        return np.stack([root[apart], nodes[apart]], 1)

    for some in pairs:
        held.append(some)
        size += len(some)
        if size >= most:
            held = [folded()]
            size = len(held[0])
            most = max(most, 2 * size)
    found = folded()
    for low in range(0, len(found), 100_000):
        some = found[low : low + 100_000]
        yield pa.record_batch([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["u", "v"])


def local_stars(edges: DataFrame, mix: bool = False) -> DataFrame:
    """Each task's links (u, v) as stars."""

    def run(batches):
        pairs = (np.ascontiguousarray(_columns(batch)) for batch in batches)
        yield from stars(map(mixed, pairs) if mix else pairs)

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(tidy(run), "u long, v long")


def _unmixed(labels: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = plain(np.ascontiguousarray(_columns(batch)))
            yield pa.record_batch([pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["node", "component"])

    return labels.mapInArrow(tidy(run), "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v): component is the least node reachable.

    Nodes go by a random-looking order of their ids. Each round every node points to its least
    neighbour, pointers are followed once more, and links are rewritten to what their ends point to;
    only links between different targets stay. In such an order the graph shrinks by a constant
    share each round, whatever its shape. Links with a null end or between a node and itself count
    for nothing. Hot nodes meet in sums with partial aggregation or in joins of written tables, whose
    large partitions Spark splits. The result is a written table, which the caller may drop;
    all others are deleted here.
    """
    links, labels = written(local_stars(edges.where("u <> v"), mix=True), "links"), None
    while labels is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("to"))
        # written, so that both sides of the join are plain exchanges, whose hot keys Spark can split
        least = written(least.select("n", F.least("n", "to").alias("to")), "least")
        jumped = least.alias("a").join(least.alias("b"), F.col("a.to") == F.col("b.n"))
        jumped = written(jumped.select(F.col("a.n").alias("n"), F.col("b.to").alias("to")), "pointers")
        if labels is None:
            new = jumped.select(F.col("n").alias("node"), F.col("to").alias("component"))
        else:
            far = jumped.select(F.col("n").alias("component"), "to")
            new = labels.join(far, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = written(new, "labels")
        ends = jumped.select(F.col("n").alias("u"), F.col("to").alias("a"))
        moved = links.join(ends, "u").join(ends.select(F.col("u").alias("v"), F.col("a").alias("b")), "v")
        moved = moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        rest = written(local_stars(moved.distinct()), "links")
        drop_written(links, least, jumped, *([labels] if labels is not None else []))
        links, labels = rest, new
    drop_written(links)
    found = _unmixed(labels)
    least = written(found.groupBy("component").agg(F.min("node").alias("least")), "least")
    result = written(found.join(least, "component").select("node", F.col("least").alias("component")), "components")
    drop_written(labels, least)
    return result
