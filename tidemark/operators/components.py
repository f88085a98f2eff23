"""Connected components: forests of bounded parts, then alternating large and small stars.

Links are read in parts of at most about ``PART_LINKS``; each part's links
become the stars of its own components. If there is more than one part, stars
are merged in rounds: each keeps the components and brings every node nearer
to its smallest one, and their number grows with the logarithm of the longest
path. No links or labels are gathered on the driver, only a count and a
checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

PART_LINKS = 250_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


class Forest:
    """Components of the links of one task; the root of each is its smallest node. Nodes without links are not kept."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def unite(self, u: int, v: int) -> None:
        u, v = self.root(u), self.root(v)
        if u != v:
            self.above[max(u, v)] = min(u, v)

    def stars(self):
        """Links (node, root) of all that is held, which is given up then. Many are taken in several batches."""
        nodes = list(self.above)
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([self.root(x) for x in part], pa.int64())], names=["u", "v"])
        self.above.clear()

    def full(self) -> bool:
        return len(self.above) > 2 * PART_LINKS


def _forest(batches):
    """The links of one part as stars: (node, smallest node of its component). Parts of many nodes are taken in several."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.unite(u, v)
        if forest.full():
            yield from forest.stars()
    yield from forest.stars()


def united(above: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """above, the root of each number (the smallest of its component), after links between u and v."""
    above = above.copy()
    while (apart := above[u] != above[v]).any():
        u, v = u[apart], v[apart]
        a, b = above[u], above[v]
        np.minimum.at(above, np.maximum(a, b), np.minimum(a, b))
        while ((up := above[above]) != above).any():
            above = up
    return above


def forests(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v) with the same components: those that a task finds become stars before they are written or shuffled."""
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    return edges.mapInArrow(_forest, "u long, v long")


def uniting(u, v) -> list[int]:
    """Numbers of the links (u, v) that unite components, in their order."""
    above: dict[int, int] = {}
    out = []
    for k, (x, y) in enumerate(zip(u, v, strict=True)):
        while (z := above.setdefault(x, x)) != x:
            above[x] = x = above[z]
        while (z := above.setdefault(y, y)) != y:
            above[y] = y = above[z]
        if x != y:
            above[x] = y
            out.append(k)
    return out


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for all nodes of edges (u, v: long) but the smallest of each component."""
    now = work.table(edges.select("u", "v").filter("u <> v"), "links")
    n = now.count()
    if not n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    parts = 1 + (n - 1) // PART_LINKS
    now = work.table(now.coalesce(parts).mapInArrow(_forest, "u long, v long"), "edges")
    seen = None
    while parts > 1:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        then, now = now, work.table(_small_star(_large_star(now)), "edges")
        work.drop(then)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
