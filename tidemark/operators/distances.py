"""Distances between documents and pivots, pair distances of topics, matching and top-k.

A topic's *pair distance* from a vector is the sum of the distances of its two
nearest pivots. Where only a few topics of each document are wanted, a kernel
on Arrow batches keeps them without listing all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..deploy import ship
from ..functions.vectors import cosine_distance, norm


def with_norm(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", norm(F.col("v")))


def blocks_for(rows: DataFrame, settings: Settings) -> int:
    """In how many blocks rows with vectors v are sent; 1 if they may be broadcast, by number and by bytes."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return max(1, -(-n // settings.broadcast_pivots), -(-n * 8 * max(dim or 0, 0) // settings.broadcast_bytes))


def _beside(left: DataFrame, right: DataFrame, key: str, blocks: int) -> DataFrame:
    """All rows of left (d) beside all of right (p): right is broadcast, or both are dealt over a grid of blocks."""
    if blocks == 1:
        return with_norm(left).alias("d").crossJoin(F.broadcast(with_norm(right)).alias("p"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return with_norm(left).alias("d").join(with_norm(right).alias("p"), F.col("d.block") == F.col("p.block"))


def pivot_pairs(docs: DataFrame, pivots: DataFrame, settings: Settings | None = None, measure=None) -> DataFrame:
    """(doc_id, topic_id, pivot_id, dist) of docs (doc_id, v) with all pivots (pivot_id, topic_id, v) but themselves.

    Pivots are the engine's state and usually few: up to
    ``settings.broadcast_pivots`` and ``broadcast_bytes`` they are broadcast,
    after a count. Beyond that, both sides are dealt over a grid of blocks and
    joined on it.
    """
    settings = settings or Settings()
    pivots = pivots.select("pivot_id", "topic_id", "v")
    pairs = _beside(docs.select("doc_id", "v"), pivots, "pivot_id", blocks_for(pivots, settings)).filter(F.col("d.doc_id") != F.col("p.pivot_id"))
    a, b = F.col("d.v"), F.col("p.v")
    dist = measure(a, b) if measure else cosine_distance(a, b, F.col("d.norm"), F.col("p.norm"))
    return pairs.select("d.doc_id", "p.topic_id", "p.pivot_id", dist.alias("dist")).filter("dist IS NOT NULL")


def pair_distances(pairs: DataFrame) -> DataFrame:
    """(doc_id, topic_id, dist): the sum of the two nearest pivots; topics with one pivot are not eligible."""
    nearest = Window.partitionBy("doc_id", "topic_id").orderBy("dist", "pivot_id")
    two = pairs.withColumn("rank", F.row_number().over(nearest)).filter("rank <= 2")
    return two.groupBy("doc_id", "topic_id").agg(F.sum("dist").alias("dist"), F.count("*").alias("n")).filter("n = 2").drop("n")


def pair_distances_or(pairs: DataFrame, missing: float) -> DataFrame:
    """As pair_distances, with a stand-in for the second pivot of topics with one."""
    nearest = Window.partitionBy("doc_id", "topic_id").orderBy("dist", "pivot_id")
    two = pairs.withColumn("rank", F.row_number().over(nearest)).filter("rank <= 2")
    return two.groupBy("doc_id", "topic_id").agg((F.sum("dist") + F.when(F.count("*") < 2, missing).otherwise(0.0)).alias("dist"))


def member_distances(pairs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, topic_id, dist): the mean of the two nearest members, or the only one's distance; and more aggregates of these two."""
    nearest = Window.partitionBy("doc_id", "topic_id").orderBy("dist", "pivot_id")
    return pairs.withColumn("rank", F.row_number().over(nearest)).filter("rank <= 2").groupBy("doc_id", "topic_id").agg(F.avg("dist").alias("dist"), *more)


def single_distances(pairs: DataFrame) -> DataFrame:
    """(doc_id, topic_id, dist): the nearest pivot's topic at twice its distance."""
    best = pairs.groupBy("doc_id").agg(F.min(F.struct("dist", "topic_id", "pivot_id")).alias("b"))
    return best.select("doc_id", F.col("b.topic_id").alias("topic_id"), (2 * F.col("b.dist")).alias("dist"))


def best_topic(scored: DataFrame) -> DataFrame:
    """(doc_id, topic_id, dist) of the nearest topic; ties go to the lowest one."""
    best = scored.groupBy("doc_id").agg(F.min(F.struct("dist", "topic_id")).alias("b"))
    return best.select("doc_id", F.col("b.topic_id").alias("topic_id"), F.col("b.dist").alias("dist"))


def match(docs: DataFrame, scored: DataFrame, beta: float, any_topic: bool = True) -> DataFrame:
    """(doc_id, topic_id, dist) for all docs: the nearest topic below beta, -1 for no match, -2 where there are no topics."""
    out = docs.select("doc_id").join(best_topic(scored), "doc_id", "left")
    none = F.lit(-1 if any_topic else -2).cast("long")
    return out.select("doc_id", F.when(F.col("dist") < beta, F.col("topic_id")).otherwise(none).alias("topic_id"), "dist")


def top_topics(scored: DataFrame, k: int) -> DataFrame:
    """(doc_id, rank, topic_id, dist) of the k nearest topics."""
    order = Window.partitionBy("doc_id").orderBy("dist", "topic_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def top_limits(scored: DataFrame, k: int, missing: float) -> DataFrame:
    """(doc_id, n_topics, top_limit): the worst kept distance, or the stand-in while fewer than k topics are known."""
    top = top_topics(scored, k).groupBy("doc_id").agg(F.count("*").alias("n_topics"), F.max("dist").alias("worst"))
    return top.select("doc_id", "n_topics", F.when(F.col("n_topics") < k, missing).otherwise(F.col("worst")).alias("top_limit"))


def inverse_top(scored: DataFrame, k: int) -> DataFrame:
    """(topic_id, rank, doc_id, dist): the k nearest subscriptions of each topic."""
    order = Window.partitionBy("topic_id").orderBy("dist", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("topic_id", "rank", "doc_id", "dist")


class Balls:
    """Pivots of one vector length by topic, and a ball around each topic's: a unit center and an angle that reaches all of them."""

    def __init__(self, ids: np.ndarray, topics: np.ndarray, unit: np.ndarray):
        names, place, counts = np.unique(topics, return_inverse=True, return_counts=True)
        kept = counts[place] > 1  # a topic with one pivot has no pair distance
        order = np.lexsort((ids[kept], topics[kept]))
        self.ids, self.unit = ids[kept][order], unit[kept][order]
        self.names, self.first, self.counts = np.unique(topics[kept], return_index=True, return_counts=True)
        self.first = np.cumsum(self.counts) - self.counts
        sums = np.add.reduceat(self.unit, self.first, axis=0) if len(self.names) else np.empty((0, unit.shape[1]))
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        self.center = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
        place = np.repeat(np.arange(len(self.names)), self.counts)
        reach = np.arccos(np.clip((self.unit * self.center[place]).sum(axis=1), -1, 1))
        self.reach = np.maximum.reduceat(reach, self.first) if len(self.names) else np.empty(0)
        self.reach[size[:, 0] == 0] = np.pi

    def nearest(self, doc: np.ndarray, v: np.ndarray, k: int, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector the k nearest topics below its limit, their pair distances (inf for none), and how many distances that took.

        Two pivots in a ball lie at least as far as its nearest point, twice.
        Each vector meets the k topics of the lowest bounds first; then only
        those whose bound doesn't exceed the k-th distance found, or the limit.
        """
        n, t = len(doc), len(self.names)
        score, took = np.full((n, t), np.inf), np.full(n, t, dtype=np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        able = np.isfinite(unit).all(axis=1)
        unit[~able] = 0
        apart = np.arccos(np.clip(unit @ self.center.T, -1, 1)) - self.reach
        bound = 2 * (1 - np.cos(np.clip(apart, 0, np.pi))) - 1e-9
        most = np.full(n, np.inf) if limit is None else np.where(np.isnan(limit), np.inf, limit)
        todo = np.zeros((n, t), dtype=bool)
        np.put_along_axis(todo, np.argpartition(bound, min(k, t) - 1, axis=1)[:, :k], True, axis=1)
        todo &= able[:, None] & (bound <= most[:, None])
        self._measure(doc, unit, todo, score, took)
        known = np.minimum(np.partition(score, min(k, t) - 1, axis=1)[:, min(k, t) - 1] if k <= t else np.inf, most)
        self._measure(doc, unit, able[:, None] & ~todo & (bound <= known[:, None]), score, took)
        if limit is not None:
            score[score >= most[:, None]] = np.inf
        best = np.argsort(score, axis=1, kind="stable")[:, :k]
        return best, np.take_along_axis(score, best, axis=1), took

    def _measure(self, doc, unit, todo, score, took) -> None:
        for t in np.flatnonzero(todo.any(axis=0)):
            rows, own = np.flatnonzero(todo[:, t]), slice(self.first[t], self.first[t] + self.counts[t])
            dist = 1 - unit[rows] @ self.unit[own].T
            dist[doc[rows][:, None] == self.ids[own][None, :]] = np.inf
            score[rows, t] = np.partition(dist, 1, axis=1)[:, :2].sum(axis=1)
            took[rows] += self.counts[t]


def _kernel(shared, k: int, limited: bool, count: bool):
    def run(batches):
        balls: dict[int, Balls] = shared.value
        everything = sum(len(b.ids) for b in balls.values())
        for batch in batches:
            vectors = batch.column("v")
            sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
            starts, doc = np.cumsum(sizes) - sizes, batch.column("doc_id").to_numpy()
            limit = batch.column("top_limit").to_numpy(zero_copy_only=False) if limited else None
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size not in balls or not len(balls[size].names):
                    if count:
                        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(np.zeros(len(rows), np.int64)), pa.array(np.full(len(rows), everything))], names=["doc_id", "computed", "all"])
                    continue
                own = balls[size]
                best, value, took = own.nearest(doc[rows], flat[starts[rows][:, None] + np.arange(size)], k, limit[rows] if limited else None)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(took), pa.array(np.full(len(rows), everything))], names=["doc_id", "computed", "all"])
                    continue
                row, col = np.nonzero(np.isfinite(value))
                yield pa.RecordBatch.from_arrays([pa.array(doc[rows][row]), pa.array((col + 1).astype(np.int64)), pa.array(own.names[best[row, col]]), pa.array(value[row, col])], names=["doc_id", "rank", "topic_id", "dist"])

    return run


def _balls(pivots: DataFrame) -> dict[int, Balls]:
    rows = pivots.select("pivot_id", "topic_id", F.col("v").cast("array<double>").alias("v")).filter(F.size("v") > 0).orderBy("pivot_id").toArrow()
    ids, topics, lists = (rows.column(c).combine_chunks() for c in ("pivot_id", "topic_id", "v"))
    ids, topics, flat, sizes = ids.to_numpy(), topics.to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    starts, out = np.cumsum(sizes) - sizes, {}
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        v = flat[starts[own][:, None] + np.arange(size)]
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = v / np.sqrt((v**2).sum(axis=1, keepdims=True))
        good = np.isfinite(unit).all(axis=1)
        out[size] = Balls(ids[own][good], topics[own][good], unit[good])
    return out


_NEAREST = "doc_id long, rank long, topic_id long, dist double"


def nearest_topics(docs: DataFrame, pivots: DataFrame, k: int, settings: Settings | None = None) -> DataFrame:
    """(doc_id, rank, topic_id, dist) of the k nearest topics by pair distance, without listing pairs.

    Up to ``settings.broadcast_pivots`` pivots, checked by a count, go to the
    executors as matrices and documents stream past them in Arrow batches,
    passing by the topics whose ball is too far (``Balls``); beyond that the
    relational form takes over. Vectors are compared with pivots of their own
    length; null, empty and zero ones, and ones that aren't finite, have no
    distance.
    """
    settings = settings or Settings()
    if blocks_for(pivots, settings) > 1:
        return top_topics(pair_distances(pivot_pairs(docs, pivots, settings)), k).select("doc_id", "rank", "topic_id", "dist")
    return _streamed(docs.select("doc_id", "v"), pivots, k, False)


def entering_topics(subs: DataFrame, pivots: DataFrame, k: int, settings: Settings | None = None) -> DataFrame:
    """As nearest_topics, for subscriptions (doc_id, v, top_limit): only topics nearer than a subscription's limit, null for none.

    The limit, as the radius within which a topic may enter, keeps a
    subscription from being scored against topics whose ball lies outside.
    """
    settings = settings or Settings()
    if blocks_for(pivots, settings) > 1:
        near = pair_distances(pivot_pairs(subs, pivots, settings)).join(subs.select("doc_id", "top_limit"), "doc_id")
        return top_topics(near.filter(F.col("top_limit").isNull() | (F.col("dist") < F.col("top_limit"))), k).select("doc_id", "rank", "topic_id", "dist")
    return _streamed(subs.select("doc_id", "v", "top_limit"), pivots, k, True)


def distances_computed(docs: DataFrame, pivots: DataFrame, k: int) -> DataFrame:
    """(doc_id, computed, all): how many distances nearest_topics (with a top_limit, entering_topics) computes, centers among them, and how many pivots there are."""
    limited = "top_limit" in docs.columns
    return _streamed(docs.select("doc_id", "v", *(["top_limit"] if limited else [])), pivots, k, limited, count=True)


def _streamed(docs: DataFrame, pivots: DataFrame, k: int, limited: bool, count: bool = False) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_balls(pivots))
    docs = docs.filter(F.size("v") > 0).withColumn("v", F.col("v").cast("array<double>"))
    return docs.mapInArrow(_kernel(shared, k, limited, count), "doc_id long, computed long, all long" if count else _NEAREST)


def within_radius(docs: DataFrame, centers: DataFrame, limit: Column, settings: Settings | None = None) -> DataFrame:
    """(doc_id, cluster_id, dist) of the clusters (cluster_id, v, radius) whose center is nearer than limit."""
    blocks = blocks_for(centers, settings or Settings())
    out = _beside(docs.select("doc_id", "v"), centers, "cluster_id", blocks)
    out = out.withColumn("dist", cosine_distance(F.col("d.v"), F.col("p.v"), F.col("d.norm"), F.col("p.norm")))
    return out.filter(F.col("dist") < limit).select("doc_id", "cluster_id", "dist")
