"""A proximity index of pivots: coarse cells in a layered neighbour graph, kept as state tables and extended by inserts.

A cell is a unit center and the pivots nearer to it than to other centers (as
far as the graph's search finds). Cells are linked with their nearest ones;
every few cells one belongs to the upper layer too, where a search starts. A
search walks the graph best first, all vectors of an Arrow batch a step at a
time, and ends when the best cells known have all been visited. Vectors then
meet the pivots of their cells in a join, and the topics of the nearest of
these are measured by all of their pivots.

What goes to every task is the cells' graph alone, whose size is bounded by
``settings.broadcast_bytes``: with more pivots cells get larger, and not more
numerous. Pivots stay in tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..deploy import ship
from ..functions.vectors import cosine_distance, norm
from ..storage import Workspace
from ..streaming.state import Snapshots
from .distances import pair_distances, top_topics

DEGREE = 12  #: links of a cell when it is made
PART = 4096  #: pivots of a cell that one task compares; a crowded cell has several parts

SCHEMAS = {
    "cell": "cell_id long, v array<double>, n long, upper boolean, near array<long>",
    "entry": "cell_id long, pivot_id long, topic_id long, v array<double>",
    "gone": "pivot_id long",
}


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Graph:
    """The cells as matrices: ids, unit centers, links by place (-1 for none) and the places of the upper layer."""

    def __init__(self, ids: np.ndarray, center: np.ndarray, counts: np.ndarray, upper: np.ndarray, near: list[list[int]]):
        self.ids, self.center, self.counts = ids, center, counts
        self.upper = np.flatnonzero(upper) if upper.any() else np.arange(min(1, len(ids)))
        place = {c: k for k, c in enumerate(ids.tolist())}
        self.links = np.full((len(ids), max([1, *map(len, near)])), -1)
        for k, links in enumerate(near):
            own = [place[c] for c in links if c in place]
            self.links[k, : len(own)] = own

    def walk(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors v the places of the nearest ``width`` cells found (-1 for none), their distances, and how many were measured."""
        n, m = len(v), len(self.ids)
        seen = np.zeros((n, m + 1), dtype=bool)  # the last column stands for no cell
        seen[:, m] = True
        seen[:, self.upper] = True
        took = np.full(n, len(self.upper))
        place = np.broadcast_to(self.upper, (n, len(self.upper)))
        place, dist, opened = self._best(place, 1 - v @ self.center[self.upper].T, np.zeros(place.shape, dtype=bool), width)
        while True:
            first = np.where(opened, np.inf, dist).argmin(axis=1)
            rows = np.flatnonzero(~opened[np.arange(n), first] & np.isfinite(dist[np.arange(n), first]))
            if not len(rows):
                return np.where(np.isfinite(dist), place, -1), dist, took
            opened[rows, first[rows]] = True
            reached = self.links[place[rows, first[rows]]]
            reached = np.where(reached < 0, m, reached)
            fresh = ~seen[rows[:, None], reached]
            seen[rows[:, None], reached] = True
            took[rows] += fresh.sum(axis=1)
            far = np.full((n, reached.shape[1]), np.inf)
            away = 1 - np.einsum("ijk,ik->ij", self.center[np.where(fresh, reached, 0)], v[rows])
            far[rows] = np.where(fresh, away, np.inf)
            more = np.zeros((n, reached.shape[1]), dtype=place.dtype)
            more[rows] = np.where(fresh, reached, 0)
            place, dist, opened = self._best(np.hstack([place, more]), np.hstack([dist, far]), np.hstack([opened, np.zeros(more.shape, dtype=bool)]), width)

    @staticmethod
    def _best(place, dist, opened, width):
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return tuple(np.take_along_axis(x, order, axis=1) for x in (place, dist, opened))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)


def _probing(shared, width: int, every: bool):
    """Rows beside the cells that the walk finds, one for each part of a cell; or with the number of distances only."""

    def run(batches):
        graph: Graph = shared.value
        parts = 1 + graph.counts // PART
        for whole in batches:
            step = max(1, (8 << 20) // max(1, len(graph.ids)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                place, _, took = graph.walk(_unit(_vectors(batch)), width)
                if every:
                    rows, col = np.nonzero(place >= 0)
                    cells = place[rows, col]
                    again = parts[cells]
                    part = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                    rows, cells = np.repeat(rows, again), np.repeat(cells, again)
                else:  # the nearest cell only
                    rows, cells, part = np.arange(len(place)), place[:, 0], np.zeros(len(place), dtype=np.int64)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(graph.ids[cells]), pa.array(part.astype(np.int64)), pa.array(took[rows].astype(np.int64))],
                    names=[*batch.schema.names, "cell_id", "part", "took"],
                )

    return run


def _linking(shared, degree: int):
    """(cell_id, near): the nearest other cells of each."""

    def run(batches):
        ids, center = shared.value
        for whole in batches:
            step = max(1, (4 << 20) // max(1, len(ids)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own = batch.column("cell_id").to_numpy()
                dist = 1 - _vectors(batch) @ center.T
                dist[own[:, None] == ids[None, :]] = np.inf
                near = np.argsort(dist, axis=1, kind="stable")[:, : min(degree, len(ids) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[near].tolist(), pa.list_(pa.int64()))], names=["cell_id", "near"])

    return run


class PivotIndex:
    """The index below a folder that all executors share; every build or insert is a version, committed as a whole.

    Vectors have one length, ``dim``; others are a ValueError. Null and zero
    vectors and ones that aren't finite have no distance: as pivots they are
    left out, as documents they have no rows. Ties go to the lowest id; of rows
    with one pivot_id the one with the lowest topic and vector stays.
    """

    def __init__(self, spark: SparkSession, dim: int, settings: Settings | None = None, root: str | None = None):
        self.spark, self.dim, self.settings = spark, dim, settings or Settings()
        self.snapshots = Snapshots(spark, root or Workspace(spark, "pivot-index").path)

    def table(self, name: str) -> DataFrame:
        return self.snapshots.read(name, SCHEMAS[name])

    def entries(self) -> DataFrame:
        """(cell_id, part, pivot_id, topic_id, v) of the pivots in living cells."""
        cells = self.table("cell").select("cell_id", (1 + F.floor(F.col("n") / PART)).alias("parts"))
        rows = self.table("entry").join(F.broadcast(cells), "cell_id").join(self.table("gone"), "pivot_id", "left_anti")
        return rows.select("cell_id", F.pmod(F.xxhash64("pivot_id"), "parts").alias("part"), "pivot_id", "topic_id", "v")

    def _able(self, rows: DataFrame) -> DataFrame:
        if rows.filter(F.size("v") != self.dim).filter("v IS NOT NULL").limit(1).count():
            raise ValueError(f"vectors must have {self.dim} components")
        n = norm(F.col("v"))
        return rows.filter(F.col("v").isNotNull() & (n > 0) & (n < float("inf"))).withColumn("v", F.col("v").cast("array<double>"))

    def _pivots(self, rows: DataFrame) -> DataFrame:
        one = self._able(rows.select("pivot_id", "topic_id", "v")).groupBy("pivot_id").agg(F.min(F.struct("topic_id", "v")).alias("b"))
        return one.select("pivot_id", "b.topic_id", "b.v")

    def _next(self) -> int:
        latest = self.snapshots.latest()
        return 0 if latest is None else latest + 1

    def _most_cells(self) -> int:
        return max(1, self.settings.broadcast_bytes // (8 * (self.dim + 4 * DEGREE)))

    def build(self, pivots: DataFrame) -> None:
        """A new index of pivots (pivot_id, topic_id, v). Centers are the pivots with the lowest hashes, some 2 sqrt(n) of them."""
        work = Workspace(self.spark, "pivot-index-build")
        rows = work.table(self._pivots(pivots), "pivots")
        m = min(self._most_cells(), max(1, math.ceil(2 * math.sqrt(rows.count()))))
        chosen = rows.orderBy(F.xxhash64("pivot_id"), "pivot_id").limit(m).select("v").toArrow().combine_chunks()
        center = _unit(chosen.column("v").combine_chunks().flatten().to_numpy().reshape(chosen.num_rows, -1)) if chosen.num_rows else np.empty((0, self.dim))
        upper = np.arange(len(center)) % max(1, math.isqrt(len(center))) == 0
        near = self._links(np.arange(len(center)), center, np.arange(len(center)))
        graph = Graph(np.arange(len(center)), center, np.zeros(len(center), dtype=np.int64), upper, [near[k] for k in range(len(center))])
        placed = work.table(self._placed(rows, graph), "placed")
        self._commit(graph, placed, {"gone": self.table("gone").limit(0)}, whole=True)
        work.clear()

    def insert(self, pivots: DataFrame) -> int:
        """Adds pivots to the cells that they lie in; only these are written. Returns how many cells were touched.

        A pivot that is there already is put in its new place. A cell that has
        grown beyond twice the usual size, half the root of the number of pivots, is split in two around its own
        two pivots of lowest hash, while the bound on cells allows: its pivots
        move to the new cells, which its neighbours are linked with instead.
        """
        work, graph = Workspace(self.spark, "pivot-index-insert"), self._graph()
        if not len(graph.ids):
            n = self._pivots(pivots).count()
            self.build(pivots)
            return n and len(self._graph().ids)
        rows = work.table(self._placed(self._pivots(pivots), graph), "placed")
        # a pivot that comes again leaves its old entry behind: all of its cell is written anew
        written = self.table("entry").join(F.broadcast(self.table("cell").select("cell_id")), "cell_id", "left_semi")  # erased ones too
        known = work.table(written.join(rows.select("pivot_id"), "pivot_id", "left_semi").select("cell_id").distinct(), "known")
        counts = dict(rows.groupBy("cell_id").count().collect())  # bounded by the number of cells
        usual = math.sqrt(graph.counts.sum() + sum(counts.values())) / 2
        stale = {r["cell_id"] for r in known.collect()}
        touched = set(counts) | stale
        place = {c: k for k, c in enumerate(graph.ids.tolist())}
        room = self._most_cells() - len(graph.ids)
        full = [c for c in sorted(counts) if graph.counts[place[c]] + counts[c] > 2 * max(usual, 8)][: max(0, room)]
        retired = work.table(self.spark.createDataFrame([(c,) for c in sorted(stale | set(full))], "cell_id long"), "retired")
        old = self.entries().join(F.broadcast(retired), "cell_id").join(rows.select("pivot_id"), "pivot_id", "left_anti").select(*rows.columns)
        moving = old.unionByName(rows.join(F.broadcast(retired), "cell_id", "left_semi"))
        graph, seeds = self._replaced(graph, moving, stale, full)
        moved = self._placed_by(moving, seeds)
        staying = rows.join(F.broadcast(retired), "cell_id", "left_anti")
        self._commit(graph, work.table(staying.unionByName(moved), "entries"), {"gone": self.table("gone").join(rows.select("pivot_id"), "pivot_id", "left_anti")})
        work.clear()
        return len(touched)

    def erase(self, pivots: DataFrame) -> None:
        """Takes pivots (pivot_id) out; their entries go when their cell is written next."""
        latest = self.snapshots.latest()
        self.snapshots.write(self._next(), self.snapshots.parts(latest), {}, {"gone": pivots.select("pivot_id")})

    def _graph(self) -> Graph:
        rows = self.table("cell").orderBy("cell_id").toArrow().combine_chunks()
        v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, self.dim))
        ids, n, upper = (rows.column(c).to_numpy() for c in ("cell_id", "n", "upper"))
        return Graph(ids, v, n, upper.astype(bool), rows.column("near").to_pylist())

    def _links(self, ids: np.ndarray, center: np.ndarray, of: np.ndarray) -> dict[int, list[int]]:
        if not len(of):
            return {}
        shared = self.spark.sparkContext.broadcast((ids, center))
        ship(self.spark)
        rows = self.spark.createDataFrame([(int(c), center[k].tolist()) for k, c in enumerate(ids) if c in set(of.tolist())], "cell_id long, v array<double>")
        return dict(rows.mapInArrow(_linking(shared, DEGREE), "cell_id long, near array<long>").collect())

    def _placed(self, rows: DataFrame, graph: Graph) -> DataFrame:
        """rows (pivot_id, topic_id, v) with the cell that each lies in."""
        if not len(graph.ids):
            return rows.withColumn("cell_id", F.lit(0).cast("long")).select("cell_id", "pivot_id", "topic_id", "v").limit(0)
        ship(self.spark)
        shared = self.spark.sparkContext.broadcast(graph)
        schema = "pivot_id long, topic_id long, v array<double>, cell_id long, part long, took long"
        return rows.select("pivot_id", "topic_id", "v").mapInArrow(_probing(shared, 4, False), schema).select("cell_id", "pivot_id", "topic_id", "v")

    def _replaced(self, graph: Graph, moving: DataFrame, stale: set[int], full: list[int]) -> tuple[Graph, DataFrame]:
        """The graph with new cells in place of retired ones, and (old, cell_id, center) of these."""
        lowest = Window.partitionBy("cell_id").orderBy("hash", "pivot_id")
        first = moving.groupBy("cell_id", "v").agg(F.min(F.struct(F.xxhash64("pivot_id").alias("hash"), "pivot_id")).alias("b")).select("cell_id", "v", "b.hash", "b.pivot_id")
        two = first.withColumn("rank", F.row_number().over(lowest)).filter("rank <= 2").orderBy("cell_id", "rank").collect()
        ids, centers, upper, near = graph.ids.tolist(), list(graph.center), np.isin(np.arange(len(graph.ids)), graph.upper).tolist(), [[int(graph.ids[p]) for p in links if p >= 0] for links in graph.links]
        at, made, becomes = max(ids) + 1, [], {}
        for c in sorted(stale | set(full)):
            k = graph.ids.tolist().index(c)
            own = [r["v"] for r in two if r["cell_id"] == c] if c in full else []
            for v in own if len(own) == 2 else [graph.center[k]]:
                v = _unit(np.asarray(v, dtype=float)[None, :])[0]
                made.append((c, at, v.tolist()))
                becomes.setdefault(c, []).append(at)
                ids.append(at)
                centers.append(v)
                upper.append(bool(upper[k]) and len(becomes[c]) == 1)
                near.append(list(near[k]))
                at += 1
        for c, new in becomes.items():  # those linked with a cell are linked with what has replaced it, and these with each other
            for k, links in enumerate(near):
                if c in links:
                    near[k] = [x for x in links if x != c] + [x for x in new if x != ids[k]]
            for x in new:
                k = ids.index(x)
                near[k] = sorted(set(near[k]) | set(new) - {x})
        keep = [k for k, c in enumerate(ids) if c not in becomes]
        out = Graph(np.array([ids[k] for k in keep]), np.array([centers[k] for k in keep]).reshape(len(keep), -1), np.zeros(len(keep), dtype=np.int64), np.array([upper[k] for k in keep]), [near[k] for k in keep])
        return out, self.spark.createDataFrame(made, "old long, new_id long, center array<double>")

    def _placed_by(self, moving: DataFrame, seeds: DataFrame) -> DataFrame:
        """Pivots of retired cells in the nearer of the cells that came in their place: one or two."""
        near = moving.join(F.broadcast(seeds), F.col("cell_id") == F.col("old")).withColumn("dist", cosine_distance(F.col("v"), F.col("center")))
        best = near.groupBy("pivot_id").agg(F.min_by(F.struct("new_id", "topic_id", "v"), F.struct("dist", "new_id")).alias("b"))
        return best.select(F.col("b.new_id").alias("cell_id"), "pivot_id", "b.topic_id", "b.v")

    def _commit(self, graph: Graph, entries: DataFrame, replaced: dict[str, DataFrame], whole: bool = False) -> None:
        parts = {} if whole else self.snapshots.parts(self.snapshots.latest())
        living = self.spark.createDataFrame([(int(c),) for c in graph.ids], "cell_id long")
        rows = entries if whole else self.table("entry").join(self.table("gone"), "pivot_id", "left_anti").select("cell_id").unionByName(entries.select("cell_id"))
        counts = dict(rows.join(F.broadcast(living), "cell_id", "left_semi").groupBy("cell_id").count().collect())  # bounded by the number of cells
        up = set(graph.upper.tolist())
        cells = [(int(c), graph.center[k].tolist(), counts.get(int(c), 0), k in up, [int(graph.ids[p]) for p in graph.links[k] if p >= 0]) for k, c in enumerate(graph.ids)]
        replaced = replaced | {"cell": self.spark.createDataFrame(cells, SCHEMAS["cell"])}
        self.snapshots.write(self._next(), parts, replaced, {"entry": entries})

    def _probed(self, docs: DataFrame, width: int) -> DataFrame:
        """(doc_id, v, cell_id, part, took) of the cells in which a document's pivots are looked for."""
        graph = self._graph()
        rows = self._able(docs.select("doc_id", "v"))
        schema = "doc_id long, v array<double>, cell_id long, part long, took long"
        if not len(graph.ids):
            return self.spark.createDataFrame([], schema)
        ship(self.spark)
        return rows.mapInArrow(_probing(self.spark.sparkContext.broadcast(graph), width, True), schema)

    def _near(self, docs: DataFrame, width: int) -> DataFrame:
        """(doc_id, topic_id, pivot_id, dist) of documents and the pivots in their cells, but themselves."""
        left, right = self._probed(docs, width).alias("d"), self.entries().alias("p")
        pairs = left.join(right, (F.col("d.cell_id") == F.col("p.cell_id")) & (F.col("d.part") == F.col("p.part"))).filter("d.doc_id <> p.pivot_id")
        return pairs.select("d.doc_id", "p.topic_id", "p.pivot_id", cosine_distance(F.col("d.v"), F.col("p.v")).alias("dist"))

    def _candidates(self, docs: DataFrame, k: int, width: int) -> DataFrame:
        """(doc_id, topic_id) of the 2k topics with the nearest pivots found."""
        best = self._near(docs, width).groupBy("doc_id", "topic_id").agg(F.min("dist").alias("dist"))
        order = Window.partitionBy("doc_id").orderBy("dist", "topic_id")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 * k).select("doc_id", "topic_id")

    def nearest_topics(self, docs: DataFrame, k: int, width: int = 16) -> DataFrame:
        """(doc_id, rank, topic_id, dist) of the k nearest topics found by pair distance, each measured by all of its pivots.

        ``width`` is how many cells are kept on the walk and looked into: with
        more the result comes nearer to ``distances.nearest_topics``, which is exact.
        """
        pairs = self._candidates(docs, k, width).join(docs.select("doc_id", "v").alias("d"), "doc_id").join(self.entries().alias("p"), "topic_id").filter("doc_id <> pivot_id")
        pairs = pairs.select("doc_id", "topic_id", "pivot_id", cosine_distance(F.col("d.v"), F.col("p.v")).alias("dist"))
        return top_topics(pair_distances(pairs), k).select("doc_id", "rank", "topic_id", "dist")

    def visited(self, docs: DataFrame, k: int, width: int = 16) -> DataFrame:
        """(doc_id, computed, all): how many distances a search computes, those to cells and of candidates' pivots among them, and the number of pivots."""
        sizes = self.entries().groupBy("cell_id").agg(F.count("*").alias("n"))
        walked = self._probed(docs, width).filter("part = 0").join(sizes, "cell_id", "left").groupBy("doc_id").agg((F.first("took") + F.coalesce(F.sum("n"), F.lit(0))).alias("w"))
        topics = self.entries().groupBy("topic_id").agg(F.count("*").alias("n"))
        again = self._candidates(docs, k, width).join(topics, "topic_id").groupBy("doc_id").agg(F.sum("n").alias("a"))
        total = self.entries().agg(F.count("*").alias("all"))
        return walked.join(again, "doc_id", "left").crossJoin(F.broadcast(total)).select("doc_id", (F.col("w") + F.coalesce("a", F.lit(0))).alias("computed"), "all")
