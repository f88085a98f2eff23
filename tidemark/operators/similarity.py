"""Similarity self-join of vectors below a cosine distance, in blocks."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..storage import Workspace
from .components import Forest, united

BLOCK = 4096  #: what is read of two blocks grows with it, what is compared with its square
BLOCK_BYTES = 8 << 20  #: of a block's vectors, as doubles
FILE_BLOCKS = 4  #: in a file, so that a task's part of a table of blocks is bounded
TILE = 1 << 20  #: pairs whose products are held at once
CANDIDATES = 4096  #: pairs that are measured at once, one by one
DENSE = 24  #: a tile is measured whole if more than one in so many of its pairs are to be measured
FIELDS = "block long, kind string, ids binary, v binary, radius binary"


def _least(v: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds all of them exactly."""
    for kind in (np.uint8, np.uint16, np.float32):
        with np.errstate(invalid="ignore", over="ignore"):
            small = v.astype(kind)
        if (small == v).all():
            return small
    return v


def _pack(size: int, balls: bool):
    """Rows (id, v), of balls (id, v, radius), in blocks of up to so many as they come, each one row."""

    def block(rows: pa.Table, number: int):
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        small = _least(v)
        radius = rows.column("radius").to_numpy().tobytes() if balls else b""
        columns = ([number], [small.dtype.str], [rows.column("id").to_numpy().tobytes()], [small.tobytes()], [radius])
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FIELDS.split(", ")])

    def run(batches):
        task, n, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            most = max(1, min(size, BLOCK_BYTES // (8 * len(held.column("v")[0]))))
            while len(held) >= most:
                yield block(held.slice(0, most), n << 32 | task)
                held, n = held.slice(most), n + 1
        if held is not None and len(held):
            yield block(held, n << 32 | task)

    return run


def _unit(kind: str, ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors (nan for zero vectors) of a block."""
    ids = np.frombuffer(ids, np.int64)
    v = np.frombuffer(v, kind).reshape(len(ids), -1).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ids, v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def close(a: np.ndarray, b: np.ndarray, limit):
    """(i, j, dist) of unit rows of a and b at a distance below limit, a number or one for each row of b, in tiles. Products in
    single precision find all that may be below, as the margin is more than their rounding; what counts is measured in double."""
    margin = 1.2e-7 * (a.shape[1] + 8)
    least = (1 - np.asarray(limit) - margin).astype(np.float32) - np.float32(1e-7)
    single, step = b.astype(np.float32).T, max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        i, j = np.nonzero(rows.astype(np.float32) @ single > least)
        if len(i) * DENSE > len(rows) * len(b):
            dist = (1 - rows @ b.T)[i, j]
        else:
            dist = np.empty(len(i))
            for k in range(0, len(i), CANDIDATES):
                own = slice(k, k + CANDIDATES)
                dist[own] = 1 - np.einsum("ij,ij->i", rows[i[own]], b[j[own]])
        good = dist < (limit if np.ndim(limit) == 0 else limit[j])
        yield i[good] + at, j[good], dist[good]


def _pairs(batches):
    """Ids, unit vectors of both blocks and the second one's radii, of each pair of blocks. The first block stays for a while."""
    last = left = None
    for batch in batches:
        for x in batch.to_pylist():
            if x["block"] != last:
                last, left = x["block"], _unit(x["kind"], x["ids"], x["v"])
            yield x, *left, *(left if x["block2"] == last and x["ids2"] == x["ids"] and x["v2"] == x["v"] else _unit(x["kind2"], x["ids2"], x["v2"]))


def _compare(limit: float):
    def run(batches):
        for x, ia, a, ib, b in _pairs(batches):
            for i, j, dist in close(a, b, limit):
                if x["block"] == x["block2"]:
                    once = ia[i] < ib[j]
                    i, j, dist = i[once], j[once], dist[once]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ia[i], ib[j])), pa.array(np.maximum(ia[i], ib[j])), pa.array(dist)], names=["a", "b", "dist"])

    return run


def _within(batches):
    for x, ia, a, ib, b in _pairs(batches):
        for i, j, dist in close(a, b, np.frombuffer(x["radius2"], np.float64)):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ia[i]), pa.array(ib[j]), pa.array(dist)], names=["a", "b", "dist"])


def _apart(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, limit: float):
    """Roots (ra, rb) that links below limit between rows of a and b unite. Of the rows of the most frequent root, which are
    in one component already, none is compared with another."""
    roots, n = np.unique(np.concatenate([ra, rb]), return_counts=True)
    common = roots[n.argmax()]
    one, two = ra == common, rb == common
    for x, y in ((~one, np.ones(len(rb), bool)), (one, ~two)):
        us, vs = ra[x], rb[y]
        for i, j, _ in close(a[x], b[y], limit):
            u, v = us[i], vs[j]
            yield u[u != v], v[u != v]


def _grouped(size: int, limit: float):
    """Blocks in groups of FILE_BLOCKS as they come, each row with its label: the smallest id that links inside the group lead to."""
    pack = _pack(size, False)

    def run(batches):
        blocks = (x for batch in pack(batches) for x in batch.to_pylist())
        while group := list(islice(blocks, FILE_BLOCKS)):
            units = [_unit(x["kind"], x["ids"], x["v"]) for x in group]
            ids, at = np.unique(np.concatenate([i for i, _ in units]), return_inverse=True)
            at = np.split(at, np.cumsum([len(i) for i, _ in units])[:-1])
            above = np.arange(len(ids))
            for k, (_, a) in enumerate(units):
                for j, (_, b) in enumerate(units[: k + 1]):
                    for u, v in _apart(a, above[at[k]], b, above[at[j]], limit):
                        above = united(above, u, v)
            for x, k in zip(group, at, strict=True):
                row = {c: [x[c]] for c in ("block", "kind", "ids", "v")} | {"part": [group[0]["block"]], "label": [ids[above[k]].tobytes()]}
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row.values(), kinds, strict=True)], names=list(row))

    return run


def _uniting(limit: float):
    """Links (u, v) between labels of pairs of blocks, as the stars of a task."""

    def run(batches):
        forest = Forest()
        for x, _, a, _, b in _pairs(batches):
            roots = []
            for c in ("label", "label2"):
                labels, at = np.unique(np.frombuffer(x[c], np.int64), return_inverse=True)
                roots.append(np.array([forest.root(y) for y in labels.tolist()], np.int64)[at])
            nodes = np.unique(np.concatenate(roots))
            above = np.arange(len(nodes))
            for u, v in _apart(a, roots[0], b, roots[1], limit):
                above = united(above, np.searchsorted(nodes, u), np.searchsorted(nodes, v))
            for u, v in zip(nodes.tolist(), nodes[above].tolist(), strict=True):
                forest.unite(u, v)
            if forest.full():
                yield from forest.stars()
        yield from forest.stars()

    return run


def _labels(batches):
    for batch in batches:
        for x in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x[c], np.int64)) for c in ("ids", "label")], names=["id", "label"])


def _vectors(rows: DataFrame, *more: str) -> DataFrame:
    return rows.filter((F.size("v") > 0) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *more)


def _packed(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """Rows in blocks, in a table that each side of a join of blocks reads. They are packed where they lie, without a shuffle."""
    rows = _vectors(rows, *more)
    return Workspace(rows.sparkSession, "blocks").table(rows.mapInArrow(_pack(size, bool(more)), FIELDS), "rows", compression="none", maxRecordsPerFile=FILE_BLOCKS)


def _beside(left: DataFrame, right: DataFrame, which=None) -> DataFrame:
    """Pairs of blocks. A task reads a part of each table from where they are stored and pairs their blocks: nothing is
    shuffled or broadcast, so what is moved grows with the tables, and only reads and products with their square."""
    right = right.select(*[F.col(c).alias(c + "2") for c in right.columns])
    left = left.hint("shuffle_replicate_nl")
    return left.crossJoin(right) if which is None else left.join(right, which)


def _once():
    """Of blocks (x, y) and (y, x) one is taken, by turns, so that all tasks have their share."""
    x, y = F.col("block"), F.col("block2")
    return ((x < y) == ((x + y) % 2 == 0)) & (x != y)


def neighbours_within(rows: DataFrame, balls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, dist): rows (id, v) that lie nearer to a ball (id, v, radius) than its radius. Blocks of both sides meet in
    matrix products and only what lies inside is listed. Vectors have one length."""
    ship(rows.sparkSession)
    pairs = _beside(_packed(rows, block).drop("radius"), _packed(balls, block, "radius"))
    return pairs.mapInArrow(_within, "a long, b long, dist double")


def edges_below(rows: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """(a, b, dist), a < b, for all pairs of rows (id, v) at a distance below limit.

    The exact join compares all pairs; rows are packed in blocks of up to
    ``block`` so that two blocks are compared by one matrix product and
    nothing but links is listed. Vectors have one length; null and empty ones
    have no links.
    """
    ship(rows.sparkSession)
    packed = _packed(rows, block).drop("radius")
    pairs = _beside(packed, packed, (F.col("block") == F.col("block2")) | _once())
    return pairs.mapInArrow(_compare(limit), "a long, b long, dist double")


def groups_below(rows: DataFrame, limit: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, label) of rows (id, v), and links (u, v) between labels, that together have the components of edges_below.

    Rows are stored with the component that they have inside their group of
    ``FILE_BLOCKS`` blocks, so a task that compares blocks of two groups passes
    on links between such components alone, at most one for each but the last
    that it finds, and not between their rows. Rows that a task knows to be in
    one component aren't compared.
    """
    ship(rows.sparkSession)
    work = Workspace(rows.sparkSession, "groups")
    fields = "block long, kind string, ids binary, v binary, part long, label binary"
    packed = work.table(_vectors(rows).mapInArrow(_grouped(block, limit), fields), "rows", compression="none", maxRecordsPerFile=FILE_BLOCKS)
    links = _beside(packed, packed, (F.col("part") != F.col("part2")) & _once()).mapInArrow(_uniting(limit), "u long, v long")
    labels = packed.select("ids", "label").mapInArrow(_labels, "id long, label long")
    # an id that several groups hold links their labels
    more = labels.groupBy("id").agg(F.min("label").alias("v"), F.collect_set("label").alias("all")).filter(F.size("all") > 1)
    return labels, links.union(more.select(F.explode("all").alias("u"), "v"))
