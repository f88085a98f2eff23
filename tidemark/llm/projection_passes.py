"""Near-duplicate vectors by sorted projection passes.

In each pass, vectors are ordered lexicographically by the concatenation of
``BITS`` random-hyperplane hashes, and each is compared with the next
``NEIGHBOURS`` in that order. Links found in any pass are united. The number
of passes follows from the number of vectors: a pair at the limit shares the
first b bits with probability (1 - angle / pi) ** b, and b is what brings as
many vectors together as the window holds.

Vectors that are equal are one class from the start. Dense groups outgrow any
window, so two things follow. Runs of vectors that share those b bits and are
more than the window holds are compared whole, rows outside the run's largest
component with all. And links are counted inside each component, all classes
with all. Both go block against block, each two blocks a row that any task can
take, and list no pairs. Cosines are in double precision throughout.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, uniting
from ..storage import Workspace
from .grid import all_blocks, open_blocks

LIMIT = 0.95
BITS = 48
NEIGHBOURS = 24
#: A pair at the limit may be missed with this probability.
MISS = 0.003
#: Rows of a sorted partition, about.
PART_ROWS = 50_000
#: Classes in a block when links are counted, about.
BLOCK = 512


def depth_for(n: int) -> float:
    """How many bits bring as many of n evenly spread vectors together as the window holds."""
    return max(0.0, math.log2(max(n, 1) / NEIGHBOURS))


def passes_for(n: int, limit: float = LIMIT) -> int:
    """How many passes n vectors need."""
    share = (1 - math.acos(limit) / math.pi) ** depth_for(n)
    return 1 if share >= 1 - MISS else math.ceil(math.log(MISS) / math.log(1 - share))


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number, 90_017]).standard_normal((dim, BITS))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    return x


def _read(batches):
    """Usable vectors as unit vectors in bytes, with a digest that equal ones share."""
    for batch in batches:
        column = batch.column("vec")
        n = batch.num_rows
        out, marks = [None] * n, np.zeros((n, 2), dtype=np.int64)
        if n:
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(valid):
                v = values[at[i] : at[i + 1]]
                if len(v) and np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()
                    out[i] = (v / math.sqrt(float(v @ v))).tobytes()
                    marks[i] = np.frombuffer(hashlib.blake2b(out[i], digest_size=16).digest(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], names=["id", "vec", "mark1", "mark2"])


def _keys(passes: int):
    """Each vector once for each pass with the hashes of that pass as an integer."""

    def run(batches):
        weights = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            sizes = np.array([len(v.as_buffer()) // 8 for v in batch.column("vec")], dtype=np.int64)
            for dim in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                x = _unit(own.column("vec").to_pylist())
                for p in range(passes):
                    key = ((x @ _planes(int(dim), p)) >= 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, dtype=np.int32)), pa.array(np.full(len(x), dim, dtype=np.int32)), pa.array(key), own.column("id"), own.column("vec")], names=["pass", "dim", "key", "id", "vec"])

    return run


_SCAN = "u long, v long, border int, side int, pass int, dim int, id long, vec binary"
_SCAN_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("border", pa.int32()), ("side", pa.int32()), ("pass", pa.int32()), ("dim", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())])


def _near(x: np.ndarray, ids: np.ndarray, fresh: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows in order, of rows from number fresh on with the NEIGHBOURS rows before them."""
    u, v = [], []
    for k in range(1, min(NEIGHBOURS, len(x) - 1) + 1):
        first = max(fresh, k)
        good = np.flatnonzero(np.einsum("ij,ij->i", x[first:], x[first - k : len(x) - k]) >= limit) + first
        u.append(ids[good])
        v.append(ids[good - k])
    return (np.concatenate(u), np.concatenate(v)) if u else (ids[:0], ids[:0])


def _scan(limit: float):
    """Links inside a sorted partition, as many as unite its rows, and its first and last rows for the comparison over its borders."""

    def edge(rows: pa.RecordBatch, border: int, side: int) -> pa.RecordBatch:
        n = rows.num_rows
        none = pa.nulls(n, pa.int64())
        number = lambda k: pa.array(np.full(n, k, dtype=np.int32))
        return pa.RecordBatch.from_arrays([none, none, number(border), number(side), rows.column("pass"), rows.column("dim"), rows.column("id"), rows.column("vec")], schema=_SCAN_ARROW)

    def run(batches):
        me, tail, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if seen < NEIGHBOURS:
                yield edge(batch.slice(0, NEIGHBOURS - seen), me - 1, 1)
            seen += batch.num_rows
            old = tail.num_rows if tail is not None else 0
            rows = pa.Table.from_batches([tail, batch] if old else [batch]).combine_chunks().to_batches()[0]
            order = rows.column("pass").to_numpy().astype(np.int64) << 32 | rows.column("dim").to_numpy()
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(order)) + 1)], [*cuts[1:], len(order)], strict=True):
                if b <= old:
                    continue
                part = rows.slice(a, b - a)
                u, v = _near(_unit(part.column("vec").to_pylist()), part.column("id").to_numpy(), max(old - a, 0), limit)
                used = uniting(u.tolist(), v.tolist())
                u, v = u[used], v[used]
                none = pa.nulls(len(u), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none, none, none, pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary())], schema=_SCAN_ARROW)
            tail = rows.slice(max(0, rows.num_rows - NEIGHBOURS))
        if tail is not None:
            yield edge(tail, me, 0)

    return run


def _over_border(limit: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["pass", "dim"], sort=False):
            x, ids, side = _unit(part["vec"].tolist()), part["id"].to_numpy(), part["side"].to_numpy()
            a, b = np.nonzero((x[side == 0] @ x[side == 1].T) >= limit)
            out.append(pd.DataFrame({"u": ids[side == 0][a], "v": ids[side == 1][b]}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype="int64")

    return run


def _count(limit: float):
    """For the classes of one block, the members of linked classes in another."""

    def run(batches):
        for batch in batches:
            ids, links = [], []
            for x, y, same in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("same").to_pylist(), strict=True):
                a, b = ([r["vec"] for r in rows] for rows in (x, y))
                linked = (_unit(a) @ _unit(b).T) >= limit
                if same:
                    np.fill_diagonal(linked, False)
                ids += [r["id"] for r in x]
                links += (linked @ np.array([r["n"] for r in y], dtype=np.int64)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["id", "links"])

    return run


def _unite(limit: float):
    """Of the links between two blocks of a run, the ones that unite components."""

    def run(batches):
        for batch in batches:
            u, v = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                ids, parts = ([np.array([r[c] for r in rows], dtype=np.int64) for rows in (x, y)] for c in ("id", "component"))
                linked = (_unit([r["vec"] for r in x]) @ _unit([r["vec"] for r in y]).T) >= limit
                a, b = np.nonzero(linked & (parts[0][:, None] != parts[1]))
                used = uniting(parts[0][a].tolist(), parts[1][b].tolist())
                u += ids[0][a[used]].tolist()
                v += ids[1][b[used]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _run_links(nodes: DataFrame, keyed: DataFrame, label: DataFrame, bits: int, limit: float, work: Workspace) -> DataFrame:
    """Links (u, v) among all vectors that share their first bits in a pass, where they are too many for the window."""
    nodes = work.table(nodes.join(label, F.col("id") == F.col("node"), "left").select("id", "vec", F.coalesce("component", "id").alias("component")), "labelled")
    run = ["pass", "dim", "run"]
    keys = keyed.select("pass", "dim", F.shiftright("key", BITS - bits).alias("run"), "id").join(nodes.select("id", "component"), "id")
    keys = work.table(keys, "keys")
    crowds = keys.groupBy(*run).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    crowds = crowds.filter(f"n > {NEIGHBOURS + 1} AND low <> high").select(*run)
    rows = work.table(keys.join(crowds, run).join(nodes.select("id", "vec"), "id"), "runs")
    return work.table(open_blocks(rows, run, F.lit(1), BLOCK, work, "id", "component", "vec").select("x", "y").mapInArrow(_unite(limit), "u long, v long"), "links")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", limit: float = LIMIT) -> DataFrame:
    """One row for each row of rows: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing, and so do rows without an id (component_id null, kept).
    Vectors of different lengths, however long, are not compared. Repeated rows
    are vectors of their own with a common id; equal vectors all link. Other
    columns, whatever their names, are not read. An empty table gives an empty
    one.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "projection-passes")
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    read = work.table(vectors.mapInArrow(_read, "id long, vec binary, mark1 long, mark2 long"), "vectors")
    usable = read.filter("vec IS NOT NULL AND id IS NOT NULL")
    classes = work.table(usable.groupBy("mark1", "mark2").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    nodes = classes.select(F.col("head").alias("id"), "n", "vec")
    total = classes.count()
    passes = passes_for(total, limit)

    order = ["pass", "dim", "key", "id"]
    keys = nodes.select("id", "vec").mapInArrow(_keys(passes), "pass int, dim int, key long, id long, vec binary")
    keyed = keys.repartitionByRange(max(1, total * passes // PART_ROWS), *order).sortWithinPartitions(*order)
    scanned = work.table(keyed.select("pass", "dim", "id", "vec").mapInArrow(_scan(limit), _SCAN), "scan")
    borders = scanned.filter("border IS NOT NULL").select("border", "side", "pass", "dim", "id", "vec")
    found = scanned.filter("border IS NULL").select("u", "v").union(borders.groupBy("border").applyInPandas(_over_border(limit), "u long, v long"))
    label = components(found.filter("u <> v"), work)
    more = _run_links(nodes, keys, label, int(depth_for(total)), limit, work)
    label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), work)

    roots = label.select(F.col("component").alias("node"), "component").distinct()
    placed = work.table(nodes.join(label.union(roots), F.col("id") == F.col("node")).select("id", "n", "vec", "component"), "placed")
    counted = all_blocks(placed, ["component"], BLOCK, work, "id", "n", "vec").select("x", "y", "same").mapInArrow(_count(limit), "id long, links long")
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))

    heads = classes.select("mark1", "mark2", F.col("head"), F.col("n").alias("copies"))
    heads = heads.join(placed.select(F.col("id").alias("head"), "component"), "head", "left").join(counted.select(F.col("id").alias("head"), "links"), "head", "left")
    out = read.withColumn("ok", F.col("vec").isNotNull() & F.col("id").isNotNull()).drop("vec").alias("r")
    out = out.join(heads.alias("h"), (F.col("r.mark1") == F.col("h.mark1")) & (F.col("r.mark2") == F.col("h.mark2")) & F.col("r.ok"), "left")
    component = F.when(F.col("r.id").isNotNull(), F.coalesce("h.component", "h.head", "r.id"))
    links = F.when(F.col("r.ok"), F.col("h.copies") - 1 + F.coalesce("h.links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("r.id").alias(id_col), links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("r.id"), F.lit(True)).alias("kept"))
