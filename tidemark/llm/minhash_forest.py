"""Near-duplicate texts by an LSH forest over MinHash signatures.

Each distinct shingle set has one signature of 48 minima. A tree is one cyclic
order of that signature: tree t starts at its minimum number 3t, so the first
three minima of the sixteen trees are independent. Rows that share at least
``MIN_DEPTH`` minima of a tree form a region; rows that are alone in all their
regions have no near copy and take no further part. The others are sorted by
each tree's order, where longest-common-prefix neighbours stand next to each
other. Candidates are confirmed on the full shingle sets:

1. each row with the next ``NEIGHBOURS`` rows of its region in all trees. Each
   row's likeliest candidate goes first, then its likeliest among those that
   the found links leave in another component, then all that are left. Trees
   are sorted over ranges of (region, order), so that no task holds a region;
2. all rows of a region that are still in different components. Regions of up
   to ``REGION_ROWS`` rows list their pairs. Larger ones list none: rows outside
   the region's largest component are compared with all of its rows, block
   against block, each two blocks a row of their own that any task can take,
   first by signatures, then the rows that have a like one by their full sets.
   Rows of the largest component, which step 1 has joined, aren't compared with
   each other.

Step 2 knows no depth and no cap, so the region of two rows decides alone
whether they meet: two sets of similarity 0.75 share none of the sixteen with a
probability of 0.00016, whatever the size of the group they lie in. Its work is
(rows outside the largest component) x (rows) of a region. A link that an
already known path implies need not be confirmed. Texts with equal shingle sets
are one row from the start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import Workspace
from .grid import open_blocks
from .words import LOWER, Block, blocks, full_runs, run_hash, span_hash

SHINGLE = 5
TREES = 16
MIN_DEPTH = 3
#: Minima by which the rows of a region are sorted.
KEY_DEPTH = 8
MINIMA = TREES * MIN_DEPTH
NEIGHBOURS = 2
#: Rounds in which each row's likeliest candidate is confirmed before all others are.
FIRST_ROUNDS = 2
#: Larger regions are compared in blocks.
REGION_ROWS = 16
#: Rows of a block of signatures, and shingles of a block of sets, about.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 17
#: A set counts as so many shingles at least, which bounds the rows of a block.
LEAST_SHINGLES = BLOCK_SHINGLES // BLOCK_ROWS
#: Shingles that are compared in one matrix product.
COLUMNS = 4096
#: Links need 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Candidates with fewer equal minima are dropped unconfirmed: at similarity 0.75 that has a probability under 1e-5.
LEAST_EQUAL = 21

_rng = np.random.default_rng(7077)
_MUL = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64)


def shingles(block: Block, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block's texts, repeats included, and the range of them for each text."""
    block = Block(block.first, LOWER[block.data], block.offsets)
    starts, ends, bounds = block.words()
    hashes = block.hashes(starts, ends)
    counts = np.diff(bounds)
    at, _ = full_runs(bounds, n)
    runs = run_hash(hashes, n)
    each = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    ranges = np.concatenate(([0], np.cumsum(each)))
    out = np.empty(ranges[-1], dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.ones(len(out), dtype=bool)
        whole[ranges[short]] = False
        out[whole] = runs[at]
        out[ranges[short]] = span_hash(hashes, bounds[short], bounds[short + 1])
    else:
        out[:] = runs[at] if len(at) else 0
    return out, ranges


def _signatures(batches):
    for batch in batches:
        texts = batch.column("text")
        n = np.zeros(len(texts), dtype=np.int64)
        marks, signatures = np.zeros((len(texts), 2), dtype=np.int64), [None] * len(texts)
        for block in blocks(texts):
            all_, ranges = shingles(block)
            used = np.flatnonzero(np.diff(ranges))
            if not len(used):
                continue
            minima = np.empty((len(used), MINIMA), dtype=">u4")
            for j in range(MINIMA):
                minima[:, j] = np.minimum.reduceat((all_ * _MUL[j] + _ADD[j]) >> np.uint64(32), ranges[used])
            for i, k in enumerate(used):
                own = np.unique(all_[ranges[k] : ranges[k + 1]])
                n[block.first + k] = len(own)
                marks[block.first + k] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                signatures[block.first + k] = minima[i].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.array(signatures, pa.binary())], names=["id", "n", "mark1", "mark2", "signature"])


def _sets(batches):
    for batch in batches:
        out = [b""] * batch.num_rows
        for block in blocks(batch.column("text")):
            all_, ranges = shingles(block)
            for k in range(len(block)):
                out[block.first + k] = np.unique(all_[ranges[k] : ranges[k + 1]]).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "shingles"])


def _alike(batches):
    """Pairs whose signatures agree often enough, with the number of equal minima."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=">u4").reshape(-1, MINIMA) for c in ("sa", "sb"))
        equal = (a == b).sum(axis=1).astype(np.int32)
        good = pa.array(equal >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(equal).filter(good)], names=["a", "b", "equal"])


def _confirm(batches):
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            if 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            good[i] = 100 * common >= SIMILARITY * (len(both) - common)
        good = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["u", "v"])


def _neighbours(batches):
    """Rows in the order of a tree with the rows before them in their region, as (a, b, equal) with like signatures.

    A pair over the border of two tasks is left to the comparison of whole regions.
    """
    region, ids, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, MINIMA), dtype=">u4")
    for batch in batches:
        old = len(ids)
        region = np.concatenate((region, batch.column("region").to_numpy()))
        ids = np.concatenate((ids, batch.column("id").to_numpy()))
        found = np.concatenate((found, np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(-1, MINIMA)))
        a, b, like = [], [], []
        for k in range(1, NEIGHBOURS + 1):
            first = max(old, k)
            if first >= len(ids):
                continue
            equal = (found[first:] == found[first - k : len(ids) - k]).sum(axis=1)
            good = np.flatnonzero((equal >= LEAST_EQUAL) & (region[first:] == region[first - k : len(ids) - k]))
            u, v = ids[first + good], ids[first + good - k]
            a.append(np.minimum(u, v))
            b.append(np.maximum(u, v))
            like.append(equal[good].astype(np.int32))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, like)], names=["a", "b", "equal"])
        region, ids, found = region[-NEIGHBOURS:], ids[-NEIGHBOURS:], found[-NEIGHBOURS:]


def _like_rows(batches):
    """The rows of two blocks of a region that have a like signature in another component of the other block."""
    for batch in batches:
        regions, ids = [], []
        for region, *sides in zip(batch.column("region").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            (a, ca, sa), (b, cb, sb) = (_side(s, "signature") for s in sides)
            sa, sb = (np.frombuffer(b"".join(s), dtype=">u4").reshape(-1, MINIMA).astype(np.uint32) for s in (sa, sb))
            equal = np.zeros((len(a), len(b)), dtype=np.uint8)
            for j in range(MINIMA):
                equal += sa[:, j, None] == sb[None, :, j]
            good = (equal >= LEAST_EQUAL) & (ca[:, None] != cb)
            found = np.union1d(a[good.any(axis=1)], b[good.any(axis=0)])
            regions.append(np.full(len(found), region, dtype=np.int64))
            ids.append(found)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions)), pa.array(np.concatenate(ids))], names=["region", "id"])


def _side(cell: pa.ListScalar, name: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The ids, components and bytes of a block."""
    return cell.values.field("id").to_numpy(), cell.values.field("component").to_numpy(), cell.values.field(name).to_pylist()


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each set of x and each of y."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    sides = []
    for sets in (x, y):
        column, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        used = np.isin(column, shared)
        column, row = np.searchsorted(shared, column[used]), row[used]
        order = np.argsort(column, kind="stable")
        sides.append((len(sets), row[order], column[order]))
    out = np.zeros((len(x), len(y)))
    for first in range(0, len(shared), COLUMNS):
        parts = []
        for n, row, column in sides:
            a, b = np.searchsorted(column, (first, first + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(shared) - first)), dtype=np.float32)
            part[row[a:b], column[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _linked_rows(batches):
    """Of the links between two blocks of a region, the ones that unite components."""
    for batch in batches:
        u, v = [], []
        for sides in zip(batch.column("x"), batch.column("y"), strict=True):
            (a, ca, sa), (b, cb, sb) = (_side(s, "shingles") for s in sides)
            sa, sb = ([np.frombuffer(s, dtype=np.uint64) for s in side] for side in (sa, sb))
            both = common(sa, sb)
            union = np.array([len(s) for s in sa])[:, None] + np.array([len(s) for s in sb]) - both
            above: dict[int, int] = {}

            def root(x: int, above: dict[int, int] = above) -> int:
                while (y := above.setdefault(x, x)) != x:
                    above[x] = x = above[y]
                return x

            for i, j in zip(*np.nonzero((100 * both >= SIMILARITY * union) & (ca[:, None] != cb)), strict=True):
                x, y = root(int(ca[i])), root(int(cb[j]))
                if x != y:
                    above[x] = y
                    u.append(int(a[i]))
                    v.append(int(b[j]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _sets_of(docs: DataFrame, rows: DataFrame, work: Workspace) -> DataFrame:
    """(id, shingles) of rows, in buckets of id; the join is the same at every size."""
    return work.bucketed(docs.join(rows.select("id").hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "sets", "id")


def _confirmed(pairs: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """The pairs (a, b) that are links, as (u, v). One set of each pair is moved, the other one's bucket stays."""
    joined = pairs.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    joined = joined.hint("merge").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    return work.table(joined.select("a", "b", "xa", "xb").mapInArrow(_confirm, "u long, v long"), "links")


def _prefix(depth: int) -> Column:
    return F.substring("key", 1, 4 * depth)


def _trees(rows: DataFrame) -> DataFrame:
    """Each row once for each tree, with the beginning of its signature in that tree's order."""
    rows = rows.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(TREES)])))
    start = F.col("tree") * (4 * MIN_DEPTH) + 1
    return rows.withColumn("key", F.substring(F.concat("signature", "signature"), start, F.lit(4 * KEY_DEPTH))).withColumn("region", F.xxhash64("tree", _prefix(MIN_DEPTH)))


def _crowded(rows: DataFrame) -> DataFrame:
    """The ids that share a region with another one."""
    placed = _trees(rows).select("region", "id")
    shared = placed.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1").select("region")
    return placed.join(shared, "region", "left_semi").select("id").distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, equal), a < b, of rows (a, sa, b, sb) with like signatures."""
    like = rows.filter("a <> b").mapInArrow(_alike, "a long, b long, equal int")
    return like.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "equal").distinct()


def _neighbour_pairs(rows: DataFrame) -> DataFrame:
    order = ["region", "key", "id"]
    sorted_ = _trees(rows).select(*order, "signature").repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select("region", "id", "signature").mapInArrow(_neighbours, "a long, b long, equal int").distinct()


def _open_regions(rows: DataFrame, work: Workspace) -> DataFrame:
    """The rows of regions that hold different components, once for each of them, with the region's number of rows."""
    placed = _trees(rows).select("region", "id", "n", "component", "signature")
    sizes = placed.groupBy("region").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"))
    return work.table(placed.join(sizes.filter("low <> high").select("region", "rows"), "region"), "open")


def _region_pairs(regions: DataFrame) -> DataFrame:
    """Pairs of one small region that are in different components."""
    small = regions.filter(F.col("rows") <= REGION_ROWS)
    x, y = small.alias("x"), small.alias("y")
    near = x.join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.component") < F.col("y.component")))
    return _pairs(near.select(F.col("x.id").alias("a"), F.col("x.signature").alias("sa"), F.col("y.id").alias("b"), F.col("y.signature").alias("sb")))


def _region_links(regions: DataFrame, placed: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """Links (u, v) that unite the components of each large region as far as its full sets do."""
    large = regions.filter(F.col("rows") > REGION_ROWS)
    wanted = open_blocks(large, ["region"], F.lit(1), BLOCK_ROWS, work, "id", "component", "signature").mapInArrow(_like_rows, "region long, id long").distinct()
    full = work.table(wanted.join(placed.select("id", "n", "component"), "id").hint("merge").join(sets, "id"), "wanted")
    links = open_blocks(full, ["region"], F.greatest("n", F.lit(LEAST_SHINGLES)), BLOCK_SHINGLES, work, "id", "component", "shingles")
    return work.table(links.mapInArrow(_linked_rows, "u long, v long"), "links")


def _across(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """The pairs whose rows are in different components."""
    if label is None:
        return pairs
    for c in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "equal")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Each row's pair with the most equal minima."""
    ends = pairs.select(F.col("a").alias("id"), "a", "b", "equal").union(pairs.select("b", "a", "b", "equal"))
    best = ends.groupBy("id").agg(F.max(F.struct("equal", -F.col("a"), -F.col("b"))).alias("best"))
    return best.select((-F.col("best.col2")).alias("a"), (-F.col("best.col3")).alias("b")).distinct()


def _linked(label: DataFrame | None, links: DataFrame, work: Workspace) -> DataFrame:
    if label is not None:
        links = links.union(label.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(links, work)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and link with nothing. Rows
    of equal text, repeated ones included, share a component. A null id never
    links; its component_id is null and it is kept. Other columns of docs,
    whatever their names, are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash-forest")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    marked = work.table(docs.mapInArrow(_signatures, "id long, n long, mark1 long, mark2 long, signature binary"), "signatures")
    usable = marked.filter("n > 0 AND id IS NOT NULL")
    classes = work.table(usable.groupBy("mark1", "mark2", "n").agg(F.min("id").alias("head")), "classes")
    rows = usable.join(classes.select("mark1", "mark2", "n", F.col("head").alias("id")), ["mark1", "mark2", "n", "id"], "left_semi")
    rows = rows.select("id", "n", "signature")
    rows = work.table(rows.join(_crowded(rows), "id", "left_semi"), "crowded")
    near = open_ = work.table(_neighbour_pairs(rows), "pairs")
    sets, label = _sets_of(docs, rows, work), None
    for k in range(FIRST_ROUNDS + 1):
        chosen = work.table(_likeliest(open_), "chosen") if k < FIRST_ROUNDS else open_.select("a", "b")
        label = _linked(label, _confirmed(chosen, sets, work), work)
        if k < FIRST_ROUNDS:
            open_ = work.table(_across(open_.join(chosen, ["a", "b"], "left_anti"), label), "pairs")
    placed = work.table(rows.join(label, F.col("id") == F.col("node"), "left").select("id", "n", "signature", F.coalesce("component", "id").alias("component")), "placed")
    regions = _open_regions(placed, work)
    open_ = work.table(_region_pairs(regions).join(near, ["a", "b"], "left_anti").select("a", "b"), "pairs")
    links = _confirmed(open_, sets, work).union(_region_links(regions, placed, sets, work))
    label = _linked(label, links, work)
    work.drop(sets)

    heads = classes.join(label, F.col("head") == F.col("node"), "left").select("mark1", "mark2", "n", F.coalesce("component", "head").alias("class_component"))
    out = marked.join(heads, ["mark1", "mark2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class_component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
