"""Hierarchical multi-length packing of documents into training sequences.

A document's ids, closed by an end id, are cut into whole windows of the
longest context and a remainder. Remainders are routed to the smallest context
size (tier) that holds them. Each tier is packed from the longest down: a
sequence starts with one of the tier's remainders and its gap is filled with
the best fitting remainders of shorter tiers, the last of them cut to fit.
Every sequence but the last few of a task is full, and a task's last ids are
laid out over the tiers' sizes too. All of that happens inside the task that
has read the documents: nothing is shuffled, and a task holds ``POOL`` ids of
remainders. A lost task runs again over the same rows and gives the same
sequences, so docs should come straight from a table.

Sequences of one tier are dealt into step groups of equal numbers of ids, so
many groups at a time that their work can be balanced too: attention inside a
sequence costs the square of each piece, and the dearest sequences go first, to
the group that costs least so far. A task's last groups share what is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, vocabulary

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids of remainders that are packed at a time.
POOL = 1 << 20
#: Ids in a step group.
STEP = 1 << 16
#: Step groups of a tier that are balanced against each other.
LANES = 4

SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs one task's documents. Items are (length, number, doc, start, ids); numbers make them unique."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step: int = STEP):
        self.tiers, self.step, self.base = tiers, step, task << 33
        self.pools: dict[int, list] = {t: [] for t in tiers}
        self.sums = dict.fromkeys(tiers, 0)
        self.items = self.sequences = self.steps = 0
        self.waiting: dict[int, list[tuple[int, list[tuple]]]] = {t: [] for t in tiers}
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        for at in range(0, n - top + 1, top):
            self._write([(top, 0, (doc, n), at, ids[at : at + top])], top)
        if rest := n % top:
            self._put((doc, n), n - rest, ids[n - rest :])
            if sum(self.sums.values()) >= POOL:
                self._pack(False)

    def finish(self) -> None:
        self._pack(True)
        for tier in self.tiers:
            self._deal(tier)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def _put(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.items += 1
        tier = self._tier(len(ids))
        self.sums[tier] += len(ids)
        insort(self.pools[tier], (len(ids), self.items, doc, start, ids), key=lambda x: x[:2])

    def _fitting(self, gap: int, below: int) -> tuple | None:
        """The longest item of at most gap ids, from the tiers up to one."""
        for t in reversed(self.tiers[: self.tiers.index(below) + 1]):
            if k := bisect_right(self.pools[t], gap, key=lambda x: x[0]):
                return self._pop(t, k - 1)
        return None

    def _pop(self, tier: int, k: int) -> tuple:
        item = self.pools[tier].pop(k)
        self.sums[tier] -= item[0]
        return item

    def _any(self, below: int) -> tuple | None:
        """An item to cut: the shortest there is, else the longest of the tier itself."""
        for t in self.tiers[: self.tiers.index(below) + 1]:
            if self.pools[t]:
                return self._pop(t, 0)
        return None

    def _pack(self, last: bool) -> None:
        for tier in reversed(self.tiers):
            while self.pools[tier] and sum(n for t, n in self.sums.items() if t <= tier) >= tier:
                item = self._pop(tier, -1)
                parts, gap = [item], tier - item[0]
                while gap and (item := self._fitting(gap, tier) or self._any(tier)):
                    if item[0] > gap:
                        _, number, doc, start, ids = item
                        self._put(doc, start + gap, ids[gap:])
                        item = (gap, number, doc, start, ids[:gap])
                    parts.append(item)
                    gap -= item[0]
                self._write(parts, tier)
        if not last:
            return
        left = [self._pop(t, -1) for t, p in self.pools.items() for _ in range(len(p))]
        total = sum(x[0] for x in left)
        for size in [t for t in reversed(self.tiers) for _ in range(total // t)]:
            if total >= size:
                self._lay(left, size, size)
                total -= size
        if total:
            self._lay(left, total, self.tiers[-1])

    def _lay(self, left: list, size: int, tier: int) -> None:
        """Cuts the next size ids off what is left as one sequence."""
        parts = []
        while size:
            n, number, doc, start, ids = left.pop()
            if n > size:
                left.append((n - size, number, doc, start + size, ids[size:]))
                n, ids = size, ids[:size]
            parts.append((n, number, doc, start, ids))
            size -= n
        self._write(parts, tier)

    def _write(self, parts: list[tuple], tier: int) -> None:
        offset, cost, rows = 0, 0, []
        for n, _, (doc, size), start, ids in parts:
            rows.append((doc, start, n, zlib.crc32(ids.astype("<u4").tobytes()), size, self.base + self.sequences, offset, tier))
            offset, cost = offset + n, cost + n * n
        self.sequences += 1
        self.waiting[tier].append((cost, rows))
        if len(self.waiting[tier]) * tier >= LANES * self.step:
            self._deal(tier)

    def _deal(self, tier: int) -> None:
        """Puts the waiting sequences of a tier into step groups of like size and cost."""
        sequences, self.waiting[tier] = self.waiting[tier], []
        groups = -(-len(sequences) * tier // self.step)
        most = -(-len(sequences) // max(groups, 1))
        least = [(0, 0, g) for g in range(groups)]
        for cost, rows in sorted(sequences, key=lambda x: -x[0]):
            total, n, g = heappop(least)
            self.rows += [(*row, self.base + self.steps + g) for row in rows]
            if n + 1 < most:
                heappush(least, (total + cost, n + 1, g))
        self.steps += groups


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pack(path: str, tiers: tuple[int, ...], step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, packer, schema = vocabulary(path), Packer(TaskContext.get().partitionId(), tiers, step), None
        for batch in batches:
            names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            schema = pa.schema([pa.field("doc_id", batch.schema.field("doc_id").type), *[pa.field(n, pa.int64()) for n in names], pa.field("tier", pa.int32()), pa.field("step_group", pa.int64())])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = v.ids(text.as_buffer().to_pybytes()) if text.is_valid else np.empty(0, dtype=np.uint32)
                packer.add(doc, np.append(ids, np.uint32(END_ID)).astype(np.uint32))
                if len(packer.rows) >= 10_000:
                    yield _batch(packer.take(), schema)
        packer.finish()
        if packer.rows:
            yield _batch(packer.take(), schema)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text is the end id alone. Each id lies in exactly one
    piece. Texts are read whole, however long; a long one fills sequences of
    its own. Repeated rows are documents of their own, a null id is an id like
    others, and equal lengths are packed in the order of arrival. An empty
    table gives no sequences. Other columns, whatever their names, are not read.
    """
    if any(b != 2 * a for a, b in zip(tiers, tiers[1:], strict=False)) or step % tiers[-1]:
        raise ValueError("each tier is twice the one before, and a step group holds whole sequences")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pack(path or default_path(), tuple(tiers), step), SCHEMA.format(kind)).withColumnRenamed("doc_id", id_col)
