"""Alignment of two tokenizers over the same bytes.

Texts are cut into units at single spaces that a word follows. No token of
either vocabulary crosses such a place, which ``Encoder`` proves from the
vocabularies when it loads them, so a unit is encoded once and its ids are kept.
All texts of an Arrow batch, a *block*, are then aligned at once in NumPy:
cumulated token lengths are byte ends, their intersection are the cuts, and a
search among the cuts labels each token with its group.

Blocks are written. A block's distinct links, with how often it holds them, are
one row, so that the corpus-wide counts come from a shuffle of few rows in two
stages, the first one salted, and go back to the blocks the same way; texts are
encoded once only.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .tokens import _LONG_RUN, LONG_RUN, default_path, vocabulary

#: A pair's rows of the first counting stage, and of the way back, are dealt over so many keys.
SALTS = 16
#: Bytes of units that a worker keeps between blocks.
KEPT_BYTES = 32 << 20
#: Texts of a block are aligned in runs of about so many bytes.
RUN_BYTES = 1 << 20

_WHITE = rb"[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: A space where a unit starts: no space before it, and no white space and no end after it.
_UNIT = re.compile(rb"(?<! ) (?!$|" + _WHITE + rb")")
_DOUBTFUL = re.compile(rb" (?:$|" + _WHITE + rb")")


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def units_of(text: bytes) -> list[bytes]:
    """The units of space+text, each without its first space."""
    pieces = _UNIT.split(b" " + text) if _DOUBTFUL.search(text) or text[:1] == b" " else [b"", *text.split(b" ")]
    return pieces[1:] if not pieces[0] else [pieces[0][1:], *pieces[1:]]


class Encoder:
    """Ids of units by both vocabularies, kept from block to block."""

    def __init__(self, path: str, piece_path: str):
        import sentencepiece

        self._bpe = vocabulary(path)._bpe
        ranks = vocabulary(path)._ranks
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self._pieces.vocab_size()
        names = [self._pieces.id_to_piece(i) for i in range(n)]
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._pieces.is_byte(i) else b"" if self._pieces.is_control(i) or self._pieces.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.a_bytes, self.b_bytes))
        #: Whether no piece has a space after another character.
        self.cuttable = not any(" " in p.lstrip("▁").replace("▁", " ") for p in names)
        self.clear()

    def clear(self) -> None:
        self._number: dict[bytes, int] = {}
        self._kept = 0
        self.a, self.b, self.good = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.a_at = self.b_at = np.zeros(1, np.int64)

    def _a_ids(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not _LONG_RUN.search(text):
            return self._bpe.encode(text, disallowed_special=())
        out, at = [], 0
        for run in _LONG_RUN.finditer(text):  # the pattern looks ahead from each place of such a run, so it is cut out
            end = run.end() - (run.end() < len(text))
            out += self._bpe.encode(text[at : run.start()], disallowed_special=())
            out += self._bpe._encode_single_piece(text[run.start() : end])
            at = end
        return out + self._bpe.encode(text[at:], disallowed_special=())

    def _a_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units and how many each has. Units are encoded side by side, as they would be in a text."""
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        joined = "".join([" " + t for t in texts])
        if not _LONG_RUN.search(joined):
            ids = self._bpe.encode_to_numpy(joined, disallowed_special=()).astype(np.int64)
            ends, bounds = np.cumsum(self.a_size[ids]), np.cumsum([len(t.encode()) + 1 for t in texts])
            last = np.searchsorted(ends, bounds)
            if last[-1] == len(ends) - 1 and np.array_equal(ends[last], bounds):
                return ids, np.diff(last, prepend=-1)
        rows = [self._a_ids(" " + t) for t in texts]
        return np.array(list(itertools.chain.from_iterable(rows)), np.int64), np.array([len(r) for r in rows], np.int64)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """Each unit's place in a, b and good."""
        if self._kept > KEPT_BYTES:
            self.clear()
        known = self._number
        new = [u for u in dict.fromkeys(units) if u not in known]
        for at in range(0, len(new), 1 << 16):
            self._learn(new[at : at + (1 << 16)])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _learn(self, units: list[bytes]) -> None:
        """Encodes units; a unit that B changes is bad, and so is one that isn't UTF-8, whose replacement A can't give back."""
        texts = [u.decode("utf-8", "replace") for u in units]
        a, a_count = self._a_units(texts)
        rows = self._pieces.encode(texts, num_threads=1)
        b, b_count = np.array(list(itertools.chain.from_iterable(rows)), np.int64), np.array([len(r) for r in rows], np.int64)
        good = np.array([t.encode() == u for t, u in zip(texts, units, strict=True)], dtype=bool)
        if not good.all() or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join([b" " + u for u in units]):
            good &= np.array([b"".join([self.b_bytes[i] for i in r]) == b" " + u for r, u in zip(rows, units, strict=True)])
        first = len(self._number)
        self._number.update(zip(units, range(first, first + len(units)), strict=True))
        self._kept += sum(map(len, units)) + 160 * len(units)
        self.a, self.b, self.good = np.concatenate((self.a, a)), np.concatenate((self.b, b)), np.concatenate((self.good, good))
        self.a_at, self.b_at = (np.concatenate((at, at[-1] + np.cumsum(count))) for at, count in ((self.a_at, a_count), (self.b_at, b_count)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, piece_path: str) -> Encoder:
    """Loaded once in each worker."""
    return Encoder(path, piece_path)


def _gather(flat: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[i]:at[i + 1]] of all numbers i, one after another, and their lengths."""
    size = at[numbers + 1] - at[numbers]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[numbers] - ends + size, size)], size


@functools.lru_cache(maxsize=4)
def _written(n: int, inner: str, last: str) -> list[str]:
    """Decimal numbers below n with what follows them inside a group, then the same at its end."""
    return [f"{i}{inner}" for i in range(n)] + [f"{i}{last}" for i in range(n)]


def align(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts, the group of each token of a and b, and the places in a and b of all links.

    a_ends and b_ends are byte ends and end alike. Tokens without bytes share
    an end, so a cut may hold several tokens of a side, which all link.
    """
    cuts = np.intersect1d(*(x[np.append(x[1:] != x[:-1], True)] if len(x) else x for x in (a_ends, b_ends)), assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    a_last, b_last = np.flatnonzero(a_ends == cuts[a_group]), np.flatnonzero(b_ends == cuts[b_group])
    b_count = np.bincount(b_group[b_last], minlength=len(cuts))
    b_first = np.cumsum(b_count) - b_count
    times = b_count[a_group[a_last]]
    ends = np.cumsum(times)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
    return cuts, a_group, b_group, np.repeat(a_last, times), b_last[np.repeat(b_first[a_group[a_last]], times) + inside]


def _digests(a, b, a_group, b_group, a_to, b_to, n_a: int, n_b: int) -> list[str]:
    """SHA-256 of each text's groups as a1,a2|b1;...; a_to and b_to are the texts' last tokens, exclusive.

    A token's place among all tokens, groups in order and a before b, follows
    from its own number and the other side's tokens before it.
    """
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (a_group, b_group))
    words = np.empty(len(a) + len(b), dtype=np.int64)
    words[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + last_a * n_a
    words[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = b + last_b * n_b + 2 * n_a
    texts = _written(n_a, ",", "|") + _written(n_b, ",", ";")
    out, at = [], 0
    for to in (a_to + b_to).tolist():
        out.append(hashlib.sha256("".join(map(texts.__getitem__, words[at:to].tolist()))[:-1].encode()).hexdigest() if to > at else "")
        at = to
    return out


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values, type=kind))


def _run(texts: list[bytes | None], e: Encoder):
    """(n_a, n_b, n_groups, n_links, digests, codes of the links) of some texts of a block."""
    rows = [[t] if t and not e.cuttable else units_of(t) if t else [] for t in texts]
    n_units = np.array([len(r) for r in rows], dtype=np.int64)
    numbers = e.numbers(list(itertools.chain.from_iterable(rows)))
    n = len(rows)
    del rows
    text_of = np.repeat(np.arange(n), n_units)
    if not e.good[numbers].all():
        keep = ~np.isin(text_of, text_of[~e.good[numbers]])
        numbers, text_of = numbers[keep], text_of[keep]
    (a, a_size), (b, b_size) = _gather(e.a, e.a_at, numbers), _gather(e.b, e.b_at, numbers)
    n_a, n_b = (np.bincount(text_of, size, n).astype(np.int64) for size in (a_size, b_size))
    cuts, a_group, b_group, x, y = align(a, b, np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b]))
    digests = _digests(a, b, a_group, b_group, np.cumsum(n_a), np.cumsum(n_b), len(e.a_size), len(e.b_size))
    text_of_a = np.repeat(np.arange(n), n_a)
    first = np.append(True, a_group[1:] != a_group[:-1]) if len(a_group) else np.empty(0, bool)
    n_groups, n_links = np.bincount(text_of_a[first], minlength=n), np.bincount(text_of_a[x], minlength=n)
    return n_a, n_b, n_groups, n_links, digests, (a[x] << 32) | b[y]


def _block(texts: list[bytes | None], e: Encoder):
    """(n_a, n_b, n_groups, digests, n_links, links, codes, counts) of a block's texts; links are places in codes."""
    done, at, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= RUN_BYTES or k == len(texts) - 1:
            done.append(_run(texts[at : k + 1], e))
            at, size = k + 1, 0
    n_a, n_b, n_groups, n_links = (np.concatenate([d[i] for d in done]) for i in range(4))
    codes, links, counts = np.unique(np.concatenate([d[5] for d in done]), return_inverse=True, return_counts=True)
    return n_a, n_b, n_groups, [x for d in done for x in d[4]], n_links, links.astype(np.int32), codes, counts


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _encode(path: str, piece_path: str):
    def run(batches):
        e = encoder(path, piece_path)
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column("text")]
            n_a, n_b, n_groups, digests, n_links, links, codes, counts = _block(texts, e)
            n, part = batch.num_rows, (task << 32) | k
            long = pa.int64()
            docs = [pa.array(np.full(n, part)), batch.column("id"), *[pa.array(c, type=long) for c in (n_a, n_b, n_groups, n_links)], pa.array(digests, pa.string()), _lists(links, np.cumsum(n_links), pa.int32()), pa.nulls(n, pa.list_(long)), pa.nulls(n, pa.list_(long))]
            names = ["part", "id", *_COUNTS, "groups_sha256", "links", "codes", "counts"]
            yield pa.RecordBatch.from_arrays(docs, names=names)
            own = [pa.array([part]), pa.nulls(1, batch.column("id").type), *[pa.nulls(1, long)] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), *[_lists(c, np.array([len(c)]), long) for c in (codes, counts)]]
            yield pa.RecordBatch.from_arrays(own, names=names)

    return run


def _looked_up(docs: pa.Table, found: pa.Table) -> pa.Table:
    """A block's texts with the sums over their links; found has the block's codes by place."""
    n = docs.num_rows
    place = found.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
    lists = docs.column("links").combine_chunks()
    links, sizes = lists.flatten().to_numpy(), docs.column("n_links").to_numpy()
    row = np.repeat(np.arange(n), sizes)
    sums = []
    for values in (best, count):
        total = np.zeros(n, np.int64)
        np.add.at(total, row, values[links])
        sums.append(pa.array(total))
    return pa.Table.from_arrays([docs.column(c) for c in ("id", *_COUNTS)] + sums + [docs.column("groups_sha256")], names=["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, piece_path: str | None = None, pairs: bool = False):
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE over space+text, B a piece model over text. With
    ``pairs`` the corpus-wide counts (a, b, count, best) come along as a second
    DataFrame.

    A null or empty text, and one that either vocabulary doesn't give back byte
    for byte (invalid UTF-8, a literal U+2581, what the piece model normalises),
    has zeros and an empty digest and counts for nothing. Strings of special
    tokens are plain text. Texts of any length are read whole; a text longer
    than an Arrow batch's bound is a block of its own. Repeated rows count each
    time, ties of a B id's highest count are all best, null ids are ids like
    others. Columns that are not named, whatever their names, are not read; an
    empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "alignment")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    encoded = rows.mapInArrow(_encode(path or default_path(), piece_path or default_piece_path()), f"part long, id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, links array<int>, codes array<long>, counts array<long>")
    encoded = work.table(encoded, "blocks")

    held = encoded.filter("codes IS NOT NULL").select("part", F.posexplode(F.arrays_zip("codes", "counts")).alias("place", "x"))
    held = held.select("part", "place", F.col("x.codes").alias("code"), F.col("x.counts").alias("n"), F.pmod(F.xxhash64("part"), F.lit(SALTS)).alias("salt"))
    counted = held.groupBy("code", "salt").agg(F.sum("n").alias("n")).groupBy("code").agg(F.sum("n").alias("count"))
    counted = work.table(counted.withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)), "counts")
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))
    rated = counted.join(highest, "b").select("code", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    salted = rated.select("code", "count", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = held.drop("n").join(salted, ["code", "salt"]).select(F.col("part").alias("block"), F.col("place").cast("long").alias("place"), "count", "best")

    texts = encoded.filter("codes IS NULL").select("part", "id", *_COUNTS, "links", "groups_sha256")
    schema = f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups_sha256 string"
    out = texts.groupBy("part").cogroup(found.groupBy("block")).applyInArrow(_looked_up, schema).withColumnRenamed("id", id_col)
    if not pairs:
        return out
    return out, rated.select(F.shiftright("code", 32).alias("a"), "b", "count", "best")
