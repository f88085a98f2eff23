"""Removal of repeated passages by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of one text; it recurs if its word
sequence also starts anywhere else, in the same text or another one.

1. Anchors. Of each window, the ``ANCHOR``-word run with the least hash is its
   anchor; neighbouring windows share anchors, so about one word in fourteen
   starts one. Equal windows have equal anchors: an anchor that occurs once
   belongs to no recurring window, and a text without an anchor that recurs
   holds none. Such texts are done, and so are texts with the same words as
   another one: all of their windows recur. One of these stays as their head.
2. Confirmation. Of the other texts, the windows with recurring anchors are
   counted, a head's twice; those counted twice or more recur. Of each one
   place is kept. Runs of such places that follow each other are the recurring
   passages, and each recurring window lies in exactly one of them.
3. Automata. Texts are dealt over shards of about ``SHARD_BYTES`` bytes, and a
   passage goes to the shards where one of its windows occurs. In a
   shard, the first ``PATTERN`` words of every ``GRID`` words of a passage go
   into an automaton: any window holds one of these patterns whole. All of the
   shard's texts stream through it, each hit is extended while passage and text
   agree, and a run of ``WINDOW`` words or more is removed.

Windows, and texts with the same words, are told apart by two independent
64-bit hashes of their words: of 10**13 windows, two different ones agree in
both with a probability under 10**-12.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .words import Block, blocks, full_runs, mix, run_hash, span_hash

WINDOW = 35
ANCHOR = 8
GRID = 24
PATTERN = 12
SHARD_BYTES = 4 << 20
OUT = ("n_words", "removed", "kept_sha256")


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the words, for the second hash of what they make up."""
    return mix(hashes ^ np.uint64(0xA0761D6478BD642F))


def _sliding(x: np.ndarray, n: int, pick, pad) -> np.ndarray:
    """pick over x[i:i+n] for each i; beyond the end x counts as pad."""
    x, size = np.concatenate((x, np.full(n, pad, dtype=x.dtype))), len(x)
    width = 1
    while 2 * width <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:size], x[n - width : n - width + size])


def _window_anchors(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions where windows start, the anchor of each, and the hash of the anchor run at each word."""
    runs = run_hash(hashes, ANCHOR)
    at, _ = full_runs(bounds, window)
    if not len(at):
        return at, np.empty(0, dtype=np.uint64), runs
    least = _sliding(runs, window - ANCHOR + 1, np.minimum, np.uint64(2**64 - 1))
    return at, least[at], runs


def _anchor_lists(window: int):
    def run(batches):
        for batch in batches:
            out = [[]] * batch.num_rows
            content, content2 = np.zeros((2, batch.num_rows), dtype=np.int64)
            for block in blocks(batch.column("text")):
                starts, ends, bounds = block.words()
                hashes = block.hashes(starts, ends)
                at, least, runs = _window_anchors(hashes, bounds, window)
                if not len(at):
                    continue
                for x, y in ((content, hashes), (content2, _second(hashes))):
                    x[block.first : block.first + len(block)] = span_hash(y, bounds[:-1], bounds[1:]).view(np.int64)
                # a run is an anchor if it is the least of some window that holds it
                by_start = np.zeros(len(runs), dtype=np.uint64)
                by_start[at] = least
                n = window - ANCHOR + 1
                most = _sliding(by_start[::-1], n, np.maximum, np.uint64(0))[::-1]
                places = np.flatnonzero(most == runs)
                cut = np.searchsorted(places, bounds)
                anchors = runs[places].view(np.int64)
                for k in range(len(block)):
                    if cut[k + 1] > cut[k]:
                        out[block.first + k] = anchors[cut[k] : cut[k + 1]]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(content), pa.array(content2), pa.array(out, pa.list_(pa.int64()))], names=["key", "content", "content2", "anchors"])

    return run


def _kept(words: list[bytes], removed: np.ndarray | None, digest: bool):
    if removed is not None:
        words = [w for w, gone in zip(words, removed, strict=True) if not gone]
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace")


def _spans(removed: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], removed.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _sorted_out(digest: bool):
    """Texts without recurring anchors and copies are done; the others, and heads, keep their text."""

    def run(batches):
        for batch in batches:
            n, kept, text = [], [], []
            for t, weight in zip(batch.column("text"), batch.column("weight").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = raw.split()
                n.append(len(words))
                kept.append(None if weight == 1 else _kept([] if weight in (0, 2) else words, None, digest))
                text.append(raw if weight in (1, 2) else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "key", "weight", "anchors")] + [pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(text, pa.binary())], names=["row", "key", "weight", "anchors", "n_words", "kept", "text"])

    return run


def _windows(window: int):
    """For each text, the windows whose anchors recur: word positions and both hashes."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            places, hashes, hashes2 = [[]] * n, [[]] * n, [[]] * n
            lists = batch.column("anchors")
            for block in blocks(batch.column("text")):
                starts, ends, bounds = block.words()
                words = block.hashes(starts, ends)
                at, least, _ = _window_anchors(words, bounds, window)
                if not len(at):
                    continue
                whole, whole2 = (run_hash(x, window)[at].view(np.int64) for x in (words, _second(words)))
                cut = np.searchsorted(at, bounds)
                for k in range(len(block)):
                    a, b = cut[k], cut[k + 1]
                    good = np.flatnonzero(np.isin(least[a:b].view(np.int64), lists[block.first + k].values.to_numpy())) if b > a else ()
                    if len(good):
                        places[block.first + k] = (at[a:b][good] - bounds[k]).astype(np.int32)
                        hashes[block.first + k] = whole[a:b][good]
                        hashes2[block.first + k] = whole2[a:b][good]
            columns = [pa.array(x, pa.list_(t)) for x, t in ((places, pa.int32()), (hashes, pa.int64()), (hashes2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("weight"), *columns], names=["key", "weight", "place", "hash", "hash2"])

    return run


def _passages(window: int):
    """The words of a text's passages, each with its run number: first place less rank of that place."""

    def run(batches):
        for batch in batches:
            keys, runs, texts = [], [], []
            for key, text, found in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                own, rank = np.unique(found.values.to_numpy()), 1
                for part in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    keys.append(key)
                    runs.append(int(part[0]) - rank)
                    texts.append(b" ".join(words[part[0] : part[-1] + window]))
                    rank += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(runs, pa.int32()), pa.array(texts, pa.binary())], names=["key", "run", "text"])

    return run


class Shard:
    """An automaton over one shard's passages."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.passages: list[np.ndarray] = []
        self.patterns: dict[str, list[tuple[int, int]]] = {}
        self.automaton = None

    def add(self, text: bytes) -> None:
        words = text.split()
        block = next(blocks(pa.array([text], pa.binary())))
        starts, ends, _ = block.words()
        for p in range(0, len(words) - PATTERN + 1, GRID):
            pattern = b" " + b" ".join(words[p : p + PATTERN]) + b" "
            self.patterns.setdefault(pattern.decode("latin-1"), []).append((len(self.passages), p))
        self.passages.append(block.hashes(starts, ends))

    def removed(self, text: bytes, words: list[bytes]) -> np.ndarray:
        """For each word, whether a recurring window covers it."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for pattern, places in self.patterns.items():
                self.automaton.add_word(pattern, places)
            self.patterns = {}
            self.automaton.make_automaton()
        out = np.zeros(len(words), dtype=bool)
        if not len(self.automaton) or len(words) < self.window:
            return out
        block: Block = next(blocks(pa.array([text], pa.binary())))
        starts, ends, _ = block.words()
        hashes = block.hashes(starts, ends)
        stop = np.cumsum(ends - starts + 1)  # where the space after each word stands in the normalised text
        done: dict[tuple[int, int], int] = {}
        for end, places in self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            at = int(np.searchsorted(stop, end)) - PATTERN + 1
            for number, p in places:
                if done.get((number, at - p), -1) >= p + PATTERN:
                    continue
                passage = self.passages[number]
                back, ahead = min(at, p), min(len(hashes) - at, len(passage) - p)
                unequal = np.flatnonzero(hashes[at - back : at][::-1] != passage[p - back : p][::-1])
                first = at - (int(unequal[0]) if len(unequal) else back)
                unequal = np.flatnonzero(hashes[at : at + ahead] != passage[p : p + ahead])
                last = at + (int(unequal[0]) if len(unequal) else ahead)
                done[number, at - p] = last - at + p
                if last - first >= self.window:
                    out[first:last] = True
        return out


def _locate(window: int, digest: bool):
    def run(batches):
        shard, now = Shard(window), None
        for batch in batches:
            row, n, spans, kept = [], [], [], []
            numbers, texts = batch.column("shard").to_pylist(), batch.column("text")
            docs = batch.column("is_doc").to_pylist()
            for i, number in enumerate(numbers):
                if number != now:
                    shard, now = Shard(window), number
                text = texts[i].as_buffer().to_pybytes()
                if not docs[i]:
                    shard.add(text)
                    continue
                words = text.split()
                gone = shard.removed(text, words)
                row.append(i)
                n.append(len(words))
                spans.append(_spans(gone))
                kept.append(_kept(words, gone, digest))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.string())], names=["row", "n_words", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """All rows of docs with n_words, removed (spans of words) and what is left of the text.

    The text column is replaced by the kept words, joined by one space; with
    digest, it goes and kept_sha256 has their SHA-256 instead. A null text has
    no words and stays null. Texts shorter than a window lose nothing, longer
    ones are read whole, whatever their length. A row that occurs twice is two
    places, so that its windows recur; of equal texts none is preferred. Other
    columns, null ids among them, go through unread, but those named n_words,
    removed or kept_sha256, in any case, are replaced. An empty table gives an
    empty one.
    """
    work = Workspace(docs.sparkSession, "phrase-automata")
    others = [c for c in docs.columns if c != text_col and c.lower() not in OUT]
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("no_text"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("of")] if others else []))
    docs = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    docs = docs.withColumn("key", F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"}), "text"))
    kind = docs.schema["row"].dataType.simpleString()

    anchors = work.table(docs.select("key", "text").mapInArrow(_anchor_lists(window), "key long, content long, content2 long, anchors array<long>").filter(F.size("anchors") > 0), "anchors")
    content = ["content", "content2"]
    copies = anchors.groupBy(*content).agg(F.count("*").alias("n"), F.min("key").alias("head")).filter("n > 1").select(*content, "head")
    weight = F.when(F.col("head").isNull(), 1).when(F.col("head") == F.col("key"), 2).otherwise(0)
    marked = work.table(anchors.join(copies, content, "left").select("key", weight.alias("weight"), F.when(weight > 0, F.col("anchors")).alias("anchors")), "marked")
    work.drop(anchors)
    each = marked.select("key", "weight", F.explode("anchors").alias("anchor"))
    # a table of its own, so that Spark can split the places of a frequent anchor when they are joined
    recurring = work.table(each.groupBy("anchor").agg(F.sum("weight").alias("n")).filter("n > 1").select("anchor"), "recurring")
    hits = each.join(recurring, "anchor").groupBy("key").agg(F.max("weight").alias("weight"), F.collect_set("anchor").alias("anchors"))
    hits = work.table(hits.union(marked.filter("weight = 0").select("key", "weight", "anchors").distinct()), "hits")
    work.drop(marked, recurring)
    sorted_ = docs.join(hits, "key", "left").select("row", "key", "weight", "text", "anchors")
    sorted_ = work.table(sorted_.mapInArrow(_sorted_out(digest), f"row {kind}, key long, weight int, anchors array<long>, n_words long, kept string, text binary"), "sorted")
    work.drop(hits)
    open_ = sorted_.filter("weight = 1")
    shards = 1 + int((open_.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))

    windows = sorted_.filter("weight > 0").select("key", "weight", "text", "anchors").mapInArrow(_windows(window), "key long, weight int, place array<int>, hash array<long>, hash2 array<long>")
    each = windows.select("key", "weight", F.explode(F.arrays_zip("place", "hash", "hash2")).alias("w")).select("key", "weight", "w.*")
    hashes = ["hash", "hash2"]
    found = each.groupBy(*hashes).agg(F.sum("weight").alias("n"), F.min(F.struct("key", "place")).alias("at")).filter("n > 1")
    found = work.table(found.select(*hashes, "at.key", "at.place"), "windows")
    places = found.groupBy("key").agg(F.collect_set("place").alias("places"))
    passages = sorted_.filter("weight > 0").select("key", "text").dropDuplicates(["key"]).join(places, "key").select("key", "text", "places")
    passages = passages.mapInArrow(_passages(window), "key long, run int, text binary")
    # neighbouring places have the same run number; a text's places are its own words, so a window over them is bounded by it
    rank = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    runs = work.table(found.select(*hashes, "key", (F.col("place") - rank).cast("int").alias("run")), "runs")
    routes = each.filter("weight = 1").select(*hashes, shard.alias("shard")).join(runs, hashes).select("key", "run", "shard").distinct()

    patterns = passages.join(routes, ["key", "run"])
    texts = open_.select(shard.alias("shard"), F.lit(True).alias("is_doc"), "row", "text")
    both = patterns.select("shard", F.lit(False).alias("is_doc"), F.lit(None).cast(kind).alias("row"), "text").union(texts)
    located = both.repartition("shard").sortWithinPartitions("shard", "is_doc").mapInArrow(_locate(window, digest), f"row {kind}, n_words long, removed array<struct<first: long, end: long>>, kept string")
    spans = "array<struct<first: long, end: long>>"
    whole = F.when(F.col("weight").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))).otherwise(F.array().cast(spans))
    done = sorted_.filter("weight IS NULL OR weight <> 1").select("row", "n_words", whole.alias("removed"), "kept")
    out = done.union(located)
    cols = [F.col(f"row.of.`{c}`").alias(c) for c in others]
    if digest:
        return out.select(*cols, "n_words", "removed", F.col("kept").alias("kept_sha256"))
    return out.select(*cols, F.when(~F.col("row.no_text"), F.col("kept")).alias(text_col), "n_words", "removed")


def removed_words(spans: str = "removed"):
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
