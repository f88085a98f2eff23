"""A prefix trie of conversations by distributed MSD radix partitioning.

Turns are dictionary-encoded, so that a conversation is an array of ids, and
equal conversations are counted as one sequence. Starting from the root, the
sequences of a bucket, which share a node, are partitioned by their next id. A
part that one task can finish is left for later; a larger one becomes a bucket
of the next round, after its whole common prefix has been skipped. Multikey
quicksort then finishes all small parts, where the equal part of each
three-way split is a node and is split on by the next id. What a subtree adds up
to goes from the finished parts through the rounds' buckets back to the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

#: A part of several sequences with more ids than this left is partitioned further.
LOCAL_TURNS = 1 << 15
#: Conversations of a sequence are listed in chunks of at most 2**this ids.
CHUNK_BITS = 12

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded(turns: DataFrame, work: Workspace, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with an id t and the text's bytes b of each turn, in order; the dictionary's key is a SHA-256 of role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("b"))
    rows = work.table(rows, "turns")
    numbered = work.table(rows.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("t")), "dictionary")
    placed = rows.join(numbered, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "t", "b"))).alias("turns"))
    return placed.select("conv_id", F.transform("turns", lambda x: F.struct(x["t"].alias("t"), x["b"].alias("b"))).alias("turns"))


def with_shared_openings(convs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """convs (conv_id, turns) whose first h turns are those of the conversation at the multiple of ``every`` below; h is crc32 of the id, modulo ``most``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    rows = convs.withColumn("h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % every)
    base = convs.select(F.col("conv_id").alias("_base"), F.col("turns").alias("opening"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    opening = F.when(F.col("opening").isNotNull(), F.slice("opening", F.lit(1), F.col("h")))
    return rows.join(base, "_base", "left").select("conv_id", F.when(opening.isNull(), own).otherwise(F.concat(opening, own)).alias("turns"))


def _chunks_to_sequences(batches):
    """Consecutive rows of one sequence, in the order of their conversations, as one row with the digest of all."""
    names = ["t", "b", "conv", "n", "ends"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    now, done = None, []
    for batch in batches:
        for t, b, low, n, ids in zip(*(batch.column(c).to_pylist() for c in ("t", "b", "low", "n", "ids")), strict=True):
            if now is None or now[0] != t:
                if now is not None:
                    done.append((*now[:4], now[4].hexdigest()))
                now = [t, b, low, n, hashlib.sha256(ids.encode())]
            else:
                now[2], now[3] = min(now[2], low), now[3] + n
                now[4].update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*now[:4], now[4].hexdigest()), kinds, strict=True)], names=names)


def sequences(convs: DataFrame) -> DataFrame:
    """(t, b, conv, n, ends) of each distinct sequence: its ids and sizes, lowest conversation, number of conversations and their digest.

    Conversations of a sequence are joined in chunks before they come
    together, and the digest is taken chunk after chunk, so no task holds them
    all.
    """
    rows = convs.select("conv_id", F.transform("turns", lambda x: x["t"]).alias("t"), F.transform("turns", lambda x: x["b"]).alias("b"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = rows.groupBy("t", "b", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), ids.alias("ids"))
    chunks = chunks.repartition("t").sortWithinPartitions("t", "chunk").select("t", "b", "low", "n", "ids")
    return chunks.mapInArrow(_chunks_to_sequences, "t array<long>, b array<long>, conv long, n long, ends string")


def grow(rows: list[tuple], depth: int, up: int) -> list[list]:
    """All nodes (conv, depth, parent conv, n, children, leaves, saved, ends) of sequences (t, b, conv, n, ends) that share their first ``depth`` ids; the top is first.

    Multikey quicksort with a stack of its own; nodes are listed before their
    children, so one backward walk adds up subtrees.
    """
    nodes: list[list] = []
    above: list[int] = []
    stack = [(rows, depth, -1)]
    while stack:
        part, d, parent = stack.pop()
        conv, n = min(r[2] for r in part), sum(r[3] for r in part)
        ends = next((r[4] for r in part if len(r[0]) == d), NO_ENDS)
        me = len(nodes)
        nodes.append([conv, d, up if parent < 0 else nodes[parent][0], n, 0, 0, (n - 1) * part[0][1][d - 1], ends])
        above.append(parent)
        todo = [[r for r in part if len(r[0]) > d]]
        while todo:
            left = todo.pop()
            if not left:
                continue
            pivot = left[len(left) // 2][0][d]
            equal = [r for r in left if r[0][d] == pivot]
            if len(equal) < len(left):
                todo += [[r for r in left if r[0][d] < pivot], [r for r in left if r[0][d] > pivot]]
            nodes[me][4] += 1
            stack.append((equal, d + 1, me))
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if not node[4]:
            node[5] = 1
        if above[k] >= 0:
            nodes[above[k]][5] += node[5]
            nodes[above[k]][6] += node[6]
    return nodes


_PART = ("round", "bucket", "digit")


def _finish(batches):
    """Nodes of all parts; a part's rows follow each other. A part's top bears its round and bucket."""
    kinds = [*[pa.int64()] * 7, pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "round", "bucket"]

    def out(part, rows, depth, up):
        nodes = grow(rows, depth + 1, up)
        return [(*node, *(part[:2] if not k else (None, None))) for k, node in enumerate(nodes)]

    part, rows, depth, up, done = None, [], 0, 0, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_PART, "depth", "up", "t", "b", "conv", "n", "ends")]
        for *now, d, u, t, b, conv, n, ends in zip(*columns, strict=True):
            if now != part:
                if rows:
                    done += out(part, rows, depth, up)
                part, rows, depth, up = now, [], d, u
            rows.append((t, b, conv, n, ends))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out(part, rows, depth, up), strict=True), kinds, strict=True)], names=names)


def _common(lo: Column, hi: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(lo), F.size(hi))
    unlike = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(lo, i) != F.element_at(hi, i))
    return F.coalesce(F.element_at(F.when(F.size(unlike) > 0, unlike), 1) - 1, n)


def prefix_trie(convs: DataFrame, local_turns: int = LOCAL_TURNS, work: Workspace | None = None) -> DataFrame:
    """The nodes of the trie of convs (conv_id, turns of (t, b)): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    (conv_id, depth) names a node: the lowest conversation that starts with it.
    Ids of conversations are unique and not null; a conversation without turns
    (an empty array) ends at the root. Without conversations there are no
    nodes. A conversation is one row, however long it is.
    """
    spark = convs.sparkSession
    work = work or Workspace(spark, "trie")
    rows = work.table(sequences(convs).select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("up"), "t", "b", "conv", "n", "ends"), "sequences")
    root = rows.agg(F.min("conv").alias("conv"), F.sum("n").alias("n")).filter("conv IS NOT NULL")
    rows = rows.withColumn("up", F.lit((root.first() or {"conv": None})["conv"]).cast("long"))
    nowhere = F.lit(None).cast("long")
    levels = [work.table(root.select(F.lit(0).cast("long").alias("bucket"), nowhere.alias("above"), F.lit(0).alias("first"), F.lit(0).alias("depth"), "conv", nowhere.alias("up"), "n", F.array(F.lit(0).cast("long")).alias("sizes")), "root")]
    dealt: list[DataFrame] = []
    while True:
        rows = rows.withColumn("digit", F.when(F.size("t") > F.col("depth"), F.get("t", F.col("depth"))))
        parts = rows.filter("digit IS NOT NULL").groupBy("bucket", "digit").agg(
            F.count("*").alias("rows"), F.sum(F.size("t") - F.col("depth")).alias("left"), F.min(F.struct("t", "b")).alias("lo"), F.max("t").alias("hi"), F.min("conv").alias("node"), F.sum("n").alias("members"), F.first("depth").alias("at"), F.first("up").alias("above_conv")
        )
        large = parts.filter((F.col("rows") > 1) & (F.col("left") > local_turns))
        large = large.select("bucket", "digit", F.monotonically_increasing_id().alias("next"), _common(F.col("lo.t"), F.col("hi")).alias("to"), "at", "node", "members", "above_conv", "lo.b")
        large = work.table(large, "large")
        dealt.append(work.table(rows.join(large.select("bucket", "digit", "next", "to", "node"), ["bucket", "digit"], "left"), "dealt"))
        if large.isEmpty():
            break
        levels.append(large.select(F.col("next").alias("bucket"), F.col("bucket").alias("above"), (F.col("at") + 1).alias("first"), F.col("to").alias("depth"), F.col("node").alias("conv"), F.col("above_conv").alias("up"), F.col("members").alias("n"), F.slice("b", F.col("at") + 1, F.col("to") - F.col("at")).alias("sizes")))
        rows = dealt[-1].filter("next IS NOT NULL").select(F.col("next").alias("bucket"), F.col("to").alias("depth"), F.col("node").alias("up"), "t", "b", "conv", "n", "ends")

    small = [d.filter("digit IS NOT NULL AND next IS NULL").select(F.lit(k).cast("long").alias("round"), "bucket", "digit", F.col("depth").cast("long").alias("depth"), "up", "t", "b", "conv", "n", "ends") for k, d in enumerate(dealt)]
    parts = small[0]
    for more in small[1:]:
        parts = parts.unionByName(more)
    parts = parts.repartition(*_PART).sortWithinPartitions(*_PART)
    finished = work.table(parts.mapInArrow(_finish, f"{NODE}, round long, bucket long"), "finished")

    columns = [c.split()[0] for c in NODE.split(", ")]
    out, below = finished.select(*columns), None
    for k in range(len(levels) - 1, -1, -1):
        tops = finished.filter(F.col("round") == k).select("bucket", "n_leaves", "saved_tokens")
        tops = tops if below is None else tops.unionByName(below)
        sums = tops.groupBy("bucket").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ended = dealt[k].filter("digit IS NULL").select("bucket", F.col("ends").alias("own"))
        chain = levels[k].join(sums, "bucket", "left").join(ended, "bucket", "left")
        chain = chain.select("*", F.posexplode("sizes").alias("i", "size")).withColumn("last", F.col("first") + F.col("i") == F.col("depth"))
        from_here = Window.partitionBy("bucket").orderBy(F.col("i").desc())
        chain = chain.select(
            "bucket", "above", "i", F.col("conv").alias("conv_id"), (F.col("first") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("last"), F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + F.sum((F.col("n") - 1) * F.col("size")).over(from_here)).cast("long").alias("saved_tokens"), F.when(F.col("last"), F.coalesce("own", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        chain = work.table(chain, "chain")
        below = chain.filter("i = 0").select(F.col("above").alias("bucket"), "n_leaves", "saved_tokens")
        out = out.unionByName(chain.select(*columns))
    return out


def conversation_trie(turns: DataFrame, shared: bool = True, local_turns: int = LOCAL_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie of a table of turns, with shared openings if ``shared``.

    Turns are ordered by number, null first; ties, repeated rows among them,
    go by a digest of role and text and all count. A null role or text is
    empty. Rows without a conversation's id belong to none and are left out.
    Texts of any length are read whole, for their digest and size alone. Other
    columns, whatever their names, are not read. An empty table gives an empty
    one.
    """
    work = Workspace(turns.sparkSession, "trie")
    convs = work.table(encoded(turns, work, conv_col, turn_col, role_col, text_col), "conversations")
    return prefix_trie(with_shared_openings(convs) if shared else convs, local_turns, work)
