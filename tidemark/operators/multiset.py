"""Multiset operations on arrays and sets of token lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship


def _bags(batches):
    """(key, x, n, m) of rows (key, l, r) in order of key: how often each element is in either array of a key's rows."""
    held = None
    for batch in batches:
        key, parts = batch.column("key"), [] if held is None else [held]
        for side in ("l", "r"):
            at, x = pc.list_parent_indices(batch.column(side)), pc.list_flatten(batch.column(side))
            one, none = (pa.array(np.full(len(x), k, np.int64)) for k in (1, 0))
            parts.append(pa.table({"key": key.take(at), "x": x, "n": one if side == "l" else none, "m": none if side == "l" else one}))
        sums = pa.concat_tables(parts).group_by(["key", "x"], use_threads=False).aggregate([("n", "sum"), ("m", "sum")])
        sums = sums.select(["key", "x", "n_sum", "m_sum"]).rename_columns(["key", "x", "n", "m"])
        if not len(sums):
            continue
        # the last key may go on in the next batch
        last = pc.fill_null(pc.equal(sums.column("key"), key[-1]), False) if key[-1].is_valid else pc.is_null(sums.column("key"))
        held = sums.filter(last)
        yield from sums.filter(pc.invert(last)).to_batches(100_000)
    if held is not None:
        yield from held.to_batches(100_000)


def _counts(rows: DataFrame, key: str, left: str | Column, right: str | Column) -> DataFrame:
    """(key, x, n, m): how often the left and the right array hold an element. Rows move once, by key, and are counted
    where they arrive: elements are neither shuffled one by one nor held for more than a batch. Arrays given as
    expressions are made after the move. Nulls equal nothing."""
    ship(rows.sparkSession)
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    kinds = dict(rows.select(F.col(key).alias("key"), F.explode(F.concat(left, right)).alias("x")).dtypes)
    arrays = [F.coalesce(c, F.array().cast(f"array<{kinds['x']}>")).alias(side) for c, side in ((left, "l"), (right, "r"))]
    dealt = rows.repartition(key).sortWithinPartitions(key).select(F.col(key).alias("key"), *arrays)
    out = dealt.mapInArrow(_bags, f"key {kinds['key']}, x {kinds['x']}, n long, m long")
    return out.withColumn("m", F.when(F.col("key").isNull() | F.col("x").isNull(), 0).otherwise(F.col("m")).cast("long"))


def intersection(rows: DataFrame, key: str, left: str | Column, right: str | Column) -> DataFrame:
    """(key, x, n): elements that both arrays hold, as often as the one that holds fewer."""
    both = _counts(rows, key, left, right).filter("n > 0 AND m > 0")
    return both.select(F.col("key").alias(key), "x", F.least("n", "m").alias("n"))


def difference(rows: DataFrame, key: str, left: str | Column, right: str | Column) -> DataFrame:
    """(key, x, n): elements of the left array less those of the right one, counted."""
    return _counts(rows, key, left, right).filter("n > m").select(F.col("key").alias(key), "x", (F.col("n") - F.col("m")).alias("n"))


def distinct_texts(rows: DataFrame, topic: str) -> DataFrame:
    """rows (topic, tokens, doc_id) once for each token list of a topic, with its first document."""
    return rows.groupBy(topic, "tokens").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
