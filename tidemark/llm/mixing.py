"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Each source's target is its weight's share of the wanted size, clamped at a
number of epochs of its own size; what is cut off goes to the other sources in
proportion to their weights until none is above its clamp. A document is then
taken a whole number of times, and a seeded fraction of each source's
documents once more: the first ones of a seeded order, up to a cut.

Documents are measured once and never sorted as a whole. Sums over the first
bits of the order find the part of each source that holds the cut, sums over
the next bits the part of that part; only the documents in there, one in about
a million, are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

WORD = "[^\\x20\\x09-\\x0D]+"
EPOCHS = 3
SEED = 17
#: Bits of the seeded order that are summed over first and next, of 48.
FIRST_BITS, NEXT_BITS = 8, 12


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """weight for each row of sources (source): the weights in turn, by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """target for each row of sources (source, source_size, weight): together the sum of all sizes.

    The level at which targets stop is found in closed form: with sources in
    the order of clamp / weight, all before some place are clamped and the
    others share the rest by weight. The table has one row for each source.
    """
    clamp = F.col("source_size") * epochs
    order = Window.orderBy((clamp / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = sources.withColumn("_spent", F.coalesce(F.sum(clamp).over(before), F.lit(0))).withColumn("_open", F.sum("weight").over(after))
    rows = rows.withColumn("_left", F.sum("source_size").over(everything) - F.col("_spent"))
    fits = F.col("_left") * F.col("weight") <= clamp * F.col("_open")
    rows = rows.withColumn("_first", F.min(F.when(fits, F.struct((clamp / F.col("weight")).alias("r"), F.col("_left").alias("left"), F.col("_open").alias("open")))).over(everything))
    shared = F.col("_first.left") * F.col("weight") / F.col("_first.open")
    target = F.when(clamp / F.col("weight") < F.col("_first.r"), clamp.cast("double")).otherwise(F.least(clamp.cast("double"), shared))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _draw(id_: Column, seed: int) -> Column:
    """A seeded number below 2**48 for each document."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def _cut(parts: DataFrame, base: str | None = None) -> DataFrame:
    """(source, part, ahead) of the part in which each source's rest ends; parts have (source, part, size, rest)."""
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(before), F.lit(0)) + (F.col(base) if base else F.lit(0))
    parts = parts.withColumn("ahead", ahead).filter((F.col("ahead") + F.col("size") > F.col("rest")) & (F.col("ahead") <= F.col("rest")))
    return parts.select("source", "part", "ahead")


def _with(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with plan on the source, null too."""
    plan = plan.withColumnRenamed("source", "_source")
    return rows.join(plan, rows["source"].eqNullSafe(plan["_source"]), how).drop("_source")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: int = SEED, size: Column | None = None, weights=cyclic_weights, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken, repeats, and carried (a struct of the columns in carry).

    size defaults to the number of words; a null or empty text has size 0 and
    takes nothing, and a text of any length is counted whole. Null is a source
    like others, a null id an id like others. Documents are put in a seeded
    order within their source, and the first ones, up to the fraction of the
    source's size that whole epochs leave, are taken once more; the document
    at the cut is taken in when half of it or more lies before the cut. Ties in
    that order go by id and size; rows with the same id and size, repeated rows
    among them, are interchangeable. A source or a table without words has
    target 0, an empty table gives an empty one. Columns that are not carried,
    whatever their names, are not read.
    """
    work = Workspace(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _draw(F.col(id_col), seed).alias("draw"), *carried)
    rows = work.table(rows, "sizes")
    first = F.shiftright("draw", 48 - FIRST_BITS)
    next_ = F.shiftright("draw", 48 - FIRST_BITS - NEXT_BITS).bitwiseAND((1 << NEXT_BITS) - 1)

    parts = work.table(rows.groupBy("source", first.alias("part")).agg(F.sum("size").alias("size")), "parts")
    filled = water_fill(weights(parts.groupBy("source").agg(F.sum("size").alias("source_size"))), epochs)
    filled = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    filled = filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight")
    filled = work.table(_with(filled, _cut(_with(parts, filled.select("source", "rest"))).select("source", F.col("part").alias("cut1"), F.col("ahead").alias("ahead1")), "left"), "targets")
    finer = _with(rows.select("source", "size", "draw"), filled.select("source", "cut1", "ahead1", "rest")).filter(first == F.col("cut1"))
    finer = finer.groupBy("source", next_.alias("part")).agg(F.sum("size").alias("size"), F.first("ahead1").alias("ahead1"), F.first("rest").alias("rest"))
    plan = work.table(_with(filled, _cut(finer, "ahead1").select("source", F.col("part").alias("cut2"), F.col("ahead").alias("ahead2")), "left"), "plan")

    rows = _with(rows, plan)
    before = (first < F.col("cut1")) | ((first == F.col("cut1")) & (next_ < F.col("cut2")))
    here = F.coalesce((first == F.col("cut1")) & (next_ == F.col("cut2")), F.lit(False))
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("ahead2") + F.coalesce(F.sum("size").over(order), F.lit(0))
    away = rows.filter(~here).withColumn("again", F.coalesce(before, F.lit(True)))
    at_cut = rows.filter(here).withColumn("again", ahead + F.col("size") / 2 <= F.col("rest"))
    repeats = F.col("whole") + F.col("again").cast("long")
    out = away.union(at_cut).withColumn("repeats", repeats)
    return out.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", *(["carried"] if carry else []))
