"""Comparison of the rows of a group, block against block, without listing their pairs.

Each two blocks are a row of their own, which any task can take: a large group
is spread over as many tasks as it has pairs of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace


def _packed(rows: DataFrame, keys: list[str], block: Column, columns: tuple[str, ...], work: Workspace) -> DataFrame:
    rows = rows.withColumn("block", block).groupBy(*keys, "block").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return work.table(rows, "blocks")


def _faced(pairs: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, bx, by) with the rows of both blocks as x and y."""
    for c in "xy":
        own = packed.select(*keys, F.col("block").alias(f"b{c}"), F.col("rows").alias(c))
        pairs = pairs.hint("merge").join(own, [*keys, f"b{c}"])
    return pairs


def open_blocks(rows: DataFrame, keys: list[str], weight: Column, full: float, work: Workspace, *columns: str) -> DataFrame:
    """(keys, x, y) for each two blocks of a group whose rows may unite components; rows have (keys, id, component).

    Blocks hold rows of about ``full`` weight. Those of the group's largest
    component have the last numbers and are met by the others alone, so that
    groups of one component have no blocks at all.
    """
    sizes = rows.groupBy(*keys, "component").agg(F.sum(weight).alias("mass"))
    plan = sizes.groupBy(*keys).agg(F.max(F.struct("mass", "component")).alias("top"), F.sum("mass").alias("mass"))
    rest = F.col("mass") - F.col("top.mass")
    plan = plan.filter(rest > 0).select(*keys, F.col("top.component").alias("largest"), F.ceil(rest / full).alias("open"), F.ceil(F.col("top.mass") / full).alias("closed"))
    plan = work.table(plan, "plan")
    number = F.xxhash64("id")
    block = F.when(F.col("component") == F.col("largest"), F.col("open") + F.pmod(number, "closed")).otherwise(F.pmod(number, "open"))
    packed = _packed(rows.join(plan, keys), keys, block, columns, work)
    pairs = plan.withColumn("bx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("open") - 1)))
    pairs = pairs.select(*keys, "bx", F.explode(F.sequence("bx", F.col("open") + F.col("closed") - 1)).alias("by"))
    return _faced(pairs, packed, keys).select(*keys, "x", "y")


def all_blocks(rows: DataFrame, keys: list[str], full: int, work: Workspace, *columns: str) -> DataFrame:
    """(keys, x, y, same) for each block of a group with each; rows have (keys, id)."""
    plan = work.table(rows.groupBy(*keys).agg(F.ceil(F.count("*") / full).alias("blocks")), "plan")
    packed = _packed(rows.join(plan, keys), keys, F.pmod(F.xxhash64("id"), F.col("blocks")), columns, work)
    numbers = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = plan.withColumn("bx", F.explode(numbers)).select(*keys, "bx", F.explode(numbers).alias("by"))
    return _faced(pairs, packed, keys).select(*keys, "x", "y", (F.col("bx") == F.col("by")).alias("same"))
