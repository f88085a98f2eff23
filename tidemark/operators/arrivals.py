"""How a single stream of rows is read: subscriptions first, then publications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings


def arrivals(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows (seq, ...) with kind and row: the first ``settings.subscriptions`` are subscriptions; after them reading
    starts again at row ``settings.publish_from`` and at most ``settings.publications`` rows are published."""
    first = F.lit(settings.subscriptions)
    rows = rows.filter(F.col("seq") < first + settings.publications)
    subscribing = F.col("seq") < first
    kind = F.when(subscribing, "subscribe").otherwise("publish")
    return rows.withColumn("kind", kind).withColumn("row", F.when(subscribing, F.col("seq")).otherwise(F.col("seq") - first + settings.publish_from))
