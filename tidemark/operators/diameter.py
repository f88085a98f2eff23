"""The width of clusters by sweeps: farthest points of farthest points, in place of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, norm

SWEEPS = 5


def _farthest(members: DataFrame, start: DataFrame) -> DataFrame:
    """(cluster_id, sweep, from, id, dist): each start's farthest other member; ties go to the lowest id."""
    s = start.select(F.col("cluster_id").alias("c"), "sweep", F.col("id").alias("from"), F.col("v").alias("w"), F.col("n").alias("m"))
    rows = members.join(s, (F.col("cluster_id") == F.col("c")) & (F.col("id") != F.col("from")))
    dist = cosine_distance(F.col("v"), F.col("w"), F.col("n"), F.col("m"))
    rows = rows.select("cluster_id", "sweep", "from", F.struct((-dist).alias("d"), "id").alias("e"))
    best = rows.groupBy("cluster_id", "sweep", "from").agg(F.min("e").alias("e"))
    return best.select("cluster_id", "sweep", "from", "e.id", (-F.col("e.d")).alias("dist"))


def wide_pairs(members: DataFrame, sweeps: int = SWEEPS, seed: int = 0) -> DataFrame:
    """(cluster_id, a, b, dist), a < b: the widest pair that double sweeps find in each cluster of members (cluster_id, id, v).

    A sweep starts from a member drawn by a seeded hash of its id, goes to the
    member farthest from it, and from there to the farthest again. All sweeps
    of all clusters run together: two joins of members with a few rows a
    cluster and two aggregations, whatever the clusters' sizes; partial
    aggregates leave few rows of a large cluster to be shuffled. Angles are a
    metric, so the angle of the pair is between half the greatest one and it.

    Clusters with fewer than two members that have a distance have no row;
    vectors that are null, zero or not finite have none. Of equal pairs the
    lowest ids are taken.
    """
    n = norm(F.col("v"))
    able = members.select("cluster_id", "id", "v").withColumn("n", n).filter((F.col("n") > 0) & (F.col("n") < float("inf")))
    drawn = [F.min(F.struct(F.md5(F.concat_ws("/", F.lit(str(seed + k)), F.col("id").cast("string")).cast("binary")).alias("h"), "id")) for k in range(sweeps)]
    firsts = able.groupBy("cluster_id").agg(F.array(*[F.struct(F.lit(k).alias("sweep"), x.alias("e")) for k, x in enumerate(drawn)]).alias("all"))
    start = firsts.select("cluster_id", F.explode("all").alias("s")).select("cluster_id", "s.sweep", "s.e.id")
    far = _farthest(able, start.join(able, ["cluster_id", "id"]))
    ends = _farthest(able, far.select("cluster_id", "sweep", "id").join(able, ["cluster_id", "id"]))
    a, b = F.least("from", "id"), F.greatest("from", "id")
    best = ends.groupBy("cluster_id").agg(F.min(F.struct((-F.col("dist")).alias("d"), a.alias("a"), b.alias("b"))).alias("p"))
    return best.select("cluster_id", "p.a", "p.b", (-F.col("p.d")).alias("dist"))
