"""Proto-clusters: grouping of documents that match no topic, until a group is large enough to become one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import angle, cosine_distance, join_limit, midpoint
from ..storage import Workspace, scratch
from .components import components, forests
from .distances import member_distances
from .similarity import groups_below, neighbours_within


def label_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster_id) for all nodes (id): the lowest id that edges (a, b) lead to."""
    work = Workspace(nodes.sparkSession, "clusters")
    label = components(forests(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), work)
    return nodes.select("id").join(label, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def label_near(nodes: DataFrame, rows: DataFrame, limit: float) -> DataFrame:
    """As label_components, with the edges of all pairs of rows (id, v) at a distance below limit."""
    work = Workspace(nodes.sparkSession, "clusters")
    with scratch(nodes.sparkSession):
        labels, links = groups_below(rows, limit)
        found = components(links, Workspace(nodes.sparkSession, "links"))
        first = labels.groupBy("id").agg(F.min("label").alias("label")).join(found, F.col("label") == F.col("node"), "left")
        label = first.select("id", F.coalesce("component", "label").alias("cluster_id"))
        return work.table(nodes.select("id").join(label, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id")), "clusters")


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("members"))


def births(members: DataFrame, check: int) -> DataFrame:
    """(cluster_id, members) of the clusters with more than check members."""
    return cluster_sizes(members).filter(F.col("members") > check)


def erase(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """members without those of the given clusters."""
    return members.join(clusters.select("cluster_id"), "cluster_id", "left_anti")


def erase_documents(members: DataFrame, documents: DataFrame) -> DataFrame:
    """members (id, cluster_id) without the documents (id); a cluster that loses its first member bears the next one's id."""
    left = members.join(documents.select("id"), "id", "left_anti")
    lowest = left.groupBy("cluster_id").agg(F.min("id").alias("_first"))
    return left.join(lowest, "cluster_id").withColumn("cluster_id", F.col("_first")).drop("_first")


def accepted(scored: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """Rows (doc_id, topic_id, dist) whose distance is below the join limit of that many members (topic_id, members)."""
    return scored.join(sizes, "topic_id").filter(F.col("dist") < join_limit(F.col("members"), settings.alpha))


def assign_lowest(accepted_rows: DataFrame) -> DataFrame:
    """(doc_id, topic_id, merged): the lowest accepted cluster, and how many others it takes in."""
    return accepted_rows.groupBy("doc_id").agg(F.min("topic_id").alias("topic_id"), (F.count("*") - 1).alias("merged"))


def _apart(r1: Column, r2: Column, dist: Column, alpha: float) -> Column:
    """Whether two balls are too wide together for one ball to replace them."""
    return F.coalesce(angle(r1) + angle(dist) + angle(r2) > 2 * alpha, F.lit(True))


def merged_radius(r1: Column, r2: Column, dist: Column, alpha: float) -> Column:
    """The first ball's radius, as a cosine distance, after it takes in the second: that of a ball around the larger of
    the two that holds both, or its own where the two angles and the one between the centers pass 2 * alpha."""
    reach = F.greatest(F.least(angle(r1), angle(r2)) + angle(dist), F.greatest(angle(r1), angle(r2)))
    return F.when(_apart(r1, r2, dist, alpha), r1).otherwise(1 - F.cos(F.least(reach, F.lit(math.pi))))


def merged_center(c1: Column, c2: Column, r1: Column, r2: Column, dist: Column, alpha: float) -> Column:
    """The first ball's center after it takes in the second: their midpoint, or its own beyond 2 * alpha."""
    return F.when(_apart(r1, r2, dist, alpha), c1).otherwise(midpoint(c1, c2))


def inflated(radius: Column, dist: Column, members: Column, alpha: float) -> Column:
    """The radius of a cluster of that many members after a document joins without a merge, dist from its nearest member:
    one hundredth larger if that distance and the join limit reach, as angles, beyond the radius."""
    return F.when(angle(radius) < angle(dist) + angle(join_limit(members, alpha)), radius * 1.01).otherwise(radius)


def online_add(clusters: DataFrame, members: DataFrame, docs: DataFrame, settings: Settings, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Documents join proto-clusters: members (id, cluster_id) and clusters (cluster_id, v, radius) afterwards.

    Given are clusters, their members (id, cluster_id, v) and new docs (id, v); ids grow with arrival and a cluster
    bears its first member's. A document looks at the clusters whose radius it lies in, joins the lowest one whose mean
    of the two nearest members is below the join limit, and merges all others that accept it into that one. Documents
    that nothing accepts found clusters; those of one call that lie below the first radius found one together. With one
    document a call this is the sequential clusterer. Documents are compared with centers and with each other, never
    waiting ones with waiting ones. Clusters that are due to become topics have no center afterwards.
    """
    near = neighbours_within(docs, clusters.select(F.col("cluster_id").alias("id"), "v", "radius"))
    rows = near.join(docs.select(F.col("id").alias("a"), F.col("v").alias("w")), "a")
    rows = rows.join(members.select(F.col("cluster_id").alias("b"), F.col("id").alias("pivot_id"), "v"), "b")
    pairs = rows.select(F.col("a").alias("doc_id"), F.col("b").alias("topic_id"), "pivot_id", cosine_distance(F.col("w"), F.col("v")).alias("dist")).filter("dist IS NOT NULL")
    sizes = cluster_sizes(members).select(F.col("cluster_id").alias("topic_id"), "members")
    joins = work.table(accepted(member_distances(pairs, F.min("dist").alias("closest")), sizes, settings), "joins")

    alone = docs.join(joins.select(F.col("doc_id").alias("id")), "id", "left_anti")
    links = joins.select(F.col("doc_id").alias("a"), F.col("topic_id").alias("b"))
    inside, between = groups_below(alone, settings.first_radius)
    links = links.union(inside.filter("id <> label").select("id", "label")).union(between.select("u", "v"))
    nodes = clusters.select(F.col("cluster_id").alias("id")).union(docs.select("id"))
    label = work.table(label_components(nodes, links).select("id", F.col("cluster_id").alias("target")), "labels")
    now = members.select("id", "cluster_id").join(label.withColumnRenamed("id", "cluster_id"), "cluster_id").select("id", F.col("target").alias("cluster_id"))
    now = work.table(now.union(docs.select("id").join(label, "id").select("id", F.col("target").alias("cluster_id"))), "members")

    # a cluster that stays one has few members, so few clusters are folded into it
    small = cluster_sizes(now).filter(F.col("members") <= settings.check).select(F.col("cluster_id").alias("target"))
    parts = clusters.join(label.withColumnRenamed("id", "cluster_id"), "cluster_id").join(small, "target", "left_semi")
    parts = parts.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "v", "radius"))).alias("p"))

    def fold(c: Column, x: Column) -> Column:
        dist = cosine_distance(c["v"], x["v"])
        return F.struct(
            merged_center(c["v"], x["v"], c["radius"], x["radius"], dist, settings.alpha).alias("v"),
            merged_radius(c["radius"], x["radius"], dist, settings.alpha).alias("radius"),
        )

    first = F.struct(F.col("p")[0]["v"].alias("v"), F.col("p")[0]["radius"].alias("radius"))
    folded = work.table(parts.select("target", F.aggregate(F.slice("p", 2, F.size("p")), first, fold).alias("c")).select("target", "c.v", "c.radius"), "folded")
    single = joins.groupBy("doc_id").agg(F.min("topic_id").alias("cluster_id"), F.count("*").alias("n"), F.min("closest").alias("closest"), F.min("members").alias("members")).filter("n = 1")
    single = single.join(clusters.select("cluster_id", "radius"), "cluster_id").filter(inflated(F.col("radius"), F.col("closest"), F.col("members"), settings.alpha) > F.col("radius"))
    wider = single.join(label.withColumnRenamed("id", "cluster_id"), "cluster_id").groupBy("target").agg(F.count("*").alias("times"))
    old = folded.join(wider, "target", "left").select(F.col("target").alias("cluster_id"), "v", (F.col("radius") * F.pow(F.lit(1.01), F.coalesce("times", F.lit(0)))).alias("radius"))
    seeds = docs.join(label, "id").filter("id = target").join(small, "target", "left_semi").join(folded.select("target"), "target", "left_anti")
    return now, work.table(old.union(seeds.select("target", "v", F.lit(settings.first_radius))), "clusters")


def retained(rows: DataFrame, seq: str, keep: int) -> DataFrame:
    """Rows (cluster_id, seq) of the clusters all of whose members are among the last keep arrivals."""
    last = rows.agg(F.max(seq).alias("_last"))
    old = rows.groupBy("cluster_id").agg(F.min(seq).alias("_first"))
    fresh = old.join(F.broadcast(last)).filter(F.col("_first") > F.col("_last") - keep)
    return rows.join(fresh.select("cluster_id"), "cluster_id", "left_semi")


def farthest_pair(pairs: DataFrame) -> DataFrame:
    """(cluster_id, a, b, dist) of the farthest pair (a < b) of each cluster; ties go to the lowest ids."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("dist"), "a", "b")
    return pairs.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("cluster_id", "a", "b", "dist")
