"""All thresholds at once: a minimum spanning forest of documents, whose cuts are the clusters of every limit.

Single linkage at a limit is connected components of the edges below it, and
a minimum spanning forest keeps these components at every limit. So edges are
joined once, at the widest limit, and each narrower one needs the forest's
edges alone, of which there are fewer than documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..storage import Workspace
from .components import components, uniting
from .metrics import normalised_time, refined, score

HELD = 500_000  #: edges that a task holds before it leaves out what closes a cycle


def _part_forest(batches):
    """A part's edges (a, b, dist) without those that close a cycle of lower ones: the whole's forest has none of them."""

    def forest(rows: pa.Table) -> pa.Table:
        a, b, dist = (rows.column(c).to_numpy() for c in ("a", "b", "dist"))
        order = np.lexsort((b, a, dist))
        return rows.take(order[uniting(a[order].tolist(), b[order].tolist())])

    held, most = None, HELD
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if len(held) > most:
            held = forest(held).combine_chunks()
            most = max(HELD, 2 * len(held))
    if held is not None and len(held):
        yield from forest(held).to_batches(100_000)


def spanning_forest(edges: DataFrame, work: Workspace) -> DataFrame:
    """(a, b, dist) of the minimum spanning forest of edges (a, b, dist), a <> b; of equal distances the lowest ids come first.

    Borůvka's rounds: each component takes its least edge out, by one
    aggregation, and what these edges join becomes one component. Components
    at least halve in number, so rounds grow with the logarithm of it. Edges
    inside a component leave, and of several between two only the least stays.
    Null distances are no edges; repeated ones count once. Where edges lie,
    those that close a cycle of lower ones leave first, so that no more are
    shuffled than each part has nodes.
    """
    ship(edges.sparkSession)
    clean = edges.filter("a <> b AND dist IS NOT NULL AND NOT isnan(dist)")
    clean = clean.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("dist").cast("double").alias("dist"))
    clean = clean.mapInArrow(_part_forest, "a long, b long, dist double").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    left = work.table(clean.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("dist", "a", "b").alias("e")), "left")
    forest = []
    while left.limit(1).count():
        both = left.select("u", "e").union(left.select("v", "e"))
        chosen = work.table(both.groupBy("u").agg(F.min("e").alias("e")).select("e").distinct().join(left, "e"), "chosen")
        forest.append(chosen.select("e.a", "e.b", "e.dist"))
        label = work.table(components(chosen.select("u", "v"), work), "label")
        moved = left.join(label.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        moved = moved.join(label.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        moved = moved.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "e").filter("u <> v")
        then, left = left, work.table(moved.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("e").alias("e")), "left")
        work.drop(then)
    out = clean.limit(0)
    for part in forest:
        out = out.union(part)
    return work.table(out, "forest")


def cuts(nodes: DataFrame, forest: DataFrame, limits: Iterable[float], work: Workspace) -> DataFrame:
    """(at, id, cluster_id) for each of the limits, numbered from 0 as given, and each of nodes (id): clusters of the forest's edges below it.

    Limits are taken upwards: a wider cut starts from the components of the
    narrower one, so that each edge is joined in once. The cluster's id is its lowest member.
    """
    out, label, below = [], nodes.select("id", F.col("id").alias("cluster_id")), float("-inf")
    for at, limit in sorted(enumerate(limits), key=lambda x: x[1]):
        more = forest.filter((F.col("dist") >= below) & (F.col("dist") < limit))
        ends = more.join(label.select(F.col("id").alias("a"), F.col("cluster_id").alias("u")), "a").join(label.select(F.col("id").alias("b"), F.col("cluster_id").alias("v")), "b")
        joined = components(ends.select("u", "v"), work)
        now = label.join(joined.select(F.col("node").alias("cluster_id"), "component"), "cluster_id", "left")
        label, below = work.table(now.select("id", F.coalesce("component", "cluster_id").alias("cluster_id")), f"cut-{at}"), limit
        out.append(label.select(F.lit(at).alias("at"), "id", "cluster_id"))
    whole = nodes.select(F.lit(0).alias("at"), "id", F.col("id").alias("cluster_id")).limit(0)
    for part in out:
        whole = whole.union(part)
    return whole


def settings_table(labels: DataFrame, clusters: DataFrame, matches: DataFrame, least: int) -> DataFrame:
    """(at, beta, nmi, fmr, time) of all settings in one pass of aggregations.

    labels (id, label) name the truth, clusters (at, id, cluster_id) are the
    cuts, matches (beta, id, topic_id) what each beta matches at once, -1 for
    nothing. A document counts under its topic, or without one under its
    cluster if that has more than ``least`` members, or under nothing. The
    time is how many documents are left for the clusters.
    """
    sizes = clusters.groupBy("at", "cluster_id").agg(F.count("*").alias("members"))
    grouped = clusters.join(sizes, ["at", "cluster_id"]).select("at", "id", F.when(F.col("members") > least, F.col("cluster_id")).alias("cluster_id"))
    rows = grouped.join(matches, "id").join(labels, "id")
    named = F.when(F.col("topic_id") >= 0, F.concat(F.lit("t"), F.col("topic_id"))).when(F.col("cluster_id").isNotNull(), F.concat(F.lit("c"), F.col("cluster_id"))).otherwise(F.lit("-"))
    cells = rows.groupBy("at", "beta", "label", named.alias("place")).agg(F.count("*").cast("double").alias("n"), F.sum((F.col("topic_id") >= 0).cast("double")).alias("hit"))
    key = ["at", "beta"]
    by_label, by_place = (cells.groupBy(*key, c).agg(F.sum("n").alias(m)) for c, m in (("label", "nl"), ("place", "np")))
    total = cells.groupBy(*key).agg(F.sum("n").alias("total"), F.sum("hit").alias("hit"))
    p = F.col("n") / F.col("total")
    mutual = cells.drop("hit").join(by_label, [*key, "label"]).join(by_place, [*key, "place"]).join(total, key)
    mutual = mutual.groupBy(*key).agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nl") * F.col("np")))).alias("mi"))
    for rows, m, h in ((by_label, "nl", "hl"), (by_place, "np", "hp")):
        share = F.col(m) / F.col("total")
        mutual = mutual.join(rows.join(total, key).groupBy(*key).agg((-F.sum(share * F.log(share))).alias(h)), key)
    mean = (F.col("hl") + F.col("hp")) / 2
    return mutual.join(total, key).select(*key, F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"), (F.col("hit") / F.col("total")).alias("fmr"), (F.col("total") - F.col("hit")).alias("time"))


def two_stages(cut: Callable[[list[float]], DataFrame], labels: DataFrame, best: DataFrame, alphas: list[float], betas: list[float], least: int, step: float, work: Workspace) -> DataFrame:
    """(stage, alpha, beta, nmi, fmr, time, norm_time, score) of a grid of settings, and of a finer one around its best.

    ``cut`` gives the clusters (at, id, cluster_id) of a list of alphas, best
    (id, topic_id, dist) each document's nearest topic, if it has one. Times
    are scaled within a stage; of scores equal to nine digits the lowest alpha and beta are taken.
    """
    spark = labels.sparkSession

    def stage(number: int, alphas: list[float], betas: list[float]) -> DataFrame:
        names = spark.createDataFrame([(k, float(a)) for k, a in enumerate(alphas)], "at int, alpha double")
        limits = spark.createDataFrame([(float(b),) for b in betas], "beta double")
        rows = labels.select("id").join(best, "id", "left").crossJoin(F.broadcast(limits))
        matches = rows.select("beta", "id", F.when(F.col("dist") < F.col("beta"), F.col("topic_id")).otherwise(F.lit(-1)).alias("topic_id"))
        out = settings_table(labels, cut(alphas), matches, least).join(F.broadcast(names), "at").withColumn("norm_time", normalised_time(F.col("time")))
        out = out.withColumn("score", score(F.col("nmi"), F.col("fmr"), F.col("norm_time")))
        return work.table(out.select(F.lit(number).alias("stage"), "alpha", "beta", "nmi", "fmr", "time", "norm_time", "score"), f"stage-{number}")

    coarse = stage(1, alphas, betas)
    top = coarse.orderBy(F.desc(F.round("score", 9)), "alpha", "beta").first()
    if top is None:
        return coarse
    fine = refined((top["alpha"], top["beta"]), step)
    return coarse.union(stage(2, sorted({a for a, _ in fine}), sorted({b for _, b in fine})))
