"""Topics: pivots, merges, decay and expiry, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, decayed, dot, merge_limit, norm
from ..storage import Workspace

ROUNDS = 3


def first_pivots(vectors: DataFrame, n: int) -> DataFrame:
    """(pivot_id, topic_id, v): a topic is represented by its n oldest vectors (vec_id, topic_id, v)."""
    order = Window.partitionBy("topic_id").orderBy("vec_id")
    return vectors.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).select(F.col("vec_id").alias("pivot_id"), "topic_id", "v")


def centers(vectors: DataFrame) -> DataFrame:
    """(cluster_id, v, members): the component-wise sum of each topic's vectors; cosine does not mind the scale."""
    cells = vectors.select("topic_id", F.posexplode("v").alias("pos", "x")).groupBy("topic_id", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    rows = cells.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("n").alias("members"))
    return rows.select(F.col("topic_id").alias("cluster_id"), F.transform("c", lambda s: s["x"]).alias("v"), "members")


def two_means(vectors: DataFrame, rounds: int = ROUNDS, work: Workspace | None = None) -> DataFrame:
    """(vec_id, topic_id, part): each topic's vectors in two parts, by 2-means from its two lowest ids.

    Seeds must be distinct vectors; a topic with one distinct vector has one
    part. Ties go to part 2, vectors without a distance to part 1. All topics move on together: a round is a join
    with the centers, of which there are two a topic, and one aggregation, so
    that no topic is gathered in a task. With work, each round's centers are
    stored there, else the plan of a round holds that of the one before several times.
    """
    keep = (lambda rows: work.table(rows, "centers")) if work else (lambda rows: rows)
    distinct = vectors.groupBy("topic_id", "v").agg(F.min("vec_id").alias("vec_id"))
    seeds = distinct.withColumn("part", F.row_number().over(Window.partitionBy("topic_id").orderBy("vec_id"))).filter("part <= 2")
    now = keep(seeds.select("topic_id", "part", "v"))
    for k in range(rounds):
        both = now.groupBy("topic_id").agg(F.max(F.when(F.col("part") == 1, F.col("v"))).alias("c1"), F.max(F.when(F.col("part") == 2, F.col("v"))).alias("c2"))
        d1, d2 = cosine_distance(F.col("v"), F.col("c1")), cosine_distance(F.col("v"), F.col("c2"))
        placed = vectors.join(both, "topic_id").withColumn("part", F.when(F.coalesce((d2 <= d1) | F.col("c1").isNull(), F.lit(False)), 2).otherwise(1)).select("vec_id", "topic_id", "part", "v")
        if k < rounds - 1:
            cells = placed.select("topic_id", "part", F.posexplode("v").alias("pos", "x")).groupBy("topic_id", "part", "pos").agg(F.sum("x").alias("x"))
            rows = cells.groupBy("topic_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
            now = keep(rows.select("topic_id", "part", F.transform("c", lambda s: s["x"]).alias("v")))
    return placed.select("vec_id", "topic_id", F.col("part").cast("long").alias("part"))


def pivots_of(vectors: DataFrame, parts: DataFrame) -> DataFrame:
    """(pivot_id, topic_id, v): the summed vectors of each part; the id is the part's lowest one."""
    rows = vectors.join(parts.select("vec_id", "part"), "vec_id")
    cells = rows.select("topic_id", "part", F.posexplode("v").alias("pos", "x")).groupBy("topic_id", "part", "pos").agg(F.sum("x").alias("x"))
    sums = cells.groupBy("topic_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    ids = rows.groupBy("topic_id", "part").agg(F.min("vec_id").alias("pivot_id"))
    return sums.join(ids, ["topic_id", "part"]).select("pivot_id", "topic_id", F.transform("c", lambda s: s["x"]).alias("v"))


def may_have_pivots(texts: DataFrame, least: int) -> DataFrame:
    """(topic_id, distinct_texts) of the topics with more distinct token lists than least. Lists are told apart by their SHA-256, which is what is shuffled."""
    return texts.groupBy("topic_id").agg(F.count_distinct(F.sha2(F.to_json("tokens"), 256)).alias("distinct_texts")).filter(F.col("distinct_texts") > least)


def new_pivots(pairs: DataFrame, beta: float) -> DataFrame:
    """(doc_id, topic_id, dist) of added documents that lie farther than beta / 2 from all pivots of their topic."""
    return pairs.groupBy("doc_id", "topic_id").agg(F.min("dist").alias("dist")).filter(F.col("dist") > beta / 2)


def unit_sums(pivots: DataFrame) -> DataFrame:
    """(topic_id, v, k): the summed unit vectors of each topic's k pivots; zero vectors don't count."""
    rows = pivots.withColumn("n", norm(F.col("v"))).filter("n > 0")
    cells = rows.select("topic_id", "n", F.posexplode("v").alias("pos", "x")).groupBy("topic_id", "pos").agg(F.sum(F.col("x") / F.col("n")).alias("x"), F.count("*").alias("k"))
    sums = cells.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("k").alias("k"))
    return sums.select("topic_id", F.transform("c", lambda s: s["x"]).alias("v"), "k")


def average_linkage(pivots: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(topic_a, topic_b, dist), a < b: the mean distance of their pivots; with of (topic_id), only pairs with one of these.

    The mean of cosines is a product of sums of unit vectors, so topics are
    compared by one vector each instead of by all pairs of pivots. All pairs
    of topics are measured; ``topic_graph`` finds the near ones without that.
    """
    sums = unit_sums(pivots)
    if of is None:
        pairs = sums.alias("a").join(sums.alias("b"), F.col("a.topic_id") < F.col("b.topic_id"))
        return pairs.select(F.col("a.topic_id").alias("topic_a"), F.col("b.topic_id").alias("topic_b"), _mean_distance().alias("dist"))
    chosen = of.select("topic_id").distinct()
    pairs = sums.join(chosen, "topic_id", "left_semi").alias("a").join(sums.alias("b"), F.col("a.topic_id") != F.col("b.topic_id"))
    low, high = F.least("a.topic_id", "b.topic_id"), F.greatest("a.topic_id", "b.topic_id")
    return pairs.select(low.alias("topic_a"), high.alias("topic_b"), _mean_distance().alias("dist")).dropDuplicates(["topic_a", "topic_b"])


def linkage(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """(topic_a, topic_b, dist): the average linkage of given pairs (topic_a, topic_b), by the topics' unit_sums."""
    rows = pairs.join(sums.alias("a"), F.col("topic_a") == F.col("a.topic_id")).join(sums.alias("b"), F.col("topic_b") == F.col("b.topic_id"))
    return rows.select("topic_a", "topic_b", _mean_distance().alias("dist"))


def _mean_distance() -> Column:
    return 1 - dot(F.col("a.v"), F.col("b.v")) / (F.col("a.k") * F.col("b.k"))


def nearest_linked(linkage: DataFrame) -> DataFrame:
    """(topic_id, nearest, dist): each topic's nearest other one; ties go to the lowest."""
    both = linkage.select(F.col("topic_a").alias("topic_id"), F.col("topic_b").alias("nearest"), "dist").union(linkage.select("topic_b", "topic_a", "dist"))
    return both.groupBy("topic_id").agg(F.min(F.struct("dist", "nearest")).alias("b")).select("topic_id", "b.nearest", "b.dist")


def nearest_other(linkage: DataFrame, sizes: DataFrame, alpha: float) -> DataFrame:
    """(topic_id, nearest, dist, merge_limit): each topic's nearest other one and the limit under which they merge."""
    return nearest_linked(linkage).join(sizes, "topic_id").select("topic_id", "nearest", "dist", merge_limit(F.col("n_docs"), alpha).alias("merge_limit"))


def merge_map(merges: DataFrame) -> DataFrame:
    """(topic_id, survivor) of merges (topic_id, nearest): the lower of the two survives."""
    return merges.select(F.greatest("topic_id", "nearest").alias("topic_id"), F.least("topic_id", "nearest").alias("survivor")).groupBy("topic_id").agg(F.min("survivor").alias("survivor"))


def merged_texts(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(topic_id, tokens, flag) as a set: of equal token lists the survivor's own flag stays."""
    rows = texts.join(mapping, "topic_id", "left").withColumn("target", F.coalesce("survivor", "topic_id"))
    own = (F.col("target") != F.col("topic_id")).cast("int")
    best = rows.groupBy("target", "tokens").agg(F.min(F.struct(own, "topic_id", "flag")).alias("b"))
    return best.select(F.col("target").alias("topic_id"), "tokens", "b.flag")


def remapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with topic_id replaced by its survivor."""
    out = rows.join(mapping, "topic_id", "left")
    return out.withColumn("topic_id", F.coalesce("survivor", "topic_id")).drop("survivor")


def expired(pivots: DataFrame, now: Column, rate: float, least: float) -> DataFrame:
    """pivots (topic_id, pivot_id, last_tick) with score, expired and topic_expired (it was the topic's last)."""
    rows = pivots.withColumn("score", decayed(now - F.col("last_tick"), rate)).withColumn("expired", F.col("score") < least)
    gone = rows.groupBy("topic_id").agg(F.min(F.col("expired").cast("int")).alias("_all"))
    return rows.join(gone, "topic_id").withColumn("topic_expired", F.col("_all") == 1).drop("_all")


def ticks(matched: DataFrame, block: int = 1 << 16) -> DataFrame:
    """matched (seq, matched) with tick: how many matches there are up to each row.

    Counted in blocks of seq, whose own totals are summed before, so that no
    task holds the whole stream.
    """
    rows = matched.withColumn("_block", F.floor(F.col("seq") / block)).withColumn("_one", F.col("matched").cast("long"))
    totals = rows.groupBy("_block").agg(F.sum("_one").alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.sum("_one").over(Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_within", within).join(before, "_block").withColumn("tick", F.col("_before") + F.col("_within")).drop("_block", "_one", "_within", "_before")


def topic_dump(texts: DataFrame) -> DataFrame:
    """(topic_id, n_docs, distinct_texts) of texts (topic_id, tokens)."""
    return texts.groupBy("topic_id").agg(F.count("*").alias("n_docs"), F.count_distinct("tokens").alias("distinct_texts"))


def pivot_report(pivots: DataFrame) -> DataFrame:
    """(topic_id, pivot_a, pivot_b, dist): ordered pairs of a topic's pivots, each with itself too."""
    rows = pivots.withColumn("n", norm(F.col("v")))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("a.topic_id") == F.col("b.topic_id"))
    dist = cosine_distance(F.col("a.v"), F.col("b.v"), F.col("a.n"), F.col("b.n"))
    return pairs.select(F.col("a.topic_id").alias("topic_id"), F.col("a.pivot_id").alias("pivot_a"), F.col("b.pivot_id").alias("pivot_b"), dist.alias("dist"))


def pivot_counts(topics: DataFrame, pivots: DataFrame) -> DataFrame:
    """(topic_id, n_pivots) of all topics, 0 for those without."""
    return topics.select("topic_id").distinct().join(pivots, "topic_id", "left").groupBy("topic_id").agg(F.count("pivot_id").alias("n_pivots"))


