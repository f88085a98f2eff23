"""Pruned ranking of topics: equal to the full one, with few distances; vectors of any length; limits of subscriptions."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import distances as D


def clustered(spark, n_topics=60, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n_topics, 16))
    pivots = [(t * 100 + i, t, (centers[t] + 0.1 * rng.normal(size=16)).tolist()) for t in range(n_topics) for i in range(8)]
    docs = [(10_000 + i, (centers[i % n_topics] + 0.2 * rng.normal(size=16)).tolist()) for i in range(300)] + [(205, pivots[0][2])]
    return spark.createDataFrame(docs, "doc_id long, v array<double>"), spark.createDataFrame(pivots, "pivot_id long, topic_id long, v array<double>")


def rounded(df):
    return sorted((r.doc_id, r.rank, r.topic_id, round(r.dist, 9)) for r in df.collect())


def test_pruned_equals_full_with_few_distances(spark):
    docs, pivots = clustered(spark)
    full = D.top_topics(D.pair_distances(D.pivot_pairs(docs, pivots)), 3)
    assert rounded(D.nearest_topics(docs, pivots, 3)) == rounded(full)
    work = D.distances_computed(docs, pivots, 3).agg(F.sum("computed").alias("c"), F.sum("all").alias("a")).first()
    assert work.c < work.a / 3
    near = D.distances_computed(docs, pivots, 1).agg(F.sum("computed").alias("c"), F.sum("all").alias("a")).first()
    assert near.c < work.c


def test_entering_topics_equal_full_ranking(spark):
    docs, pivots = clustered(spark)
    limits = D.nearest_topics(docs, pivots.filter("topic_id % 2 = 0"), 3).groupBy("doc_id").agg(F.max("dist").alias("top_limit"))
    subs = docs.join(limits, "doc_id")
    new = pivots.filter("topic_id % 2 = 1")
    full = D.pair_distances(D.pivot_pairs(docs, new)).join(limits, "doc_id").filter("dist < top_limit")
    assert rounded(D.entering_topics(subs, new, 3)) == rounded(D.top_topics(full, 3))
    blocks = Settings(broadcast_pivots=100)
    assert rounded(D.entering_topics(subs, new, 3, blocks)) == rounded(D.top_topics(full, 3))
    with_, without = (D.distances_computed(x, new, 3).agg(F.sum("computed")).first()[0] for x in (subs, docs))
    assert with_ < without


def test_vectors_of_any_length(spark):
    pivots = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 1.0]), (3, 2, [1.0, 0.0, 0.0]), (4, 2, [0.0, 1.0, 0.0]), (5, 2, [1.0, 0.0]), (6, 3, []), (7, 3, [0.0, 0.0])], "pivot_id long, topic_id long, v array<double>")
    rows = [(10, [1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [1.0] * 5), (13, None), (14, []), (15, [0.0, 0.0]), (16, [float("nan"), 1.0])]
    docs = spark.createDataFrame(rows, "doc_id long, v array<double>")
    assert rounded(D.nearest_topics(docs, pivots, 2)) == [(10, 1, 1, round(1 - 0.5**0.5, 9)), (11, 1, 2, 1.0)]
    assert D.nearest_topics(docs, pivots.limit(0), 2).count() == 0
