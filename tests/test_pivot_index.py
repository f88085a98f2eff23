"""The pivot index against the exact ranking: recall, share of distances, inserts, erasures, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import distances as D
from tidemark.operators.pivot_index import PivotIndex
from tidemark.plans import topics as plans

SCHEMA = "pivot_id long, topic_id long, v array<double>"


def clustered(n_topics=400, seed=3, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n_topics, dim))
    pivots = [(t * 100 + i, t, (centers[t] + 0.1 * rng.normal(size=dim)).tolist()) for t in range(n_topics) for i in range(6)]
    docs = [(1_000_000 + i, (centers[i % n_topics] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(400)]
    return pivots, docs


def recall(found, exact):
    want = {(r.doc_id, r.topic_id): r.dist for r in exact.collect()}
    got = {(r.doc_id, r.topic_id): r.dist for r in found.collect()}
    both = want.keys() & got.keys()
    assert all(abs(want[x] - got[x]) < 2e-6 for x in both)
    return len(both) / len(want)


def test_recall_and_share_on_clusters(spark):
    pivots, docs = clustered()
    pivots, docs = spark.createDataFrame(pivots, SCHEMA), spark.createDataFrame(docs, "doc_id long, v array<double>")
    index = PivotIndex(spark, 16)
    index.build(pivots)
    assert recall(index.nearest_topics(docs, 1), D.nearest_topics(docs, pivots, 1)) >= 0.95
    assert recall(index.nearest_topics(docs, 3, 32), D.nearest_topics(docs, pivots, 3)) >= 0.9
    work = index.visited(docs, 1).agg(F.sum("computed").alias("c"), F.sum("all").alias("a")).first()
    assert work.c < 0.4 * work.a


def test_recall_on_embeddings(spark, sf):
    docs, pivots = plans._docs(spark, sf), plans._pivots(spark, sf)
    index = PivotIndex(spark, 64)
    index.build(pivots)
    assert recall(index.nearest_topics(docs, 3), D.nearest_topics(docs, pivots, 3)) >= 0.95
    assert recall(plans.indexed_topk(spark, sf), plans.topk_topics(spark, sf)) >= 0.95
    exact = plans._matched(spark, sf).filter("topic_id >= 0")
    found = index.nearest_topics(docs, 1).filter(F.col("dist") < plans.SETTINGS.beta)
    assert recall(found, exact) >= 0.95


def test_inserts_touch_their_cells_and_keep_recall(spark):
    pivots, docs = clustered(n_topics=200)
    docs = spark.createDataFrame(docs, "doc_id long, v array<double>")
    index = PivotIndex(spark, 16)
    index.build(spark.createDataFrame(pivots[:600], SCHEMA))
    cells = {r.cell_id: r.n for r in index.table("cell").collect()}
    files = set(index.snapshots.parts(index.snapshots.latest())["entry"])
    one = spark.createDataFrame(pivots[600:601], SCHEMA)
    assert index.insert(one) == 1
    after = {r.cell_id: r.n for r in index.table("cell").collect()}
    assert sum(cells.get(c) != n for c, n in after.items()) <= 2  # its cell, or the two that it was split into
    assert files < set(index.snapshots.parts(index.snapshots.latest())["entry"])  # what was written stays as it is
    index.insert(spark.createDataFrame(pivots[601:], SCHEMA))
    assert sorted(r.pivot_id for r in index.entries().collect()) == [p[0] for p in pivots]
    assert len(index.table("cell").collect()) > len(cells)
    living = {r.cell_id for r in index.table("cell").collect()}
    assert all(set(r.near) <= living - {r.cell_id} for r in index.table("cell").collect())
    assert recall(index.nearest_topics(docs, 1), D.nearest_topics(docs, spark.createDataFrame(pivots, SCHEMA), 1)) >= 0.95


def test_a_pivot_that_moves_and_one_that_goes(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 2, [0.0, 1.0]), (4, 2, [0.1, 1.0])]
    docs = spark.createDataFrame([(9, [1.0, 0.05])], "doc_id long, v array<double>")
    index = PivotIndex(spark, 2)
    index.build(spark.createDataFrame(rows, SCHEMA))
    assert [(r.rank, r.topic_id) for r in index.nearest_topics(docs, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    index.insert(spark.createDataFrame([(2, 1, [-1.0, 0.0])], SCHEMA))
    assert sorted((r.pivot_id, r.v[0]) for r in index.entries().collect()) == [(1, 1.0), (2, -1.0), (3, 0.0), (4, 0.1)]
    index.erase(spark.createDataFrame([(1,)], "pivot_id long"))
    assert [r.topic_id for r in index.nearest_topics(docs, 2).collect()] == [2]  # one pivot is no topic to match
    index.insert(spark.createDataFrame([(1, 1, [1.0, 0.0])] * 2, SCHEMA))
    assert sorted(r.pivot_id for r in index.entries().collect()) == [1, 2, 3, 4]


def test_empty_odd_and_equal_vectors(spark):
    docs = spark.createDataFrame([(9, [1.0, 0.0]), (10, None), (11, [0.0, 0.0]), (12, [float("nan"), 1.0])], "doc_id long, v array<double>")
    index = PivotIndex(spark, 2)
    index.build(spark.createDataFrame([], SCHEMA))
    assert index.nearest_topics(docs, 2).count() == 0
    equal = [(i, i % 7, [1.0, 1.0]) for i in range(200)] + [(500, 1, None), (501, 1, [0.0, 0.0]), (502, 1, [float("inf"), 0.0])]
    index.insert(spark.createDataFrame(equal, SCHEMA))
    assert index.entries().count() == 200
    found = index.nearest_topics(docs, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.rank, r.topic_id) for r in found] == [(9, 1, 0), (9, 2, 1)]
    index.insert(spark.createDataFrame([(i, 1, [1.0, 1.0]) for i in range(600, 900)], SCHEMA))
    assert index.entries().count() == 500
    with pytest.raises(ValueError):
        index.insert(spark.createDataFrame([(1, 1, [1.0])], SCHEMA))


def test_cells_are_bounded_by_bytes(spark):
    pivots, _ = clustered(n_topics=50)
    index = PivotIndex(spark, 16, Settings(broadcast_bytes=8 * (16 + 48) * 5))
    index.build(spark.createDataFrame(pivots, SCHEMA))
    index.insert(spark.createDataFrame([(p + 50_000, t, v) for p, t, v in pivots], SCHEMA))
    assert index.table("cell").count() <= 5
    assert index.entries().count() == 600
