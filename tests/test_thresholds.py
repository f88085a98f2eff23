"""Spanning forests and their cuts, and double sweeps, against brute force; odd input."""

import math
import random

import numpy as np

from tidemark.operators import thresholds as H
from tidemark.operators.components import uniting
from tidemark.operators.diameter import wide_pairs
from tidemark.plans.topics import vectors
from tidemark.storage import Workspace

EDGES = "a long, b long, dist double"


def kruskal(edges):
    edges = sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b and w is not None)
    kept = uniting([e[1] for e in edges], [e[2] for e in edges])
    return sorted((edges[k][1], edges[k][2], edges[k][0]) for k in kept)


def test_forest_and_cuts_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.1, 0.2, 0.3, 0.3, 0.4])) for _ in range(110)]
    edges += edges[:5] + [(1, 2, None), (70, 71, 0.25), (72, 73, 0.2), (3, 3, 0.0)]
    work = Workspace(spark, "test-forest")
    forest = H.spanning_forest(spark.createDataFrame(edges, EDGES), work)
    assert sorted(map(tuple, forest.collect())) == kruskal(edges)
    nodes = spark.createDataFrame([(i,) for i in range(75)], "id long")
    limits = [0.31, 0.15, 9.0, 0.0]
    found = {(r.at, r.id): r.cluster_id for r in H.cuts(nodes, forest, limits, work).collect()}
    assert len(found) == 4 * 75
    for at, limit in enumerate(limits):
        label = list(range(75))
        for _ in range(75):
            for a, b, w in edges:
                if w is not None and w < limit:
                    label[a] = label[b] = min(label[a], label[b])
        assert [found[at, i] for i in range(75)] == label


def test_forest_of_nothing(spark):
    work = Workspace(spark, "test-forest")
    forest = H.spanning_forest(spark.createDataFrame([], EDGES), work)
    assert forest.count() == 0
    assert H.cuts(spark.createDataFrame([], "id long"), forest, [1.0], work).count() == 0


def test_sweeps_between_half_the_width_and_it(spark, sf):
    rows = vectors(spark, sf).collect()
    found = {r.cluster_id: r for r in wide_pairs(vectors(spark, sf).selectExpr("topic_id AS cluster_id", "vec_id AS id", "v")).collect()}
    for topic in {r.topic_id for r in rows}:
        own = [r for r in rows if r.topic_id == topic]
        v = np.array([r.v for r in own])
        v /= np.linalg.norm(v, axis=1)[:, None]
        angles = np.arccos(np.clip(v @ v.T, -1, 1))
        got = math.acos(1 - found[topic].dist)
        assert angles.max() / 2 - 1e-9 <= got <= angles.max() + 1e-9


def test_sweeps_of_odd_clusters(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, None), (1, 4, [0.0, 0.0]), (2, 5, [1.0, 0.0]), (3, 6, [1.0, 1.0]), (3, 7, [1.0, 1.0]), (3, 8, [2.0, 2.0])]
    rows += [(4, i, [math.cos(i / 40), math.sin(i / 40)]) for i in range(100, 170)]
    found = {r.cluster_id: (r.a, r.b, round(r.dist, 6)) for r in wide_pairs(spark.createDataFrame(rows, "cluster_id long, id long, v array<double>")).collect()}
    assert found[1] == (1, 2, 1.0) and found[3][2] == 0.0 and found[4][:2] == (100, 169)
    assert set(found) == {1, 3, 4}
    assert wide_pairs(spark.createDataFrame([], "cluster_id long, id long, v array<double>")).count() == 0


def test_a_part_keeps_its_forest_only(monkeypatch):
    """Of a part's edges no more than it has nodes are shuffled, and the forest is the same."""
    import pyarrow as pa

    monkeypatch.setattr(H, "HELD", 50)
    r = random.Random(2)
    edges = sorted({(a, b, r.random()) for a in range(30) for b in range(a + 1, 30)})
    rows = pa.table({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "dist": [e[2] for e in edges]})
    kept = [tuple(x.values()) for batch in H._part_forest(rows.to_batches(max_chunksize=40)) for x in batch.to_pylist()]
    assert len(kept) == 29
    order = sorted(edges, key=lambda e: e[2])
    assert sorted(kept) == sorted(order[k] for k in H.uniting([e[0] for e in order], [e[1] for e in order]))
