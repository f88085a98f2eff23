"""Operators on small hand-made rows, and properties that hold for any."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import text, vectors
from tidemark.operators import distances as D
from tidemark.operators import metrics, multiset, proto, subscriptions
from tidemark.operators import topics as T
from tidemark.operators.components import components, forests
from tidemark.operators.similarity import edges_below, neighbours_within
from tidemark.sources.paired import numbered_lines, read_paired, token_counts
from tidemark.storage import Workspace


def noise(n, dim=8, seed=0):
    r = random.Random(seed)
    return [(i, i % 3, [r.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


def cosine(a, b):
    return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(noise(40), "vec_id long, topic_id long, v array<double>").cache()


def test_cosine_of_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_limits(spark):
    s = Settings()
    row = spark.range(1).select(vectors.join_limit(F.lit(5), s.alpha), vectors.merge_limit(F.lit(12), s.alpha), vectors.decayed(F.lit(83_049), s.decay)).first()
    assert row[0] == pytest.approx(0.2364, abs=1e-4) and row[1] == pytest.approx(0.1894, abs=1e-4) and row[2] < s.min_keep
    assert s.first_radius == pytest.approx(0.38981, abs=1e-5) and s.candidate_limit == pytest.approx(0.21001, abs=1e-5)


def test_tokens_and_floats(spark):
    df = spark.createDataFrame([("  a b\t\tc\n", "1.5,x,,2"), ("", "")], "t string, l string")
    got = df.select(text.tokens(F.col("t")), text.parse_floats(F.col("l"))).collect()
    assert got[0][0] == ["a", "b", "c"] and got[0][1] == [1.5, 2.0] and got[1][0] == [] and got[1][1] == []


def test_pair_distance_is_at_least_twice_the_nearest(spark, rows):
    pivots = T.first_pivots(rows, 4)
    docs = rows.select(F.col("vec_id").alias("doc_id"), "v")
    pairs = D.pivot_pairs(docs, pivots).cache()
    least = {(r.doc_id, r.topic_id): r.m for r in pairs.groupBy("doc_id", "topic_id").agg(F.min("dist").alias("m")).collect()}
    for r in D.pair_distances(pairs).collect():
        assert r.dist >= 2 * least[r.doc_id, r.topic_id] - 1e-12


def test_blocks_and_kernel_equal_the_broadcast_form(spark, rows):
    pivots = T.first_pivots(rows, 4)
    docs = rows.select(F.col("vec_id").alias("doc_id"), "v")
    far = Settings(broadcast_pivots=3)
    key = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())
    assert key(D.pivot_pairs(docs, pivots)) == key(D.pivot_pairs(docs, pivots, far))
    plain = D.top_topics(D.pair_distances(D.pivot_pairs(docs, pivots)), 2).select("doc_id", "rank", "topic_id", "dist")
    assert key(plain) == key(D.nearest_topics(docs, pivots, 2)) == key(D.nearest_topics(docs, pivots, 2, far))


def test_no_pivots(spark, rows):
    docs = rows.select(F.col("vec_id").alias("doc_id"), "v")
    none = T.first_pivots(rows.filter("false"), 4)
    assert D.nearest_topics(docs, none, 2).count() == 0
    assert {r.topic_id for r in D.match(docs, D.pair_distances(D.pivot_pairs(docs, none)), 1.0, any_topic=False).collect()} == {-2}


def test_edges_equal_brute_force(spark, rows):
    data = noise(40)
    true = {(i, j) for i, _, a in data for j, _, b in data if i < j and cosine(a, b) < 0.7}
    for block in (7, 1024):
        assert {(r.a, r.b) for r in edges_below(rows.select(F.col("vec_id").alias("id"), "v"), 0.7, block).collect()} == true


def test_blocks_meet_without_a_shuffle(spark, rows):
    """Blocks that are exploded for each other move with the square of the table."""
    vectors = rows.repartition(5).select(F.col("vec_id").alias("id"), "v")
    balls = vectors.withColumn("radius", F.lit(0.7))
    near, within = edges_below(vectors, 0.7, 3), neighbours_within(vectors, balls, 3).filter("a < b")
    assert {(r.a, r.b) for r in near.collect()} == {(r.a, r.b) for r in within.collect()}
    for df in (near, within):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_odd_vectors_have_no_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1e-3, 70000.0]), (8, [0.0, -3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.a, r.b) for r in edges_below(df, 0.5).collect()] == [(1, 2)]


def test_forests_keep_components_and_drop_cycles(spark):
    links = [(a, b) for a in range(40) for b in range(a)] + [(50, 51), (60, 60)]
    kept = [tuple(r) for r in forests(spark.createDataFrame(links, "u int, v int").repartition(2)).collect()]
    assert len(kept) <= 2 * 40 + 1 and {frozenset(x) for x in kept if x[0] >= 50} == {frozenset((50, 51))}
    found = components(spark.createDataFrame(kept, "u long, v long"), Workspace(spark, "test"))
    assert {tuple(r) for r in found.collect()} == {(a, 0) for a in range(1, 40)} | {(51, 50)}


@pytest.mark.parametrize("part_links", [3, 250_000])
def test_components_equal_union_find(spark, part_links, monkeypatch):
    from tidemark.operators import components as module

    monkeypatch.setattr(module, "PART_LINKS", part_links)
    r = random.Random(5)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(links, "u long, v long").repartition(4), Workspace(spark, "test"))
    assert {x.node: x.component for x in found.collect()} == {x: root(x) for x in parent if root(x) != x}


def lowest_reached(rows, limit):
    """Brute force: the lowest id that each one leads to by pairs of rows below limit."""
    label = {i: i for i, _ in rows}
    good = [(i, v) for i, v in rows if v and any(v) and not any(map(math.isnan, v))]
    links = [(i, j) for i, v in good for j, w in good if i < j and cosine(v, w) < limit]
    for _ in label:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("block,limit", [(1, 0.15), (2, 0.3), (5, 0.2), (1024, 0.2), (1, 0.7)])
def test_near_components_equal_brute_force(spark, block, limit, monkeypatch):
    """In groups of one block to all; ids that lie in several groups, copies, odd vectors and a chain are among the rows."""
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity, "FILE_BLOCKS", 3)
    monkeypatch.setattr(similarity.groups_below, "__defaults__", (block,))
    rows = [(i, v) for i, _, v in noise(70, 4, seed=block)] + [(200 + i, v) for i, _, v in noise(9, 4, seed=block)]
    rows += [(7, [0.1, -1.0, 0.2, 0.0]), (68, [-0.3, 0.1, -1.0, 0.5]), (300, None), (301, []), (302, [0.0] * 4), (303, [float("nan"), 1.0, 0.0, 0.0])]
    rows += [(400 + i, [math.cos(i / 5), math.sin(i / 5), 9.0, 0.0]) for i in range(30)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    found = proto.label_near(df.select("id"), df, limit).collect()
    assert len(found) == len(rows) and {(r.id, r.cluster_id) for r in found} == set(lowest_reached(rows, limit).items())


def test_near_components_of_nothing_and_of_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [2.0, 0.1]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert sorted(map(tuple, proto.label_near(df.select("id"), df, 0.5).collect()), key=str) == [(2, 2), (4, 2), (None, None)]
    assert proto.label_near(df.select("id").filter("false"), df.filter("false"), 0.5).count() == 0


@pytest.mark.parametrize("name", ["q13b_residual", "q26_count_retention", "q40_birth_log", "q43_erase_documents"])
def test_links_that_clusters_write_are_fewer_than_vectors(spark, name, tmp_path, monkeypatch):
    """Each task that compares parts of a table passed on a link for each of its vectors."""
    from tidemark import catalog

    rows = [(i, [float(x) for x in v], i % 3) for i, _, v in noise(1200, 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    written = []
    monkeypatch.setattr(proto, "components", lambda links, work: (written.append(links.count()), components(links, work))[1])
    catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert written and max(written) < len(rows)


def test_births_need_more_than_check(spark):
    members = spark.createDataFrame([(i, c) for c, n in ((1, 10), (2, 11), (3, 12)) for i in range(n)], "id long, cluster_id long")
    assert {r.cluster_id for r in proto.births(members, 10).collect()} == {2, 3}
    assert proto.erase(members, proto.births(members, 10)).count() == 10


def test_two_means_degenerate(spark):
    same = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [1.0, 0.0]), (3, 8, [0.0, 1.0])], "vec_id long, topic_id long, v array<double>")
    parts = T.two_means(same).collect()
    assert {(r.vec_id, r.part) for r in parts} == {(1, 1), (2, 1), (3, 1)}
    alike = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [2.0, 0.0])], "vec_id long, topic_id long, v array<double>")
    assert {(r.vec_id, r.part) for r in T.two_means(alike).collect()} == {(1, 2), (2, 2)}
    assert T.pivots_of(same, T.two_means(same)).count() == 2


def test_average_linkage_equals_mean_of_pairs(spark, rows):
    data = noise(40)
    got = {(r.topic_a, r.topic_b): r.dist for r in T.average_linkage(rows.withColumnRenamed("vec_id", "pivot_id")).collect()}
    for (a, b), d in got.items():
        pairs = [cosine(x, y) for _, s, x in data for _, t, y in data if s == a and t == b]
        assert d == pytest.approx(sum(pairs) / len(pairs))
    part = T.average_linkage(rows.withColumnRenamed("vec_id", "pivot_id"), spark.createDataFrame([(2,)], "topic_id long")).collect()
    assert {(r.topic_a, r.topic_b) for r in part} == {(0, 2), (1, 2)}


def test_refresh_equals_full_ranking(spark):
    r = random.Random(2)
    old = [(d, t, r.random()) for d in range(6) for t in range(8)]
    new = [(d, t, r.random()) for d in range(6) for t in (1, 3, 9)]
    schema = "doc_id long, topic_id long, dist double"
    now = [(d, t, x) for d, t, x in old if t not in (1, 3)] + new
    full = subscriptions.rank_all(spark.createDataFrame(now, schema), 4)
    inc = subscriptions.refresh(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), 4)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, inc.collect()))


def test_multisets(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c"]), (2, [], ["x"])], "k long, l array<string>, r array<string>")
    assert sorted(map(tuple, multiset.intersection(df, "k", "l", "r").collect())) == [(1, "a", 1)]
    assert sorted(map(tuple, multiset.difference(df, "k", "l", "r").collect())) == [(1, "a", 1), (1, "b", 1)]


def test_tokens_are_counted_where_they_lie(spark):
    """Tokens were exploded and shuffled, with a row for each bucket of each text; rows of one id still count together."""
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["b"]), (2, ["c"]), (3, []), (4, None)], "doc_id long, tokens array<string>")
    found = token_counts(df)
    true = {1: [(97, 2.0), (98, 2.0)], 2: [(99, 1.0)]}
    byte = {c: int(hashlib.md5(chr(c).encode()).hexdigest()[:2], 16) for c in (97, 98, 99)}
    assert {r.doc_id: {k: n for k, n in enumerate(r.v) if n} for r in found.collect()} == {i: {byte[c]: n for c, n in cells} for i, cells in true.items()}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_multisets_move_arrays_once_by_key(spark):
    """Rows of one key count together, whatever their batch; before, elements were shuffled one by one and joined."""
    rows = [(k % 7, ["a", "b", "a"][: k % 4], ["a", None, f"x{k}"]) for k in range(300)] + [(None, ["q"], ["q"]), (9, None, ["a"])]
    df = spark.createDataFrame(rows, "k long, l array<string>, r array<string>").repartition(3)
    both, more = Counter(), Counter()
    left, right = (Counter((r[0], x) for r in rows for x in r[side] or []) for side in (1, 2))
    for (k, x), n in left.items():
        m = right[k, x] if k is not None and x is not None else 0
        both[k, x], more[k, x] = min(n, m), n - m
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = multiset.intersection(df, "k", "l", "r"), multiset.difference(df, "k", "l", "r")
        for df, true in zip(found, (both, more), strict=True):
            assert {(r.k, r.x): r.n for r in df.collect()} == {at: n for at, n in true.items() if n > 0}
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression [k") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nmi_bounds(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 10) for i in range(12)], "a long, b long")
    assert metrics.normalised_mutual_information(same, "a", "b").first()[0] == pytest.approx(1)
    apart = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(8)], "a long, b long")
    assert metrics.normalised_mutual_information(apart, "a", "b").first()[0] == pytest.approx(0, abs=1e-12)
    assert len(metrics.refined((0.66, 0.76))) == 25 and (0.9, 0.5) not in metrics.grid([0.9], [0.5, 0.9])


def test_ticks_over_blocks(spark):
    seq = spark.createDataFrame([(i, i % 3 == 0) for i in range(50)], "seq long, matched boolean")
    got = {r.seq: r.tick for r in T.ticks(seq, block=7).collect()}
    assert got == {i: i // 3 + 1 for i in range(50)}


def test_paired_files_stop_at_the_shorter(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\nc\nd e f\n")
    (tmp_path / "v.csv").write_text("1,2\n3,bad,4\n")
    got = read_paired(spark, str(tmp_path / "t.txt"), str(tmp_path / "v.csv")).orderBy("seq").collect()
    assert [(r.doc_id, r.seq, r.tokens, r.v) for r in got] == [(1, 0, ["a", "b"], [1.0, 2.0]), (2, 1, ["c"], [3.0, 4.0])]
    with pytest.raises(Exception):
        read_paired(spark, str(tmp_path / "none"), str(tmp_path / "v.csv")).collect()
    with pytest.raises(ValueError, match="3 texts and 2 vectors"):
        read_paired(spark, str(tmp_path / "t.txt"), str(tmp_path / "v.csv"), strict=True)


def test_lines_of_several_files_and_parts_are_in_order(spark, tmp_path):
    lines, at = [f"line {i} " + "x" * (i % 50) for i in range(900)], 0
    for k, n in enumerate((5, 800, 1, 0, 94)):  # parts of unlike sizes
        (tmp_path / f"part-{k}.txt").write_text("".join(x + "\n" for x in lines[at : at + n]))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbered_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == list(enumerate(lines))


def test_blocks_by_number_and_bytes(spark):
    from tidemark.config import Settings
    from tidemark.operators import distances

    rows = spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(10)], "pivot_id long, topic_id long, v array<double>")
    assert distances.blocks_for(rows, Settings()) == 1 and distances.blocks_for(rows.limit(0), Settings()) == 1
    assert distances.blocks_for(rows, Settings(broadcast_pivots=10)) == 1 and distances.blocks_for(rows, Settings(broadcast_pivots=9)) == 2
    assert distances.blocks_for(rows, Settings(broadcast_bytes=160)) == 1 and distances.blocks_for(rows, Settings(broadcast_bytes=159)) == 2
    docs = rows.select((rows.pivot_id + 100).alias("doc_id"), "v")
    small, large = ({(r.doc_id, r.pivot_id, round(r.dist, 9)) for r in distances.pivot_pairs(docs, rows, s).collect()} for s in (Settings(), Settings(broadcast_bytes=50)))
    assert small == large and len(small) == 100
    centers = rows.selectExpr("pivot_id AS cluster_id", "v", "0.5D AS radius")
    near = [{(r.doc_id, r.cluster_id) for r in distances.within_radius(docs, centers, F.col("radius"), s).collect()} for s in (Settings(), Settings(broadcast_bytes=50))]
    assert near[0] == near[1] and len(near[0]) > 10


def test_erased_documents_leave_their_clusters_a_new_first_one(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (3, 3), (4, 4)], "id long, cluster_id long")
    gone = spark.createDataFrame([(1,), (3,), (9,)], "id long")
    assert {tuple(r) for r in proto.erase_documents(members, gone).select("id", "cluster_id").collect()} == {(2, 2), (5, 2), (4, 4)}


def test_a_search_refines_around_its_best_settings(spark):
    tried = []

    def measure(alpha, beta):
        tried.append((alpha, beta))
        return 1 - abs(alpha - 0.66), 1 - abs(beta - 0.76), 1.0  # equal times: none counts

    got = metrics.grid_search(spark, measure, [0.6, 0.7, 0.9], [0.7, 0.8], step=0.02, width=2).collect()
    assert [(r.alpha, r.beta) for r in got] == tried and (0.9, 0.7) not in tried and len(tried) == 5 + 25
    assert all(r.norm_time == 0 for r in got)
    best = max((r for r in got if r.stage == 2), key=lambda r: r.score)
    assert (best.alpha, best.beta, best.score) == (0.66, 0.76, 1.0)
    assert metrics.grid_search(spark, measure, [], []).count() == 0


def test_products_in_single_precision_lose_no_pair():
    from tidemark.operators import similarity

    rng = np.random.default_rng(3)
    a = rng.integers(0, 5, size=(300, 16)).astype(np.float64)
    a = np.concatenate([a, a[:40] * 3, np.zeros((2, 16))])
    with np.errstate(invalid="ignore"):
        unit = a / np.sqrt((a**2).sum(axis=1, keepdims=True))
    dist = 1 - unit @ unit.T
    for limit in (0.05, 0.9, float(dist[0, 1]), np.where(np.arange(len(a)) % 2, 0.1, 0.3)):
        i, j, d = (np.concatenate(c) for c in zip(*similarity.close(unit, unit, limit), strict=True))
        near = np.abs(dist - limit) > 1e-12
        assert {(x, y) for x, y in zip(i, j) if near[x, y]} == {(x, y) for x, y in zip(*np.nonzero(dist < limit)) if near[x, y]}
        assert np.abs(d - dist[i, j]).max() < 1e-12
