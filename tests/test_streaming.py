"""The streaming engine on a few hand-made vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import proto
from tidemark.operators import topics as T
from tidemark.storage import Workspace
from tidemark.streaming.engine import TopicStream

SCHEMA = "seq long, kind string, doc_id long, tokens array<string>, v array<double>"


def near(angle):
    return [math.cos(angle), math.sin(angle), 0.0]


def events():
    rows = [(i, "publish", i, [f"w{i}"], near(0.01 * i)) for i in range(6)]  # a cluster of six
    rows += [(6, "publish", 6, ["far"], [0.0, 0.0, 1.0]), (7, "subscribe", 900, [], near(0.0)), (8, "publish", 8, ["w8"], near(0.02))]
    return rows


@pytest.fixture(scope="module")
def engine(spark):
    e = TopicStream(spark, Settings(dim=3, check=4))
    rows = spark.createDataFrame(events(), SCHEMA)
    e.process(rows.filter("seq < 7"), 0)
    e.process(rows.filter("seq >= 7"), 1)
    return e


def test_birth_then_match(engine):
    topics = engine.table("topic").collect()
    assert [(t.topic_id, t.n_docs, t.has_pivots) for t in topics] == [(0, 7, True)]
    assert {r.doc_id for r in engine.table("assigned").collect()} == {0, 1, 2, 3, 4, 5, 8}
    assert [r.doc_id for r in engine.table("residual").collect()] == [6]
    assert engine.table("clock").first()["tick"] == 1


def test_subscription_sees_the_topic(engine):
    assert [(r.doc_id, r.topic_id, r.rank) for r in engine.table("top").collect()] == [(900, 0, 1)]


def test_flush_assigns_the_rest(engine):
    assert [tuple(r) for r in engine.flush().collect()] == [(6, 0)]


def test_a_batch_counts_once(spark, engine):
    before = engine.table("assigned").count()
    engine.process(spark.createDataFrame(events(), SCHEMA), 1)
    assert engine.table("assigned").count() == before


def test_empty_batch(spark):
    e = TopicStream(spark, Settings(dim=3))
    e.process(spark.createDataFrame([], SCHEMA), 0)
    assert e.table("topic").count() == 0 and e.flush().count() == 0


def test_progress_of_each_batch(spark):
    e = TopicStream(spark, Settings(dim=3, check=4))
    e.process(spark.createDataFrame(events()[:7], SCHEMA), 0)
    assert [{k: v for k, v in p.items() if k != "seconds"} for p in e.progress] == [{"batch_id": 0, "documents": 7, "matched": 0, "merged": 0, "expired": 0, "born": 1}]


def test_no_step_of_a_batch_has_a_large_plan(spark, monkeypatch):
    """The driver holds the plans of all steps, and the code that is made for them."""
    sizes, table = {}, Workspace.table

    def measured(self, df, name, **options):
        sizes[name] = max(sizes.get(name, 0), len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return table(self, df, name, **options)

    monkeypatch.setattr(Workspace, "table", measured)
    rows = [(i, "publish", i, [f"w{i}"], near(0.01 * i)) for i in range(6)]
    rows += [(i, "publish", i, [f"w{i}"], [0.0, math.sin(0.01 * i), math.cos(0.01 * i)]) for i in range(6, 12)]
    e = TopicStream(spark, Settings(dim=3, check=4))
    e.replay(spark.createDataFrame(rows, SCHEMA), 6)
    assert e.table("topic").count() == 2 and "fresh" in sizes
    assert max(sizes.values()) < 100, sizes


def test_a_replayed_batch_is_stored_once(spark, monkeypatch):
    names, table = [], Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name, **options: names.append((name, "tokens" in df.columns)) or table(self, df, name, **options))
    TopicStream(spark, Settings(dim=3, check=4)).replay(spark.createDataFrame(events(), SCHEMA), 100)
    assert [n for n, texts in names if texts] == ["all", "waiting"]


def test_topics_with_distinct_texts(spark):
    texts = spark.createDataFrame([(1, ["a", "b"]), (1, ["a b"]), (1, ["a", "b"]), (2, ["x"]), (2, ["x"]), (3, []), (3, None)], "topic_id long, tokens array<string>")
    assert sorted(tuple(r) for r in T.may_have_pivots(texts, 0).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_clusters_that_no_one_joins_are_forgotten(spark):
    e = TopicStream(spark, Settings(dim=3, check=4, retention=3))
    lone = [(i, "publish", i, ["x"], v) for i, v in enumerate([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0]])]
    e.process(spark.createDataFrame(lone, SCHEMA), 0)
    assert sorted(r.doc_id for r in e.table("residual").collect()) == [1, 2, 3]


def _distance(a, b):
    return 1 - a @ b / np.sqrt((a @ a) * (b @ b))


def _angle(d):
    return math.acos(min(1.0, max(-1.0, 1 - d)))


def _sequential(vectors, alpha):
    """The clusterer one document after the other, comparing everything: members, centers, radii."""
    members, center, radius = {}, {}, {}
    for i, v in enumerate(vectors):
        taken = {}
        for c in members:
            if _distance(v, center[c]) < radius[c]:
                near = sorted(_distance(v, vectors[j]) for j in members[c])[:2]
                if sum(near) / len(near) < alpha / (math.log(1 + len(members[c])) + 1):
                    taken[c] = near[0]
        if not taken:
            members[i], center[i], radius[i] = [i], v, alpha / (math.log(2) + 1)
            continue
        first, *others = sorted(taken)
        if not others and _angle(radius[first]) < _angle(taken[first]) + _angle(alpha / (math.log(1 + len(members[first])) + 1)):
            radius[first] *= 1.01
        for c in others:
            members[first] += members.pop(c)
            d, a, b = _angle(_distance(center[first], center[c])), _angle(radius[first]), _angle(radius.pop(c))
            other = center.pop(c)
            if a + b + d <= 2 * alpha:
                radius[first] = 1 - math.cos(max(min(a, b) + d, max(a, b)))
                center[first] = (center[first] + other) / 2
        members[first].append(i)
    return members, center, radius


def _added(spark, vectors, settings, bounds):
    work = Workspace(spark, "test")
    clusters = spark.createDataFrame([], "cluster_id long, v array<double>, radius double")
    members = spark.createDataFrame([], "id long, cluster_id long, v array<double>")
    everyone = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    for a, b in bounds:
        docs = everyone.filter((F.col("id") >= a) & (F.col("id") < b))
        now, clusters = proto.online_add(clusters, members, docs, settings, work)
        members = work.table(now.join(everyone, "id"), "state")
    return {r.id: r.cluster_id for r in members.collect()}, {r.cluster_id: r for r in clusters.collect()}


def test_one_document_a_time_is_the_sequential_clusterer(spark):
    # two clusters, a document that merges them, one that joins without a merge, one that founds a cluster, one more
    vectors = [np.array(near(a)) * (1 + i) for i, a in enumerate([0.0, 1.0, 0.5, 0.55, 2.6, 1.2])]
    members, center, radius = _sequential(vectors, 0.35)
    found, clusters = _added(spark, vectors, Settings(dim=3, alpha=0.35), [(i, i + 1) for i in range(len(vectors))])
    assert found == {i: c for c, ids in members.items() for i in ids}
    assert set(clusters) == set(center)
    for c, row in clusters.items():
        assert np.allclose(row.v, center[c]) and math.isclose(row.radius, radius[c], rel_tol=1e-9)


def test_balls_merge_only_while_they_stay_narrow(spark):
    rows = spark.createDataFrame([(0.3, 0.05), (0.3, 1.9)], "r double, dist double")
    r, dist = F.col("r"), F.col("dist")
    got = rows.select(proto.merged_radius(r, r, dist, 1.0), proto.merged_center(F.array(F.lit(0.0)), F.array(F.lit(2.0)), r, r, dist, 1.0), proto.inflated(r, dist, F.lit(9), 1.0)).collect()
    assert math.isclose(got[0][0], 1 - math.cos(_angle(0.3) + _angle(0.05)))
    assert got[0][1] == [1.0]
    assert (got[1][0], got[1][1]) == (0.3, [0.0]) and math.isclose(got[1][2], 0.303)


def test_documents_of_one_call_found_clusters_together(spark):
    vectors = [np.array(near(a)) for a in (0.0, 0.1, 0.2, 2.0, 2.1, 0.3)] + [np.zeros(3)]
    found, clusters = _added(spark, vectors, Settings(dim=3, alpha=0.35), [(0, 5), (5, 7)])
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 0, 6: 6}
    assert sorted(clusters) == [0, 3, 6]


def test_clusters_due_to_become_topics_have_no_center(spark):
    vectors = [np.array(near(0.01 * i)) for i in range(5)]
    found, clusters = _added(spark, vectors, Settings(dim=3, check=4), [(0, 5)])
    assert set(found.values()) == {0} and not clusters


def test_report_of_waiting_clusters_has_their_radii(spark):
    s = Settings(dim=3, alpha=0.35, check=9)
    e = TopicStream(spark, s)
    rows = [(i, "publish", i, [f"w{i}"], near(a)) for i, a in enumerate([0.0, 0.1, 2.0, 0.55])]
    e.process(spark.createDataFrame(rows[:3], SCHEMA), 0)
    e.process(spark.createDataFrame(rows[3:], SCHEMA), 1)
    got = {r.cluster_id: (r.radius, r.members) for r in e.clusters().collect()}
    clusters = {r.cluster_id: r.radius for r in e.table("cluster").collect()}
    assert {c: n for c, (_, n) in got.items()} == {0: 3, 2: 1}
    assert {c: r for c, (r, _) in got.items()} == clusters and clusters[0] > clusters[2] == s.first_radius


def test_command_line_reads_two_files(spark, tmp_path):
    from tidemark.__main__ import arguments, run

    vectors = [near(0.01 * i) for i in range(6)] + [near(0.0), near(0.02), [0.0, 0.0, 1.0]]
    (tmp_path / "t.txt").write_text("".join(f"word{i} of  it\n" for i in range(9)))
    (tmp_path / "v.csv").write_text("".join(",".join(map(str, v)) + "\n" for v in vectors))
    out = f"file://{tmp_path}/out"
    files = [str(tmp_path / "t.txt"), str(tmp_path / "v.csv"), out]
    engine = run(spark, arguments([*files, "--dim", "3", "--check", "4", "--batch", "6", "--subscriptions", "0"]))
    assert [p["born"] for p in engine.progress][0] == 1
    placed = {int(r.doc_id): int(r.topic_id) for r in spark.read.csv(f"{out}/assigned", header=True).collect()}
    assert set(placed.values()) == {0} and len(placed) >= 8
    assert any(r.value.endswith("word1 of it") for r in spark.read.text(f"{out}/topics").collect())


def test_versions_share_what_stays_and_grow_by_parts(spark, tmp_path, monkeypatch):
    from tidemark.streaming import state

    monkeypatch.setattr(state, "MOST_PARTS", 3)
    kept = state.Snapshots(spark, f"file://{tmp_path}/s")
    assert kept.parts(kept.latest()) == {} and kept.read("a", "x long").count() == 0
    row = lambda x: spark.createDataFrame([(x,)], "x long")
    for v in range(6):
        kept.write(v, kept.parts(kept.latest()), {"b": row(v)} if v in (0, 4) else {}, {"a": row(v)})
        assert sorted(r.x for r in kept.read("a", "x long").collect()) == list(range(v + 1))
        assert [r.x for r in kept.read("b", "x long").collect()] == [4 if v >= 4 else 0]
    assert kept.versions() == [4, 5]
    assert kept.parts(5) == {"a": ["v-3/a", "v-4/a", "v-5/a"], "b": ["v-4/b"]}
    assert kept.parts(4)["a"] == ["v-3/a", "v-4/a"]
    assert sorted(f.name for f in (tmp_path / "s").iterdir() if f.name.startswith("v-")) == ["v-3", "v-4", "v-5"]


def test_documents_of_one_call_list_no_more_links_than_documents(spark, monkeypatch):
    """All links of a dense group were listed, which grows with its square."""
    listed, label = [], proto.label_components
    monkeypatch.setattr(proto, "label_components", lambda nodes, edges: (listed.append(edges.count()), label(nodes, edges))[1])
    found, _ = _added(spark, [np.array(near(0.001 * i)) for i in range(60)], Settings(dim=3), [(0, 60)])
    assert set(found.values()) == {0} and listed[0] < 120
