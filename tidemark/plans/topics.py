"""Queries of the topic engine over whole tables.

Embeddings are both the documents (or subscriptions) and, by label, the
topics; a topic's pivots are its six oldest vectors. A vector is not compared
with itself. The thresholds are ones at which these tables give results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import parse_floats, tokens
from ..functions.vectors import angle, as_doubles, combined_norm_distance, cosine_distance, half_angle_radius, join_limit, merge_limit, midpoint, norm, squared_l2
from ..operators import distances as D
from ..operators import metrics, multiset, proto, reports, subscriptions
from ..operators import topics as T
from ..operators import thresholds as H
from ..operators.arrivals import arrivals
from ..operators.diameter import wide_pairs
from ..operators.pivot_index import PivotIndex
from ..operators.similarity import edges_below
from ..operators.topic_graph import TopicGraph
from ..sources import lines
from ..sources.paired import document_vectors, documents, pair_lines, vectors
from ..storage import Workspace
from .registry import query

SETTINGS = Settings(dim=64, beta=1.5, k=3)
EDGE = 0.60
TEXT_EDGE = 0.05
CHECK = 3
RADIUS = 0.87
MERGE_BELOW = 0.99

# Parts that the SQL of several queries starts with.
E = "E AS (SELECT vec_id, label::BIGINT AS topic_id, embedding::DOUBLE[] AS v FROM embeddings)"
P = "P AS (SELECT vec_id AS pivot_id, topic_id, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY vec_id) AS rk FROM E) WHERE rk <= 6)"
X = "X AS (SELECT e.vec_id AS doc_id, p.topic_id, p.pivot_id, 1 - list_cosine_similarity(e.v, p.v) AS dist FROM E e JOIN P p ON e.vec_id <> p.pivot_id)"
R = "R AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, topic_id ORDER BY dist, pivot_id) AS rk FROM X)"
L = "L AS (SELECT doc_id, topic_id, SUM(dist) AS dist FROM R WHERE rk <= 2 GROUP BY doc_id, topic_id HAVING COUNT(*) = 2)"
BEST = "B AS (SELECT doc_id, topic_id, dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dist, topic_id) AS rk FROM L) WHERE rk = 1)"
MATCH = "M AS (SELECT doc_id, CASE WHEN dist < 1.5 THEN topic_id ELSE -1 END AS topic_id, dist FROM B)"
EDGES = "G AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM E a JOIN E b ON a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.v, b.v) < 0.6)"
TF = r"""W AS (SELECT doc_id, UNNEST([x FOR x IN REGEXP_SPLIT_TO_ARRAY(text, '[ \t\n\r\x0B\f]+') IF x <> '']) AS w FROM documents),
C AS (SELECT doc_id, ('0x' || SUBSTR(MD5(w), 1, 2))::INT AS b, COUNT(*)::DOUBLE AS n FROM W GROUP BY ALL),
N AS (SELECT doc_id, SQRT(SUM(n * n)) AS norm FROM C GROUP BY doc_id),
V AS (SELECT k.doc_id, k.b, COALESCE(c.n, 0) AS n FROM (SELECT N.doc_id, r.b FROM N, (SELECT UNNEST(RANGE(256)) AS b) r) k LEFT JOIN C c ON c.doc_id = k.doc_id AND c.b = k.b),
A AS (SELECT doc_id, LIST(n ORDER BY b) AS v FROM V GROUP BY doc_id),
H AS (SELECT x.doc_id AS a, y.doc_id AS b, 1 - list_cosine_similarity(x.v, y.v) AS dist FROM A x JOIN A y ON x.doc_id < y.doc_id WHERE 1 - list_cosine_similarity(x.v, y.v) < 0.05)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "v")


def _pivots(spark: SparkSession, d: str) -> DataFrame:
    return T.first_pivots(vectors(spark, d), SETTINGS.max_pivots)


def _pairs(spark: SparkSession, d: str, measure=None) -> DataFrame:
    return D.pivot_pairs(_docs(spark, d), _pivots(spark, d), SETTINGS, measure)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return D.pair_distances(_pairs(spark, d))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return D.match(_docs(spark, d), _scored(spark, d), SETTINGS.beta)


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("q01_cosine_pairs", with_(E, P, X) + "SELECT doc_id, topic_id, pivot_id, ROUND(dist, 6) AS dist FROM X")
def cosine_pairs(spark, d):
    return _pairs(spark, d).select("doc_id", "topic_id", "pivot_id", _r("dist"))


@query("q02_l2sqr_pairs", with_(E, P) + "SELECT e.vec_id AS doc_id, p.pivot_id, ROUND(list_distance(e.v, p.v) ** 2, 6) AS dist FROM E e JOIN P p ON e.vec_id <> p.pivot_id")
def l2sqr_pairs(spark, d):
    return _pairs(spark, d, squared_l2).select("doc_id", "pivot_id", _r("dist"))


@query("q02b_combined_norm", with_(E, P) + "SELECT e.vec_id AS doc_id, p.pivot_id, ROUND(1 - list_dot_product(e.v, p.v) / (list_dot_product(e.v, e.v) + list_dot_product(p.v, p.v)), 6) AS dist FROM E e JOIN P p ON e.vec_id <> p.pivot_id")
def combined_norm(spark, d):
    return _pairs(spark, d, combined_norm_distance).select("doc_id", "pivot_id", _r("dist"))


@query("q03_localpair", with_(E, P, X, R, L) + "SELECT doc_id, topic_id, ROUND(dist, 6) AS dist FROM L")
def localpair(spark, d):
    return _scored(spark, d).select("doc_id", "topic_id", _r("dist"))


@query("q03b_localpair_missing", with_(E, "P AS (SELECT vec_id AS pivot_id, topic_id, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY vec_id) AS rk FROM E) WHERE rk <= 1 + topic_id % 2)", X, R) + "SELECT doc_id, topic_id, ROUND(SUM(dist) + CASE WHEN COUNT(*) < 2 THEN 1e6 ELSE 0 END, 6) AS dist FROM R WHERE rk <= 2 GROUP BY ALL")
def localpair_missing(spark, d):
    """Topics of one or two pivots: the missing second one counts as 1e6."""
    order = Window.partitionBy("topic_id").orderBy("vec_id")
    few = vectors(spark, d).withColumn("rk", F.row_number().over(order)).filter("rk <= 1 + topic_id % 2").select(F.col("vec_id").alias("pivot_id"), "topic_id", "v")
    return D.pair_distances_or(D.pivot_pairs(_docs(spark, d), few, SETTINGS), SETTINGS.no_distance).select("doc_id", "topic_id", _r("dist"))


@query("q03c_member_distance", with_(E, P, X, R) + "SELECT doc_id, topic_id, ROUND(AVG(dist), 6) AS dist FROM R WHERE rk <= 2 GROUP BY ALL")
def member_distance(spark, d):
    return D.member_distances(_pairs(spark, d)).select("doc_id", "topic_id", _r("dist"))


@query("q04_single_distance", with_(E, P, X) + "SELECT doc_id, topic_id, ROUND(2 * dist, 6) AS dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dist, topic_id, pivot_id) AS rk FROM X) WHERE rk = 1")
def single_distance(spark, d):
    return D.single_distances(_pairs(spark, d)).select("doc_id", "topic_id", _r("dist"))


@query("q05_publish_match", with_(E, P, X, R, L, BEST, MATCH) + "SELECT doc_id, topic_id, ROUND(dist, 6) AS dist FROM M")
def publish_match(spark, d):
    return _matched(spark, d).select("doc_id", "topic_id", _r("dist"))


@query("q06_fmr", with_(E, P, X, R, L, BEST, MATCH) + "SELECT COUNT(*) AS n_docs, SUM((topic_id >= 0)::INT)::BIGINT AS n_matched, ROUND(AVG((topic_id >= 0)::INT), 6) AS fmr FROM M")
def fmr(spark, d):
    return metrics.first_match_rate(_matched(spark, d)).select("n_docs", "n_matched", _r("fmr"))


TOP = "K AS (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dist, topic_id) AS rank, topic_id, dist FROM L)"


@query("q07_topk_topics", with_(E, P, X, R, L, TOP) + "SELECT doc_id, rank, topic_id, ROUND(dist, 6) AS dist FROM K WHERE rank <= 3")
def topk_topics(spark, d):
    return D.nearest_topics(_docs(spark, d), _pivots(spark, d), SETTINGS.k, SETTINGS).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q07b_topk_relational", with_(E, P, X, R, L, TOP) + "SELECT doc_id, rank, topic_id, ROUND(dist, 6) AS dist FROM K WHERE rank <= 3")
def topk_relational(spark, d):
    return D.top_topics(_scored(spark, d), SETTINGS.k).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q08_topk_limit", with_(E, P, X, R, L, TOP) + "SELECT doc_id, COUNT(*) AS n_topics, ROUND(CASE WHEN COUNT(*) < 3 THEN 1e6 ELSE MAX(dist) END, 6) AS top_limit FROM K WHERE rank <= 3 GROUP BY doc_id")
def topk_limit(spark, d):
    return D.top_limits(_scored(spark, d), SETTINGS.k, SETTINGS.no_distance).select("doc_id", "n_topics", _r("top_limit"))


@query("q08b_topk_limit_short", with_(E, P, X, R, L, TOP) + "SELECT doc_id, COUNT(*) AS n_topics, ROUND(CASE WHEN COUNT(*) < 12 THEN 1e6 ELSE MAX(dist) END, 6) AS top_limit FROM K WHERE rank <= 12 GROUP BY doc_id")
def topk_limit_short(spark, d):
    """More topics wanted than there are."""
    return D.top_limits(_scored(spark, d), 12, SETTINGS.no_distance).select("doc_id", "n_topics", _r("top_limit"))


CENTERS = """Z AS (SELECT topic_id, LIST(x ORDER BY pos) AS v, MAX(n) AS members FROM (SELECT topic_id, pos, SUM(x) AS x, COUNT(*) AS n FROM
  (SELECT topic_id, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS pos FROM E) GROUP BY topic_id, pos) GROUP BY topic_id)"""


@query("q09_radius_candidates", with_(E, CENTERS) + "SELECT e.vec_id AS doc_id, z.topic_id AS cluster_id, ROUND(1 - list_cosine_similarity(e.v, z.v), 6) AS dist FROM E e, Z z WHERE 1 - list_cosine_similarity(e.v, z.v) < 0.87")
def radius_candidates(spark, d):
    centers = T.centers(vectors(spark, d)).withColumn("radius", F.lit(RADIUS))
    return D.within_radius(_docs(spark, d), centers, F.col("radius")).select("doc_id", "cluster_id", _r("dist"))


@query("q10_adaptive_limits", "SELECT label::BIGINT AS topic_id, COUNT(*) AS members, ROUND(0.66 / (LN(1 + COUNT(*)) + 1), 6) AS join_limit, ROUND(0.66 / (LN(COUNT(*)) + 1), 6) AS merge_limit FROM embeddings GROUP BY label")
def adaptive_limits(spark, d):
    sizes = vectors(spark, d).groupBy("topic_id").agg(F.count("*").alias("members"))
    n = F.col("members")
    return sizes.select("topic_id", "members", F.round(join_limit(n, SETTINGS.alpha), 6).alias("join_limit"), F.round(merge_limit(n, SETTINGS.alpha), 6).alias("merge_limit"))


@query("q10b_angles", with_(E, P, X) + "SELECT doc_id, pivot_id, ROUND(ACOS(GREATEST(-1, LEAST(1, 1 - dist))), 6) AS angle, ROUND(1 - COS(ACOS(GREATEST(-1, LEAST(1, 1 - dist))) / 2), 6) AS half_radius FROM X")
def angles(spark, d):
    x = F.col("dist")
    return _pairs(spark, d).select("doc_id", "pivot_id", F.round(angle(x), 6).alias("angle"), F.round(half_angle_radius(x), 6).alias("half_radius"))


def _edges(spark, d):
    return edges_below(vectors(spark, d).select(F.col("vec_id").alias("id"), "v"), EDGE)


@query("q11_local_edges", with_(E, EDGES) + "SELECT a, b, ROUND(dist, 6) AS dist FROM G")
def local_edges(spark, d):
    return _edges(spark, d).select("a", "b", _r("dist"))


@query("q11b_text_edges", with_(TF) + "SELECT a, b, ROUND(dist, 6) AS dist FROM H")
def text_edges(spark, d):
    return edges_below(document_vectors(spark, d).select(F.col("doc_id").alias("id"), "v"), TEXT_EDGE).select("a", "b", _r("dist"))


def _reach(nodes: str, edges: str) -> str:
    return f"""S AS (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}),
Q AS (SELECT {nodes} AS id, {nodes} AS r FROM NODES UNION SELECT Q.id, S.y FROM Q JOIN S ON S.x = Q.r),
O AS (SELECT id, MIN(r) AS cluster_id FROM Q GROUP BY id)"""


COMPONENTS = "WITH RECURSIVE " + ",\n".join([E, EDGES, "NODES AS (SELECT vec_id FROM E)", _reach("vec_id", "G")]) + "\n"


def _clusters(spark, d):
    rows = vectors(spark, d).select(F.col("vec_id").alias("id"), "v")
    return proto.label_near(rows, rows, EDGE)


@query("q12_components", COMPONENTS + "SELECT id, cluster_id FROM O")
def components(spark, d):
    return _clusters(spark, d)


@query("q13_births", COMPONENTS + "SELECT cluster_id, COUNT(*) AS members FROM O GROUP BY cluster_id HAVING COUNT(*) > 3")
def births(spark, d):
    return proto.births(_clusters(spark, d), CHECK)


@query("q13b_residual", COMPONENTS + "SELECT id, cluster_id FROM O WHERE cluster_id NOT IN (SELECT cluster_id FROM O GROUP BY cluster_id HAVING COUNT(*) > 3)")
def residual(spark, d):
    members = _clusters(spark, d)
    return proto.erase(members, proto.births(members, CHECK)).select("id", "cluster_id")


def _two_means_sql() -> str:
    parts = [E, """D AS (SELECT topic_id, v, MIN(vec_id) AS vec_id FROM E GROUP BY topic_id, v),
S1 AS (SELECT topic_id, part, v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY vec_id) AS part FROM D) WHERE part <= 2)"""]
    for k in (1, 2, 3):
        parts.append(f"""A{k} AS (SELECT e.vec_id, e.topic_id, e.v, CASE WHEN a.v IS NULL AND b.v IS NOT NULL OR list_cosine_similarity(e.v, b.v) >= list_cosine_similarity(e.v, a.v) THEN 2 ELSE 1 END AS part
  FROM E e LEFT JOIN S{k} a ON a.topic_id = e.topic_id AND a.part = 1 LEFT JOIN S{k} b ON b.topic_id = e.topic_id AND b.part = 2),
S{k + 1} AS (SELECT topic_id, part, LIST(x ORDER BY pos) AS v FROM (SELECT topic_id, part, pos, SUM(x) AS x FROM
  (SELECT topic_id, part, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS pos FROM A{k}) GROUP BY topic_id, part, pos) GROUP BY topic_id, part)""")
    return with_(*parts)


@query("q14_two_means", _two_means_sql() + "SELECT vec_id, topic_id, part::BIGINT AS part FROM A3")
def two_means(spark, d):
    return T.two_means(vectors(spark, d))


@query("q14b_generated_pivots", _two_means_sql() + "SELECT m.pivot_id, s.topic_id, ROUND(SQRT(list_dot_product(s.v, s.v)), 6) AS norm FROM S4 s JOIN (SELECT topic_id, part, MIN(vec_id) AS pivot_id FROM A3 GROUP BY ALL) m ON m.topic_id = s.topic_id AND m.part = s.part")
def generated_pivots(spark, d):
    rows = vectors(spark, d)
    return T.pivots_of(rows, T.two_means(rows)).select("pivot_id", "topic_id", F.round(norm(F.col("v")), 6).alias("norm"))


LINK = "A AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, AVG(1 - list_cosine_similarity(a.v, b.v)) AS dist FROM P a JOIN P b ON a.topic_id < b.topic_id GROUP BY ALL)"
NEAREST = "N AS (SELECT topic_id, nearest, dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY dist, nearest) AS rk FROM (SELECT topic_a AS topic_id, topic_b AS nearest, dist FROM A UNION ALL SELECT topic_b, topic_a, dist FROM A)) WHERE rk = 1)"
SURVIVORS = "U AS (SELECT GREATEST(topic_id, nearest) AS topic_id, MIN(LEAST(topic_id, nearest)) AS survivor FROM N WHERE dist < 0.99 GROUP BY 1)"


@query("q15_avg_linkage", with_(E, P, LINK) + "SELECT topic_a, topic_b, ROUND(dist, 6) AS dist FROM A")
def avg_linkage(spark, d):
    return T.average_linkage(_pivots(spark, d)).select("topic_a", "topic_b", _r("dist"))


def _nearest(spark, d):
    sizes = vectors(spark, d).groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    return T.nearest_other(T.average_linkage(_pivots(spark, d)), sizes, SETTINGS.alpha)


@query("q16_nearest_topic", with_(E, P, LINK, NEAREST) + "SELECT N.topic_id, nearest, ROUND(dist, 6) AS dist, ROUND(0.66 / (LN(n) + 1), 6) AS merge_limit FROM N JOIN (SELECT topic_id, COUNT(*) AS n FROM E GROUP BY topic_id) s ON s.topic_id = N.topic_id")
def nearest_topic(spark, d):
    return _nearest(spark, d).select("topic_id", "nearest", _r("dist"), _r("merge_limit"))


def _mapping(spark, d):
    return T.merge_map(_nearest(spark, d).filter(F.col("dist") < MERGE_BELOW))


@query("q17_merge_apply", with_(E, P, LINK, NEAREST, SURVIVORS) + "SELECT COALESCE(survivor, E.topic_id) AS topic_id, COUNT(*) AS n_docs, COUNT(P.pivot_id) AS n_pivots FROM E LEFT JOIN U ON U.topic_id = E.topic_id LEFT JOIN P ON P.pivot_id = E.vec_id GROUP BY 1")
def merge_apply(spark, d):
    mapping = _mapping(spark, d)
    docs = T.remapped(vectors(spark, d).select("vec_id", "topic_id"), mapping).groupBy("topic_id").agg(F.count("*").alias("n_docs"))
    pivots = T.remapped(_pivots(spark, d).select("pivot_id", "topic_id"), mapping).groupBy("topic_id").agg(F.count("*").alias("n_pivots"))
    return docs.join(pivots, "topic_id", "left").select("topic_id", "n_docs", F.coalesce("n_pivots", F.lit(0)).alias("n_pivots"))


@query("q18_pivot_report", with_(E, P) + "SELECT a.topic_id, a.pivot_id AS pivot_a, b.pivot_id AS pivot_b, ROUND(1 - list_cosine_similarity(a.v, b.v), 6) + 0.0 AS dist FROM P a JOIN P b ON a.topic_id = b.topic_id")
def pivot_report(spark, d):
    return T.pivot_report(_pivots(spark, d)).select("topic_id", "pivot_a", "pivot_b", (F.round("dist", 6) + 0.0).alias("dist"))


@query("q18b_pivot_counts", with_(E, P) + "SELECT E.topic_id, COUNT(DISTINCT P.pivot_id) AS n_pivots FROM E LEFT JOIN P ON P.topic_id = E.topic_id GROUP BY 1")
def pivot_counts(spark, d):
    return T.pivot_counts(vectors(spark, d), _pivots(spark, d))


TOKENS = r"T AS (SELECT doc_id, source, [x FOR x IN REGEXP_SPLIT_TO_ARRAY(text, '[ \t\n\r\x0B\f]+') IF x <> ''] AS tokens FROM documents)"


@query("q19_topic_dump", with_(TOKENS) + "SELECT source AS topic_id, COUNT(*) AS n_docs, COUNT(DISTINCT tokens) AS distinct_texts FROM T GROUP BY source")
def topic_dump(spark, d):
    return T.topic_dump(documents(spark, d).select(F.col("source").alias("topic_id"), "tokens"))


@query("q19b_may_have_pivots", with_(TOKENS) + "SELECT source AS topic_id, COUNT(DISTINCT tokens) AS distinct_texts FROM T GROUP BY source HAVING COUNT(DISTINCT tokens) > 3")
def may_have_pivots(spark, d):
    return T.may_have_pivots(documents(spark, d).select(F.col("source").alias("topic_id"), "tokens"), SETTINGS.distinct_texts)


@query("q20_tokenize", with_(TOKENS) + "SELECT doc_id, LEN(tokens)::BIGINT AS n_tokens, MD5(ARRAY_TO_STRING(tokens, ' ')) AS digest FROM T")
def tokenize(spark, d):
    return documents(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("q20b_term_frequencies", with_(TF.split(",\nN AS")[0]) + "SELECT doc_id, b::BIGINT AS bucket, n::BIGINT AS n FROM C")
def term_frequencies(spark, d):
    cells = document_vectors(spark, d).select("doc_id", F.posexplode("v").alias("bucket", "n"))
    return cells.filter("n > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"))


@query("q21_parse_floats", "WITH C AS (SELECT vec_id, STRING_SPLIT(ARRAY_TO_STRING([ROUND(x::DOUBLE, 4)::VARCHAR FOR x IN embedding], ',') || ',bad', ',') AS cells FROM embeddings), T AS (SELECT vec_id, [TRY_CAST(x AS FLOAT)::DOUBLE FOR x IN cells IF TRY_CAST(x AS FLOAT) IS NOT NULL] AS v FROM C) SELECT vec_id, LEN(v)::BIGINT AS n, ROUND(LIST_SUM(v), 4) AS total FROM T")
def parse(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    line = F.concat(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), ","), F.lit(",bad"))
    v = rows.select("vec_id", as_doubles(parse_floats(line)).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# Each document with the next one of its source, so that all documents take part.
NEXT = "Y AS (SELECT doc_id, tokens AS l, LEAD(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS r FROM T)"
BAGS = "Y1 AS (SELECT doc_id, x, COUNT(*) AS n FROM (SELECT doc_id, UNNEST(l) AS x FROM Y WHERE r IS NOT NULL) GROUP BY ALL), Y2 AS (SELECT doc_id, x, COUNT(*) AS m FROM (SELECT doc_id, UNNEST(r) AS x FROM Y WHERE r IS NOT NULL) GROUP BY ALL)"


def _next(spark, d):
    """(doc_id, l, r): texts, which are moved as they are and become tokens afterwards: arrays of tokens are several times larger."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    following = F.lead("text").over(Window.partitionBy("source").orderBy("doc_id")).alias("r")
    return rows.select("doc_id", F.col("text").alias("l"), following).filter("r IS NOT NULL")


@query("q22_multiset_intersection", with_(TOKENS, NEXT, BAGS) + "SELECT doc_id, x, LEAST(n, m) AS n FROM Y1 JOIN Y2 USING (doc_id, x)")
def multiset_intersection(spark, d):
    return multiset.intersection(_next(spark, d), "doc_id", tokens(F.col("l")), tokens(F.col("r")))


@query("q23_multiset_difference", with_(TOKENS, NEXT, BAGS) + "SELECT doc_id, x, n - COALESCE(m, 0) AS n FROM Y1 LEFT JOIN Y2 USING (doc_id, x) WHERE n > COALESCE(m, 0)")
def multiset_difference(spark, d):
    return multiset.difference(_next(spark, d), "doc_id", tokens(F.col("l")), tokens(F.col("r")))


@query("q24_decay_expiry", with_(E, P) + ", Q AS (SELECT topic_id, pivot_id, POW(2, -0.2 * ((SELECT MAX(vec_id) FROM E) - pivot_id * 7)) AS score FROM P) SELECT topic_id, pivot_id, ROUND(score, 12) AS score, score < 1e-10 AS expired, MIN((score < 1e-10)::INT) OVER (PARTITION BY topic_id) = 1 AS topic_expired FROM Q")
def decay_expiry(spark, d):
    now = vectors(spark, d).agg(F.max("vec_id").alias("now"))
    pivots = _pivots(spark, d).select("topic_id", "pivot_id", (F.col("pivot_id") * 7).alias("last_tick")).join(F.broadcast(now))
    out = T.expired(pivots, F.col("now"), 0.2, SETTINGS.min_keep)
    return out.select("topic_id", "pivot_id", _r("score", 12), "expired", "topic_expired")


@query("q25_ticks", with_(E, P, X, R, L, BEST, MATCH) + "SELECT doc_id AS seq, topic_id >= 0 AS matched, (SUM((topic_id >= 0)::INT) OVER (ORDER BY doc_id))::BIGINT AS tick FROM M")
def ticks(spark, d):
    rows = _matched(spark, d).select(F.col("doc_id").alias("seq"), (F.col("topic_id") >= 0).alias("matched"))
    return T.ticks(rows).select("seq", "matched", "tick")


@query("q25b_last_update", with_(E, P, X, R, L, BEST, MATCH) + ", K AS (SELECT doc_id, topic_id, SUM((topic_id >= 0)::INT) OVER (ORDER BY doc_id) AS tick FROM M), F AS (SELECT doc_id, pivot_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dist, pivot_id) AS rk FROM X) WHERE rk = 1) SELECT pivot_id, MAX(tick)::BIGINT AS last_tick FROM K JOIN F USING (doc_id) WHERE topic_id >= 0 GROUP BY pivot_id")
def last_update(spark, d):
    """A match touches the globally nearest pivot, whatever its topic."""
    rows = _matched(spark, d).select(F.col("doc_id").alias("seq"), (F.col("topic_id") >= 0).alias("matched"))
    touched = _pairs(spark, d).groupBy("doc_id").agg(F.min(F.struct("dist", "pivot_id")).alias("b")).select("doc_id", "b.pivot_id")
    return T.ticks(rows).filter("matched").join(touched, F.col("seq") == F.col("doc_id")).groupBy("pivot_id").agg(F.max("tick").alias("last_tick"))


@query("q26_count_retention", COMPONENTS + "SELECT id, cluster_id FROM O WHERE cluster_id NOT IN (SELECT cluster_id FROM O GROUP BY cluster_id HAVING MIN(id) <= (SELECT MAX(id) FROM O) - 300)")
def count_retention(spark, d):
    return proto.retained(_clusters(spark, d), "id", 300).select("id", "cluster_id")


@query("q27_reshape_topk", with_(E, P, X, R, L) + "SELECT doc_id, rank, topic_id, ROUND(dist, 6) AS dist FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dist, topic_id) AS rank, topic_id, dist FROM L WHERE topic_id <> 0) WHERE rank <= 3")
def reshape_topk(spark, d):
    removed = spark.createDataFrame([(0,)], "topic_id long")
    return subscriptions.without_topics(_scored(spark, d), removed, SETTINGS.k).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q28_incremental_topk", with_(E, P, X, R, L, TOP) + "SELECT doc_id, rank, topic_id, ROUND(dist, 6) AS dist FROM K WHERE rank <= 3")
def incremental_topk(spark, d):
    """Odd topics have changed: their old distances are void, and the refreshed ranking equals the full one."""
    pivots = _pivots(spark, d)
    stale = _scored(spark, d).withColumn("dist", F.when(F.col("topic_id") % 2 == 1, F.lit(0.0)).otherwise(F.col("dist")))
    changed = D.pair_distances(D.pivot_pairs(_docs(spark, d), pivots.filter("topic_id % 2 = 1"), SETTINGS))
    return subscriptions.refresh(stale, changed, SETTINGS.k).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q29_flush_assign", with_(E, P, X, R, L, BEST) + "SELECT doc_id, CASE WHEN dist < 100 THEN topic_id ELSE -1 END AS topic_id, ROUND(dist, 6) AS dist FROM B")
def flush_assign(spark, d):
    return D.match(_docs(spark, d), _scored(spark, d), SETTINGS.flush_beta).select("doc_id", "topic_id", _r("dist"))


NMI = """J AS (SELECT E.topic_id AS l, M.topic_id AS c, COUNT(*)::DOUBLE AS n FROM E JOIN M ON M.doc_id = E.vec_id GROUP BY ALL),
JT AS (SELECT SUM(n) AS t FROM J), JL AS (SELECT l, SUM(n) AS n FROM J GROUP BY l), JC AS (SELECT c, SUM(n) AS n FROM J GROUP BY c),
JM AS (SELECT SUM(J.n / t * LN(J.n * t / (JL.n * JC.n))) AS mi FROM J JOIN JL ON JL.l = J.l JOIN JC ON JC.c = J.c, JT),
HL AS (SELECT -SUM(n / t * LN(n / t)) AS h FROM JL, JT), HC AS (SELECT -SUM(n / t * LN(n / t)) AS h FROM JC, JT)"""


@query("q30_nmi", with_(E, P, X, R, L, BEST, MATCH, NMI) + "SELECT ROUND(CASE WHEN HL.h + HC.h = 0 THEN 1 ELSE mi / ((HL.h + HC.h) / 2) END, 6) AS nmi FROM JM, HL, HC")
def nmi(spark, d):
    rows = _matched(spark, d).join(vectors(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("topic_id").alias("label")), "doc_id")
    return metrics.normalised_mutual_information(rows, "label", "topic_id").select(_r("nmi"))


# Published results of five settings (alpha, beta, nmi, fmr, seconds).
GRID = [(0.62, 0.74, 0.873, 0.812, 21.5), (0.64, 0.76, 0.878, 0.825, 20.9), (0.66, 0.76, 0.881, 0.831, 21.1), (0.68, 0.76, 0.879, 0.827, 22.0), (0.70, 0.78, 0.877, 0.816, 22.4)]
_GRID_SQL = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {n}::DOUBLE, {f}::DOUBLE, {s}::DOUBLE)" for a, b, n, f, s in GRID) + ") g(alpha, beta, nmi, fmr, seconds)"


@query("q31_score", f"SELECT alpha, beta, ROUND((seconds - MIN(seconds) OVER ()) / (MAX(seconds) OVER () - MIN(seconds) OVER ()), 6) AS norm_time, ROUND(nmi * fmr * (1 - (seconds - MIN(seconds) OVER ()) / (MAX(seconds) OVER () - MIN(seconds) OVER ())), 6) AS score FROM {_GRID_SQL}")
def score(spark, d):
    rows = spark.createDataFrame(GRID, "alpha double, beta double, nmi double, fmr double, seconds double")
    rows = rows.withColumn("norm_time", metrics.normalised_time(F.col("seconds")))
    return rows.select("alpha", "beta", _r("norm_time"), F.round(metrics.score(F.col("nmi"), F.col("fmr"), F.col("norm_time")), 6).alias("score"))


@query("q32_mode_switch", "SELECT seq, kind, row FROM (SELECT vec_id AS seq, CASE WHEN vec_id < 200 THEN 'subscribe' ELSE 'publish' END AS kind, CASE WHEN vec_id < 200 THEN vec_id ELSE vec_id - 200 + 1 END AS row FROM embeddings)")
def mode_switch(spark, d):
    """After 200 subscriptions the stream goes on as publications, from row 1 of the table."""
    first = Settings(subscriptions=200)
    return arrivals(vectors(spark, d).select(F.col("vec_id").alias("seq")), first).select("seq", "kind", "row")


@query("q33_text_dedup", with_(TOKENS) + "SELECT source, MIN(doc_id) AS first_doc, COUNT(*) AS copies FROM T GROUP BY source, tokens")
def text_dedup(spark, d):
    return multiset.distinct_texts(documents(spark, d), "source").select("source", "first_doc", "copies")


@query("q33b_merged_texts", with_(TOKENS, "F AS (SELECT REPLACE(source, 'src', '')::BIGINT AS topic_id, tokens, MIN(doc_id) % 2 AS flag FROM T GROUP BY 1, 2), Z AS (SELECT topic_id // 2 * 2 AS target, topic_id, tokens, flag FROM F)") + "SELECT target AS topic_id, COUNT(*) AS n_texts, SUM(flag)::BIGINT AS flags FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target, tokens ORDER BY topic_id) AS rk FROM Z) WHERE rk = 1 GROUP BY target")
def merged_texts(spark, d):
    """Each odd source joins the even one before it; of equal texts the survivor's flag stays."""
    rows = documents(spark, d).select(F.regexp_replace("source", "src", "").cast("long").alias("topic_id"), "tokens", "doc_id")
    texts = rows.groupBy("topic_id", "tokens").agg((F.min("doc_id") % 2).alias("flag"))
    mapping = texts.select("topic_id").distinct().filter("topic_id % 2 = 1").select("topic_id", (F.col("topic_id") - 1).alias("survivor"))
    return T.merged_texts(texts, mapping).groupBy("topic_id").agg(F.count("*").alias("n_texts"), F.sum("flag").alias("flags"))


@query("q34_inverse_topk", with_(E, P, X, R, L) + "SELECT topic_id, rank, doc_id, ROUND(dist, 6) AS dist FROM (SELECT topic_id, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY dist, doc_id) AS rank, doc_id, dist FROM L) WHERE rank <= 10")
def inverse_topk(spark, d):
    return D.inverse_top(_scored(spark, d), 10).select("topic_id", "rank", "doc_id", _r("dist"))


@query("q35_farthest_pair", with_(E, P) + ", F AS (SELECT a.topic_id AS cluster_id, a.pivot_id AS a, b.pivot_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM P a JOIN P b ON a.topic_id = b.topic_id AND a.pivot_id < b.pivot_id) SELECT cluster_id, a, b, ROUND(dist, 6) AS dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY dist DESC, a, b) AS rk FROM F) WHERE rk = 1")
def farthest_pair(spark, d):
    pairs = T.pivot_report(_pivots(spark, d)).filter("pivot_a < pivot_b").select(F.col("topic_id").alias("cluster_id"), F.col("pivot_a").alias("a"), F.col("pivot_b").alias("b"), "dist")
    return proto.farthest_pair(pairs).select("cluster_id", "a", "b", _r("dist"))


@query("q36_new_pivots", with_(E, P) + ", Y AS (SELECT e.vec_id AS doc_id, e.topic_id, MIN(1 - list_cosine_similarity(e.v, p.v)) AS dist FROM E e JOIN P p ON p.topic_id = e.topic_id AND p.pivot_id <> e.vec_id GROUP BY ALL) SELECT doc_id, topic_id, ROUND(dist, 6) AS dist FROM Y WHERE dist > 0.75")
def new_pivots(spark, d):
    """Membership forced by label: documents far from all pivots of their own topic become pivots."""
    own = _pairs(spark, d).join(vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "topic_id"), ["doc_id", "topic_id"])
    return T.new_pivots(own, SETTINGS.beta).select("doc_id", "topic_id", _r("dist"))


@query("q37_join_clusters", with_(E, P, X, R) + ", H AS (SELECT doc_id, topic_id, AVG(dist) AS dist FROM R WHERE rk <= 2 GROUP BY ALL), Y AS (SELECT H.doc_id, H.topic_id FROM H JOIN (SELECT topic_id, COUNT(*) AS m FROM P GROUP BY 1) s USING (topic_id) WHERE dist < 2.1 / (LN(1 + m) + 1)) SELECT doc_id, MIN(topic_id) AS topic_id, COUNT(*) - 1 AS merged FROM Y GROUP BY doc_id")
def join_clusters(spark, d):
    """Documents join the lowest accepted cluster, which takes in the others."""
    wide = Settings(alpha=2.1)
    sizes = _pivots(spark, d).groupBy("topic_id").agg(F.count("*").alias("members"))
    return proto.assign_lowest(proto.accepted(D.member_distances(_pairs(spark, d)), sizes, wide))


@query("q38_merged_balls", with_(E, P) + ", F AS (SELECT a.topic_id, a.pivot_id AS a, b.pivot_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS dist, [(s[1] + s[2]) / 2 FOR s IN LIST_ZIP(a.v, b.v)] AS m FROM P a JOIN P b ON a.topic_id = b.topic_id AND a.pivot_id < b.pivot_id) SELECT topic_id, a, b, ROUND(CASE WHEN 2 * ACOS(1 - 0.3) + ACOS(1 - dist) > 2 * 1.5 THEN 0.3 ELSE 1 - COS(LEAST(ACOS(1 - 0.3) + ACOS(1 - dist), PI())) END, 6) AS radius, ROUND(SQRT(list_dot_product(m, m)), 6) AS center_norm, ROUND(CASE WHEN ACOS(1 - 0.3) < ACOS(1 - dist) + ACOS(1 - 1.5 / (LN(1 + 20) + 1)) THEN 0.303 ELSE 0.3 END, 6)::DOUBLE AS grown FROM F")
def merged_balls(spark, d):
    rows = _pivots(spark, d).withColumn("n", norm(F.col("v")))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.topic_id") == F.col("b.topic_id")) & (F.col("a.pivot_id") < F.col("b.pivot_id")))
    dist = cosine_distance(F.col("a.v"), F.col("b.v"), F.col("a.n"), F.col("b.n"))
    rows = pairs.select(F.col("a.topic_id").alias("topic_id"), F.col("a.pivot_id").alias("a"), F.col("b.pivot_id").alias("b"), dist.alias("dist"), midpoint(F.col("a.v"), F.col("b.v")).alias("m"))
    r, alpha = F.lit(0.3), 1.5
    return rows.select("topic_id", "a", "b", F.round(proto.merged_radius(r, r, F.col("dist"), alpha), 6).alias("radius"), F.round(norm(F.col("m")), 6).alias("center_norm"), F.round(proto.inflated(r, F.col("dist"), F.lit(20), alpha), 6).alias("grown"))


_GROWN = "0.66 / (LN(2) + 1)"


@query("q39_cluster_report", COMPONENTS + f"SELECT cluster_id, ROUND({_GROWN} * CASE WHEN MIN(label) % 2 = 0 THEN 1.01 ELSE 1 END, 6) AS radius, COUNT(*) AS members FROM O JOIN embeddings e ON e.vec_id = O.cluster_id GROUP BY cluster_id")
def cluster_report(spark, d):
    """Clusters that an even label's vector has founded have grown once; the others are not in the table of radii."""
    grown = vectors(spark, d).filter("topic_id % 2 = 0").select(F.col("vec_id").alias("cluster_id"), F.lit(SETTINGS.first_radius * 1.01).alias("radius"))
    return reports.cluster_report(_clusters(spark, d), SETTINGS, grown).select("cluster_id", _r("radius"), "members")


@query("q40_birth_log", COMPONENTS + ", N AS (SELECT cluster_id, ROW_NUMBER() OVER (ORDER BY cluster_id) - 1 AS topic_id FROM O GROUP BY cluster_id HAVING COUNT(*) > 3) SELECT topic_id, N.cluster_id, COUNT(*) AS members, MIN(id) AS first_doc, MAX(id) AS last_doc FROM N JOIN O ON O.cluster_id = N.cluster_id GROUP BY ALL")
def birth_log(spark, d):
    members = _clusters(spark, d)
    born = proto.births(members, CHECK).select("cluster_id", (F.row_number().over(Window.orderBy("cluster_id")) - 1).cast("long").alias("topic_id"))
    return reports.birth_log(born, members)


@query("q41_topic_lines", with_(TOKENS) + "SELECT source AS topic_id, MAX(doc_id % 2) || ' : ' || ARRAY_TO_STRING(tokens, ' ') AS line FROM T GROUP BY source, tokens")
def topic_lines(spark, d):
    return reports.text_lines(documents(spark, d).select(F.col("source").alias("topic_id"), "tokens", (F.col("doc_id") % 2).alias("flag")))


_PAIRED = """
WITH N AS (SELECT ROW_NUMBER() OVER (ORDER BY vec_id) AS doc_id, 'topic ' || label || '  of ' || vec_id AS line,
  [ROUND(x::DOUBLE, 4)::FLOAT::DOUBLE FOR x IN embedding] AS v FROM embeddings)
SELECT doc_id, doc_id - 1 AS seq, MD5(REPLACE(line, '  ', ' ')) AS digest, LEN(v)::BIGINT AS n, ROUND(LIST_SUM(v), 4) AS total FROM N
"""


@query("q42_paired_files", _PAIRED)
def paired_files(spark, d):
    """Texts and vectors in line-aligned files, text and CSV, written from the table by several tasks and read by byte ranges."""
    path = Workspace(spark, "paired-files").path
    cells = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), ",")
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    lines.write_aligned(rows.select("vec_id", F.concat(F.lit("topic "), "label", F.lit("  of "), "vec_id").alias("texts"), F.concat(cells, F.lit(",bad")).alias("vectors")), "vec_id", path, 8)
    out = pair_lines(lines.numbered(spark, f"{path}/texts"), lines.numbered(spark, f"{path}/vectors", 1 << 16), 64)
    return out.select("doc_id", "seq", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"), F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("q43_erase_documents", COMPONENTS + "SELECT id, MIN(id) OVER (PARTITION BY cluster_id) AS cluster_id FROM O WHERE id % 3 <> 0")
def erase_documents(spark, d):
    """Every third document is taken out of its cluster."""
    members = _clusters(spark, d)
    return proto.erase_documents(members, members.filter("id % 3 = 0")).select("id", "cluster_id")


@query("q44_residual_match", COMPONENTS.rstrip() + ",\n" + ",\n".join([P, X, R, L, BEST, MATCH]) + " SELECT doc_id, topic_id, ROUND(dist, 6) AS dist FROM M WHERE doc_id IN (SELECT id FROM O WHERE cluster_id NOT IN (SELECT cluster_id FROM O GROUP BY cluster_id HAVING COUNT(*) > 3))")
def residual_match(spark, d):
    """Documents that still wait are matched with the topics that there are."""
    members = _clusters(spark, d)
    waiting = proto.erase(members, proto.births(members, CHECK)).select(F.col("id").alias("doc_id"))
    docs = _docs(spark, d).join(waiting, "doc_id")
    return D.match(docs, D.pair_distances(D.pivot_pairs(docs, _pivots(spark, d), SETTINGS)), SETTINGS.beta).select("doc_id", "topic_id", _r("dist"))


ALPHAS, BETAS = [0.6, 0.7], [1.4, 1.5, 1.6]
_SEARCH = with_(E, P, X, R, L, BEST) + """, GB AS (SELECT UNNEST([1.4, 1.5, 1.6])::DOUBLE AS beta), GA AS (SELECT UNNEST([0.6, 0.7])::DOUBLE AS alpha),
M AS (SELECT beta, doc_id, CASE WHEN dist < beta THEN topic_id ELSE -1 END AS topic_id FROM B, GB),
J AS (SELECT beta, E.topic_id AS l, M.topic_id AS c, COUNT(*)::DOUBLE AS n FROM E JOIN M ON M.doc_id = E.vec_id GROUP BY ALL),
JT AS (SELECT beta, SUM(n) AS t FROM J GROUP BY 1), JL AS (SELECT beta, l, SUM(n) AS n FROM J GROUP BY 1, 2), JC AS (SELECT beta, c, SUM(n) AS n FROM J GROUP BY 1, 2),
JM AS (SELECT J.beta, SUM(J.n / t * LN(J.n * t / (JL.n * JC.n))) AS mi FROM J JOIN JL ON JL.beta = J.beta AND JL.l = J.l JOIN JC ON JC.beta = J.beta AND JC.c = J.c JOIN JT ON JT.beta = J.beta GROUP BY 1),
HL AS (SELECT JL.beta, -SUM(n / t * LN(n / t)) AS h FROM JL JOIN JT USING (beta) GROUP BY 1), HC AS (SELECT JC.beta, -SUM(n / t * LN(n / t)) AS h FROM JC JOIN JT USING (beta) GROUP BY 1),
S AS (SELECT M.beta, AVG((topic_id >= 0)::INT) AS fmr, SUM((topic_id < 0)::INT)::DOUBLE AS time FROM M GROUP BY 1),
Z AS (SELECT alpha, S.beta, CASE WHEN HL.h + HC.h = 0 THEN 1 ELSE mi / ((HL.h + HC.h) / 2) END AS nmi, fmr, time FROM GA, S JOIN JM ON JM.beta = S.beta JOIN HL ON HL.beta = S.beta JOIN HC ON HC.beta = S.beta),
N AS (SELECT *, (time - MIN(time) OVER ()) / (MAX(time) OVER () - MIN(time) OVER ()) AS norm_time FROM Z)
SELECT alpha, beta, ROUND(nmi, 6) AS nmi, ROUND(fmr, 6) AS fmr, time, ROUND(norm_time, 6) AS norm_time, ROUND(nmi * fmr * (1 - norm_time), 6) AS score FROM N"""


@query("q45_grid_search", _SEARCH.replace("\n, GB", ", GB"))
def grid_search(spark, d):
    """The first stage of a search over matches. Documents without a topic, which need a second round, stand for the time."""
    labels = vectors(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("topic_id").alias("label"))
    best = Workspace(spark, "grid-search").table(D.best_topic(_scored(spark, d)).join(labels, "doc_id"), "best")
    found = {}

    def measure(alpha: float, beta: float) -> tuple[float, float, float]:
        if beta not in found:
            rows = best.withColumn("topic_id", F.when(F.col("dist") < beta, F.col("topic_id")).otherwise(F.lit(-1)))
            rate = metrics.first_match_rate(rows).first()
            found[beta] = metrics.normalised_mutual_information(rows, "label", "topic_id").first()["nmi"], rate["fmr"], rate["n_docs"] - rate["n_matched"]
        return found[beta]

    return metrics.searched(spark, measure, metrics.grid(ALPHAS, BETAS)).select("alpha", "beta", _r("nmi"), _r("fmr"), "time", _r("norm_time"), _r("score"))


@query("q46_pruned_topk", with_(E, P, X, R, L, TOP) + "SELECT doc_id, rank, topic_id, ROUND(dist, 6) AS dist FROM K WHERE rank <= 3 AND doc_id % 20 = 0")
def pruned_topk(spark, d):
    """Subscriptions, each the rows whose id 20 divides, ranked over topics in order of their balls' bounds."""
    return D.nearest_topics(_docs(spark, d).filter("doc_id % 20 = 0"), _pivots(spark, d), SETTINGS.k, SETTINGS).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q47_entering_topics", with_(E, P, X, R, L).rstrip() + """,
S AS (SELECT doc_id, topic_id, dist FROM L WHERE doc_id % 20 = 0),
T AS (SELECT doc_id, CASE WHEN COUNT(*) = 3 THEN MAX(dist) END AS worst FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY dist, topic_id) AS rk FROM S WHERE topic_id % 2 = 0) WHERE rk <= 3 GROUP BY doc_id)
SELECT doc_id, rank, topic_id, ROUND(dist, 6) AS dist FROM (SELECT S.*, ROW_NUMBER() OVER (PARTITION BY S.doc_id ORDER BY dist, topic_id) AS rank FROM S LEFT JOIN T ON T.doc_id = S.doc_id WHERE topic_id % 2 = 1 AND (worst IS NULL OR dist < worst)) WHERE rank <= 3""")
def entering(spark, d):
    """Odd topics are new: the ones that enter the subscriptions' rankings over even topics, each found by its limit."""
    subs, pivots = _docs(spark, d).filter("doc_id % 20 = 0"), _pivots(spark, d)
    known = D.nearest_topics(subs, pivots.filter("topic_id % 2 = 0"), SETTINGS.k, SETTINGS)
    limits = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("dist").alias("worst")).select("doc_id", F.when(F.col("n") == SETTINGS.k, F.col("worst")).alias("top_limit"))
    return D.entering_topics(subs.join(limits, "doc_id", "left"), pivots.filter("topic_id % 2 = 1"), SETTINGS.k, SETTINGS).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q48_indexed_topk")
def indexed_topk(spark, d):
    """q07 by the walk through the pivots' index: half of the pivots are built in, the others inserted. Without SQL, as a search
    may miss topics; tests hold it against q05 and q07."""
    index, pivots = PivotIndex(spark, SETTINGS.dim, SETTINGS), _pivots(spark, d)
    index.build(pivots.filter("pivot_id % 2 = 0"))
    index.insert(pivots.filter("pivot_id % 2 = 1"))
    return index.nearest_topics(_docs(spark, d), SETTINGS.k).select("doc_id", "rank", "topic_id", _r("dist"))


@query("q49_wide_pairs", with_(E, """S AS (SELECT topic_id, sweep, ARG_MIN(vec_id, MD5(sweep || '/' || vec_id)) AS f FROM E, (SELECT UNNEST(RANGE(5)) AS sweep) GROUP BY ALL),
A AS (SELECT S.topic_id, sweep, e.vec_id AS f, ROW_NUMBER() OVER (PARTITION BY S.topic_id, sweep ORDER BY 1 - list_cosine_similarity(e.v, x.v) DESC, e.vec_id) AS rk FROM S JOIN E x ON x.vec_id = f JOIN E e ON e.topic_id = S.topic_id AND e.vec_id <> f),
B AS (SELECT A.topic_id, LEAST(f, e.vec_id) AS a, GREATEST(f, e.vec_id) AS b, 1 - list_cosine_similarity(e.v, x.v) AS dist FROM A JOIN E x ON x.vec_id = f JOIN E e ON e.topic_id = A.topic_id AND e.vec_id <> f WHERE rk = 1)""") + "SELECT topic_id AS cluster_id, a, b, ROUND(dist, 6) AS dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY dist DESC, a, b) AS rk FROM B) WHERE rk = 1")
def swept_pairs(spark, d):
    """The widest pair of each label by five double sweeps."""
    return wide_pairs(vectors(spark, d).select(F.col("topic_id").alias("cluster_id"), F.col("vec_id").alias("id"), "v")).select("cluster_id", "a", "b", _r("dist"))


CUTS, STEP = [0.9, 0.95, 1.0], 0.02  #: scales of single-linkage cuts, and the step of the finer ones
_ALL_EDGES = "G AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM E a JOIN E b ON a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.v, b.v) < 0.65)"


def _cuts_sql(k: str) -> str:
    """O{k} (alpha, id, cluster_id): the clusters of each alpha of A{k}."""
    return f"""S{k} AS (SELECT alpha, a AS x, b AS y FROM G, A{k} WHERE dist < alpha / (LN(2) + 1) UNION SELECT alpha, b, a FROM G, A{k} WHERE dist < alpha / (LN(2) + 1)),
Q{k} AS (SELECT alpha, vec_id AS id, vec_id AS r FROM E, A{k} UNION SELECT Q{k}.alpha, Q{k}.id, S{k}.y FROM Q{k} JOIN S{k} ON S{k}.alpha = Q{k}.alpha AND S{k}.x = Q{k}.r),
O{k} AS (SELECT alpha, id, MIN(r) AS cluster_id FROM Q{k} GROUP BY ALL)"""


def _scored_sql(k: str) -> str:
    """Z{k}: the scores of all settings of A{k} and B{k}."""
    return f"""{_cuts_sql(k)},
M{k} AS (SELECT O{k}.alpha, beta, E.topic_id AS l, CASE WHEN B.dist < beta THEN 't' || B.topic_id WHEN m > 3 THEN 'c' || O{k}.cluster_id ELSE '-' END AS c, COALESCE(B.dist < beta, FALSE)::INT AS hit
  FROM O{k} JOIN (SELECT alpha, cluster_id, COUNT(*) AS m FROM O{k} GROUP BY ALL) z ON z.alpha = O{k}.alpha AND z.cluster_id = O{k}.cluster_id JOIN E ON E.vec_id = O{k}.id JOIN B{k} ON TRUE LEFT JOIN B ON B.doc_id = E.vec_id),
J{k} AS (SELECT alpha, beta, l, c, COUNT(*)::DOUBLE AS n FROM M{k} GROUP BY ALL),
JL{k} AS (SELECT alpha, beta, l, SUM(n) AS n FROM J{k} GROUP BY ALL), JC{k} AS (SELECT alpha, beta, c, SUM(n) AS n FROM J{k} GROUP BY ALL),
JT{k} AS (SELECT alpha, beta, COUNT(*)::DOUBLE AS t, AVG(hit) AS fmr, SUM(1 - hit)::DOUBLE AS time FROM M{k} GROUP BY ALL),
MI{k} AS (SELECT alpha, beta, SUM(J{k}.n / t * LN(J{k}.n * t / (JL{k}.n * JC{k}.n))) AS mi FROM J{k} JOIN JL{k} USING (alpha, beta, l) JOIN JC{k} USING (alpha, beta, c) JOIN JT{k} USING (alpha, beta) GROUP BY ALL),
HL{k} AS (SELECT alpha, beta, -SUM(n / t * LN(n / t)) AS hl FROM JL{k} JOIN JT{k} USING (alpha, beta) GROUP BY ALL), HC{k} AS (SELECT alpha, beta, -SUM(n / t * LN(n / t)) AS hc FROM JC{k} JOIN JT{k} USING (alpha, beta) GROUP BY ALL),
N{k} AS (SELECT alpha, beta, CASE WHEN hl + hc = 0 THEN 1 ELSE mi / ((hl + hc) / 2) END AS nmi, fmr, time, COALESCE((time - MIN(time) OVER ()) / NULLIF(MAX(time) OVER () - MIN(time) OVER (), 0), 0) AS norm_time FROM MI{k} JOIN HL{k} USING (alpha, beta) JOIN HC{k} USING (alpha, beta) JOIN JT{k} USING (alpha, beta)),
Z{k} AS (SELECT *, nmi * fmr * (1 - norm_time) AS score FROM N{k})"""


_FIRST = "A1 AS (SELECT UNNEST([0.9, 0.95, 1.0])::DOUBLE AS alpha), B1 AS (SELECT UNNEST([1.4, 1.5, 1.6])::DOUBLE AS beta)"
_SECOND = """T AS (SELECT alpha, beta FROM Z1 ORDER BY ROUND(score, 9) DESC, alpha, beta LIMIT 1),
A2 AS (SELECT ROUND(alpha + i * 0.02, 6) AS alpha FROM T, (SELECT UNNEST(RANGE(-2, 3)) AS i)), B2 AS (SELECT ROUND(beta + i * 0.02, 6) AS beta FROM T, (SELECT UNNEST(RANGE(-2, 3)) AS i))"""


def _forest(spark, d, work):
    """The spanning forest of the embeddings, up to the widest cut that either stage can ask for."""
    widest = Settings(alpha=CUTS[-1] + 2 * STEP).first_radius
    rows = vectors(spark, d).select(F.col("vec_id").alias("id"), "v")
    return rows.select("id"), H.spanning_forest(edges_below(rows, widest), work)


@query("q50_cuts", "WITH RECURSIVE " + ",\n".join([E, _ALL_EDGES, _FIRST, _cuts_sql("1")]) + " SELECT alpha, id, cluster_id FROM O1")
def threshold_cuts(spark, d):
    """Single-linkage clusters at the first radius of three scales, from one spanning forest."""
    work = Workspace(spark, "cuts")
    nodes, forest = _forest(spark, d, work)
    out = H.cuts(nodes, forest, [Settings(alpha=a).first_radius for a in CUTS], work)
    return out.select(F.element_at(F.array(*map(F.lit, CUTS)), F.col("at") + 1).alias("alpha"), "id", "cluster_id")


@query("q51_threshold_search", "WITH RECURSIVE " + ",\n".join([E, P, X, R, L, BEST, _ALL_EDGES, _FIRST, _scored_sql("1"), _SECOND, _scored_sql("2")]) + " SELECT stage, alpha, beta, ROUND(nmi, 6) AS nmi, ROUND(fmr, 6) AS fmr, time, ROUND(norm_time, 6) AS norm_time, ROUND(score, 6) AS score FROM (SELECT 1 AS stage, * FROM Z1 UNION ALL SELECT 2, * FROM Z2)")
def threshold_search(spark, d):
    """Both stages of a search over alpha, the scale of clusters, and beta, the limit of matches: one forest for all settings,
    one table of scores for each stage. Documents without a topic go to their cluster, and stand for the time."""
    work = Workspace(spark, "threshold-search")
    nodes, forest = _forest(spark, d, work)
    best = work.table(D.best_topic(_scored(spark, d)), "best")
    labels = vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("topic_id").alias("label"))
    cut = lambda alphas: H.cuts(nodes, forest, [Settings(alpha=a).first_radius for a in alphas], work)
    out = H.two_stages(cut, labels, best.withColumnRenamed("doc_id", "id"), CUTS, BETAS, CHECK, STEP, work)
    return out.select("stage", "alpha", "beta", _r("nmi"), _r("fmr"), "time", _r("norm_time"), _r("score"))


KEPT = "K AS (SELECT * FROM P WHERE pivot_id % 7 <> 0)"
_NEAR = "AVG(1 - list_cosine_similarity(a.v, b.v)) AS dist FROM {0} a JOIN {0} b ON a.topic_id <> b.topic_id GROUP BY ALL"


def _near_sql(k: int, pivots: str) -> str:
    """N{k}: the nearest topic of each topic of the table pivots, where it is nearer than 0.99."""
    return f"N{k} AS (SELECT topic_id, nearest, dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY dist, nearest) AS rk FROM (SELECT a.topic_id, b.topic_id AS nearest, {_NEAR.format(pivots)})) WHERE rk = 1 AND dist < 0.99)"


def _graph(spark, d) -> TopicGraph:
    """Pivots in two inserts, then every seventh id goes."""
    graph, pivots = TopicGraph(spark, SETTINGS.dim, MERGE_BELOW), _pivots(spark, d)
    graph.insert(pivots.filter("pivot_id % 2 = 0"))
    graph.insert(pivots.filter("pivot_id % 2 = 1"))
    graph.erase(pivots.filter("pivot_id % 7 = 0"))
    return graph


@query("q52_pivot_links", with_(E, P, KEPT) + "SELECT a.pivot_id AS a, b.pivot_id AS b, ROUND(1 - list_cosine_similarity(a.v, b.v), 6) AS dist FROM K a JOIN K b ON a.pivot_id <> b.pivot_id WHERE 1 - list_cosine_similarity(a.v, b.v) < 0.99")
def pivot_links(spark, d):
    """The graph's links, in both directions, after inserts and erasures."""
    return _graph(spark, d).table("link").select("a", "b", _r("dist"))


@query("q53_graph_merges", with_(E, P, KEPT, _near_sql(1, "K"), "U AS (SELECT GREATEST(topic_id, nearest) AS topic_id, MIN(LEAST(topic_id, nearest)) AS survivor FROM N1 GROUP BY 1)", "K2 AS (SELECT pivot_id, COALESCE(survivor, K.topic_id) AS topic_id, v FROM K LEFT JOIN U ON U.topic_id = K.topic_id)", _near_sql(2, "K2")) + "SELECT 1::BIGINT AS stage, topic_id, nearest, ROUND(dist, 6) AS dist FROM N1 UNION ALL SELECT 2::BIGINT, topic_id, nearest, ROUND(dist, 6) FROM N2")
def graph_merges(spark, d):
    """Each topic's nearest one by the graph after erasures, and again after the merges that follow."""
    graph, work = _graph(spark, d), Workspace(spark, "graph-merges")
    stage = lambda k, rows: rows.select(F.lit(k).cast("long").alias("stage"), "topic_id", "nearest", _r("dist"))
    first = work.table(graph.nearest(), "first")
    graph.merge(T.merge_map(first))
    return stage(1, first).union(stage(2, graph.nearest()))
