"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licences

    out = scan_licences(_documents(spark, sf_dir))
    spans = F.transform("matches", lambda m: F.concat(m["licence"], F.lit("["), m["first"], F.lit(":"), m["end"], F.lit("]"), F.array_join(m["sentences"], "+")))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("licences", ",").alias("licences"), F.array_join(spans, " ").alias("spans"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_forest import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op3_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projection_passes import near_vectors

    ship(spark)
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_language import held_out, identify_language

    out = identify_language(_documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_automata import remove_repeats, removed_words

    out = remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), digest=True)
    return out.select("doc_id", "n_words", removed_words().alias("n_removed"), "kept_sha256")


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .template_extract import extract_main_text

    ship(spark)
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op8_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .isolation_rules import judge_quality

    out = judge_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_whole_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(_documents(spark, sf_dir))


def op10_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align_tokenizers

    return align_tokenizers(_documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import conversation_trie

    ship(spark)
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_sentences": op1_license_sentences,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_projection_passes": op3_projection_passes,
    "op4_crf_language": op4_crf_language,
    "op5_phrase_automata": op5_phrase_automata,
    "op6_water_filling": op6_water_filling,
    "op7_template_extract": op7_template_extract,
    "op8_isolation_rules": op8_isolation_rules,
    "op9_whole_token_count": op9_whole_token_count,
    "op10_hierarchical_packing": op10_hierarchical_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_winnowing": op13_winnowing,
}

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || SUBSTR(MD5('17:' || COALESCE(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS clamp,
    (ROW_NUMBER() OVER (ORDER BY ENCODE(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, clamp::DOUBLE / weight AS ratio,
    COALESCE(SUM(clamp) OVER (ORDER BY clamp::DOUBLE / weight, ENCODE(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    SUM(weight) OVER (ORDER BY clamp::DOUBLE / weight, ENCODE(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    SUM(source_size) OVER () AS total FROM w),
f AS (SELECT ratio, (total - spent)::DOUBLE AS rest, open::DOUBLE AS open FROM o
  WHERE (total - spent) * weight <= clamp * open ORDER BY ratio, rest LIMIT 1),
t AS (SELECT o.source, source_size, COALESCE(CASE WHEN o.ratio < f.ratio THEN clamp::DOUBLE
    ELSE LEAST(clamp::DOUBLE, f.rest * weight / f.open) END, 0.0) AS target FROM o LEFT JOIN f ON TRUE),
q AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT c.doc_id, c.size, q.source_size::BIGINT AS source_size, q.target,
  (c.size * (q.whole + CASE WHEN c.ahead + c.size / 2.0 <= q.target - q.whole * q.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
"""

_REACH = """
Q AS (SELECT {node} AS node, {node} AS r FROM {nodes} UNION SELECT Q.node, S.y FROM Q JOIN (SELECT a AS x, b AS y FROM L UNION SELECT b, a FROM L) S ON S.x = Q.r),
O AS (SELECT node, MIN(r) AS component_id FROM Q GROUP BY node)"""

OP2_SQL = (
    r"""
WITH RECURSIVE W AS (SELECT doc_id, COALESCE(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
S AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN LEN(w) >= 5 THEN [ARRAY_TO_STRING(w[i:i + 4], ' ') FOR i IN RANGE(1, LEN(w) - 3)] WHEN LEN(w) > 0 THEN [ARRAY_TO_STRING(w, ' ')] ELSE [] END) AS s FROM W),
N AS (SELECT W.doc_id, COUNT(S.s) AS n FROM W LEFT JOIN S ON S.doc_id = W.doc_id GROUP BY W.doc_id),
I AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS n FROM S x JOIN S y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
L AS (SELECT a, b FROM I JOIN N p ON p.doc_id = a JOIN N q ON q.doc_id = b WHERE 100 * I.n >= 75 * (p.n + q.n - I.n)),"""
    + _REACH.format(node="doc_id", nodes="N")
    + """
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM N JOIN O ON O.node = N.doc_id
"""
)

OP3_SQL = (
    r"""
WITH RECURSIVE E AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND LEN([x FOR x IN embedding IF x IS NULL OR NOT ISFINITE(x)]) = 0 AND LEN([x FOR x IN embedding IF x <> 0]) > 0),
L AS (SELECT x.vec_id AS a, y.vec_id AS b FROM E x JOIN E y ON x.vec_id < y.vec_id AND LEN(x.v) = LEN(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),"""
    + _REACH.format(node="vec_id", nodes="embeddings")
    + """
SELECT vec_id, COALESCE(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM O JOIN embeddings ON vec_id = node LEFT JOIN (SELECT node AS k, COUNT(*) AS n FROM (SELECT a AS node FROM L UNION ALL SELECT b FROM L) GROUP BY node) ON k = vec_id
"""
)

OP5_SQL = r"""
WITH W AS (SELECT doc_id, COALESCE(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
P AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(RANGE(1, LEN(w) + 1)) AS i FROM W),
T AS (SELECT doc_id, i, ARRAY_TO_STRING(w[i:i + 34], ' ') AS t FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 33)) AS i FROM W WHERE LEN(w) >= 35)),
D AS (SELECT t FROM T GROUP BY t HAVING COUNT(*) > 1),
R AS (SELECT T.doc_id, T.i, 1 AS r FROM T JOIN D ON D.t = T.t),
M AS (SELECT P.doc_id, P.i, P.word, COALESCE(MAX(r) OVER (PARTITION BY P.doc_id ORDER BY P.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM P LEFT JOIN R ON R.doc_id = P.doc_id AND R.i = P.i),
K AS (SELECT doc_id, SUM(gone)::BIGINT AS n_removed, STRING_AGG(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM M GROUP BY doc_id)
SELECT W.doc_id, LEN(w)::BIGINT AS n_words, COALESCE(n_removed, 0) AS n_removed, SHA256(COALESCE(kept, '')) AS kept_sha256 FROM W LEFT JOIN K ON K.doc_id = W.doc_id
"""

OP12_SQL = r"""
WITH T AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
G AS (SELECT *, SHA256(CONCAT(STRLEN(role)::VARCHAR, ':', role, text)) AS g FROM T),
C AS (SELECT conv_id, LIST({'g': g, 'b': STRLEN(text)} ORDER BY turn NULLS FIRST, g) AS w FROM G GROUP BY conv_id),
H AS (SELECT conv_id, w, LIST_REDUCE(LIST_PREPEND(4294967295::BIGINT, LIST_TRANSFORM(STR_SPLIT(conv_id::VARCHAR, ''), lambda c: ASCII(c)::BIGINT)), lambda x, y:
  LIST_REDUCE(LIST_PREPEND(XOR(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: XOR(p >> 1, 3988292384 * (p & 1)))) AS r FROM C),
R AS (SELECT H.conv_id, (XOR(r, 4294967295) % 9)::INT AS h, H.w, C.w AS o FROM H LEFT JOIN C ON C.conv_id = H.conv_id - H.conv_id % 5),
B AS (SELECT conv_id AS c, LIST_CONCAT(COALESCE(o[1:h], []), w[h + 1:]) AS s FROM R),
P AS (SELECT c, UNNEST(RANGE(0, LEN(s) + 1)) AS d, s FROM B),
N AS (SELECT c, d, LEN(s) = d AS ends, COALESCE(s[d].b, 0) AS b, MIN(c) OVER (PARTITION BY d, LIST_TRANSFORM(s[1:d], lambda x: x.g)) AS node FROM P),
K AS (SELECT node, d, COUNT(*) AS n, MAX(b) AS b, STRING_AGG(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends) AS e FROM N GROUP BY node, d),
U AS (SELECT K.*, N.node AS up FROM K LEFT JOIN N ON N.c = K.node AND N.d = K.d - 1),
L AS (SELECT up, d - 1 AS d, COUNT(*) AS children FROM U WHERE d > 0 GROUP BY ALL),
V AS (SELECT U.*, COALESCE(children, 0) AS children FROM U LEFT JOIN L ON L.up = U.node AND L.d = U.d),
S AS (SELECT N.node, N.d, SUM(CASE WHEN V.children = 0 THEN 1 ELSE 0 END) AS leaves, SUM((V.n - 1) * V.b) AS saved FROM V JOIN N ON N.c = V.node AND N.d <= V.d GROUP BY ALL)
SELECT V.node AS conv_id, V.d::BIGINT AS depth, V.up AS parent_conv_id, V.n AS n_convs, V.children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, SHA256(COALESCE(e, '')) AS ends_sha256
FROM V JOIN S ON S.node = V.node AND S.d = V.d
"""

OP13_SQL = r"""
WITH D AS (SELECT ROW_NUMBER() OVER () AS k, doc_id, COALESCE(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
I AS (SELECT item_id, REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
IW AS (SELECT DISTINCT item_id, LEN(x) AS n, ARRAY_TO_STRING(x, ' ') AS t FROM (SELECT item_id, UNNEST([w[i:i + 9] FOR i IN RANGE(1, GREATEST(LEN(w) - 9, 1) + 1)]) AS x FROM I WHERE LEN(w) > 0)),
S AS (SELECT DISTINCT n FROM IW),
P AS (SELECT k, w, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS i FROM D, S WHERE LEN(w) >= n),
DW AS (SELECT k, n, i, ARRAY_TO_STRING(w[i:i + n - 1], ' ') AS t FROM P),
M AS (SELECT k, i, DW.n, item_id FROM DW JOIN IW ON IW.t = DW.t),
C AS (SELECT k, COUNT(DISTINCT p) AS hit FROM (SELECT k, UNNEST(RANGE(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM M)) GROUP BY k),
J AS (SELECT k, COUNT(*) AS items, STRING_AGG(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM M WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, LEN(w)::BIGINT AS n_words, COALESCE(hit, 0)::BIGINT AS n_hit, COALESCE(items, 0)::BIGINT AS n_items, SHA256(COALESCE(l, '')) AS items_sha256, COALESCE(hit, 0) > 0 AS contaminated
FROM D LEFT JOIN C ON C.k = D.k LEFT JOIN J ON J.k = D.k
"""

#: Languages, licences, templates, forests, token ids and alignments have no SQL; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_forest": OP2_SQL,
    "op3_projection_passes": OP3_SQL,
    "op5_phrase_automata": OP5_SQL,
    "op6_water_filling": OP6_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_winnowing": OP13_SQL,
}
