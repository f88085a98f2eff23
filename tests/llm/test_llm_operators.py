"""The operators on small tables, against brute force, and on rows that must not break them."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf_language, isolation_rules, license_scan, minhash_forest, mixing, packing, phrase_automata, projection_passes, template_extract, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, component string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with other columns, some of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, None, -1, "r", "c") for i, t, lang, s in rows], DOCS)


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n ", "en", None), (4, "one", None, "b"), (4, "one", None, "b"), (5, long, "en", "a"), (6, long, "fr", "b"), (None, "no id here at all", "en", "a"), (7, "12 34 !!", "en", "a")]


OPERATORS = [
    lambda s, d: license_scan.scan_licences(d),
    lambda s, d: minhash_forest.near_duplicates(d),
    lambda s, d: crf_language.identify_language(d),
    lambda s, d: phrase_automata.remove_repeats(d),
    lambda s, d: phrase_automata.remove_repeats(d, digest=True),
    lambda s, d: mixing.mix_sources(d),
    lambda s, d: isolation_rules.judge_quality(d, s.createDataFrame([(1, 1), (5, 1), (None, 0), (6, None)], "doc_id long, quality int")),
    lambda s, d: token_count.count_tokens(d),
]


@pytest.mark.parametrize("k", range(len(OPERATORS)))
def test_odd_rows_keep_their_number(spark, k):
    rows = edge_rows()
    assert len(OPERATORS[k](spark, documents(spark, rows)).collect()) == len(rows)


@pytest.mark.parametrize("k", range(len(OPERATORS)))
def test_empty_table(spark, k):
    assert OPERATORS[k](spark, documents(spark, [])).count() == 0


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(documents(spark, edge_rows())).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and sum(r.length for r in rows if r.doc_id == 4) == 2 * rows[[r.doc_id for r in rows].index(4)].doc_tokens
    assert packing.pack_documents(documents(spark, [])).count() == 0


def varied(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(7)
    rows, n = [], 0
    for _ in range(12):
        base = varied(r, r.choice((3, 20, 80, 200)))
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for i in r.sample(range(len(w)), min(len(w), r.randrange(5))):
                w[i] = f"x{r.random()}"
            rows.append((n, " ".join(w) if n % 2 else "\n ".join(w).upper(), "en", "a"))
            n += 1
    sets = {}
    for i, t, _, _ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for row in minhash_forest.near_duplicates(documents(spark, rows)).collect():
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), root(row.doc_id), root(row.doc_id) == row.doc_id)


def test_regions_deepen(spark, monkeypatch):
    """With tiny regions and no neighbours the region step alone still links copies."""
    monkeypatch.setattr(minhash_forest, "REGION_ROWS", 2)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join([*base[: 299 - k], f"z{k}"]), "en", "a") for k in range(12)]
    got = minhash_forest.near_duplicates(documents(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_near_vectors_equal_brute_force(spark):
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(30):
        base = [r.gauss(0, 1) for _ in range(16)]
        for _ in range(r.randrange(1, 60) if n < 200 else 1):
            rows.append((n, [x + r.gauss(0, 0.05) for x in base]))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, [2 * x for x in rows[0][1]]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 16), (n + 5, [float("nan")] + [1.0] * 15), (n + 6, [None] + [1.0] * 15), (n + 7, [1.0, 2.0])]
    good = {i: v for i, v in rows if v and len(v) == 16 and all(x is not None and x == x for x in v) and any(v)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    parent, links = {i: i for i, _ in rows}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and cos(good[a], good[b]) >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    df = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    for row in projection_passes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        assert (row.n_links, row.component_id, row.kept) == (links[row.vec_id], root(row.vec_id), root(row.vec_id) == row.vec_id), row
    assert projection_passes.near_vectors(df.limit(0)).count() == 0


def test_repeats_equal_brute_force(spark):
    r = random.Random(11)
    passages = [varied(r, n) for n in (34, 35, 36, 60, 120)]
    texts = []
    for _ in range(40):
        words = varied(r, r.randrange(60))
        for p in r.sample(passages, r.randrange(3)):
            a = r.randrange(20) if len(p) > 60 else 0
            words += p[a:] + varied(r, r.randrange(9))
        texts.append((" " if r.random() < 0.5 else "\n").join(words))
    texts += ["la " * 90, texts[3], "x y " * 30, " ".join(passages[4] * 2)]
    words = [t.split() for t in texts]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = {}
    for k, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        expected[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    out = phrase_automata.remove_repeats(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "id", "row", "component", "text", "n_words", "removed"]
    got = {x.doc_id: (x.n_words, x.n, x.text) for x in out.withColumn("n", phrase_automata.removed_words()).collect()}
    assert got == expected
    digests = {x.doc_id: x.kept_sha256 for x in phrase_automata.remove_repeats(docs, digest=True).collect()}
    assert digests == {k: hashlib.sha256(e[2].encode()).hexdigest() for k, e in expected.items()}


def test_mixing_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 30), "en", s) for i, s in enumerate(["a"] * 500 + ["b"] * 30 + [None] * 60)]
    out = mixing.mix_sources(documents(spark, rows)).collect()
    again = mixing.mix_sources(documents(spark, rows[::-1])).collect()
    assert sorted((x.doc_id, x.taken) for x in out) == sorted((x.doc_id, x.taken) for x in again)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for x in out:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken <= 3 * x.size
    total = sum(size.values())
    assert target["b"] == 3 * size["b"] and target[None] == 3 * size[None]
    assert sum(target.values()) == pytest.approx(total)
    for s in size:
        assert abs(taken[s] - target[s]) <= 30


def test_language_learns_only_from_its_part(spark):
    import zlib

    words = {"en": "the and of with house".split(), "de": "der und von mit haus".split()}
    r = random.Random(0)
    rows = [(i, " ".join(r.choices(words[("en", "de")[i % 2]], k=40)), ("en", "de")[i % 2], "a") for i in range(80)]
    held = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(i, t, "zz" if i in held else lang, s) for i, t, lang, s in rows]
    out = crf_language.identify_language(documents(spark, rows)).collect()
    assert {x.lang_pred for x in out} == {"en", "de"} and all(x.lang_pred == ("en", "de")[x.doc_id % 2] and 0 <= x.score <= 1 for x in out)
    marked = documents(spark, rows).select("doc_id", crf_language.held_out().alias("h")).collect()
    assert {x.doc_id for x in marked if x.h} == held


def test_quality_on_the_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = isolation_rules.judge_quality(docs, labels).join(labels, "doc_id").collect()
    good, bad = [x for x in out if x.quality == 1 and not x.base_failed], [x for x in out if x.quality == 0]
    assert sum(x.kept for x in good) >= 0.9 * len(good) and sum(not x.kept for x in bad) >= 0.5 * len(bad)


def test_language_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = crf_language.identify_language(docs).join(docs.select("doc_id", "lang", crf_language.held_out().alias("h")), "doc_id").filter("h").collect()
    assert sum(x.lang_pred == x.lang for x in out) >= 0.95 * len(out)


def test_templates_drop_what_all_pages_share(spark):
    page = "<html><body><div class=top><span>Menu one</span></div><div class=c><p>{}</p><p>Read more news</p></div><div class=end>bye</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"story number {i} " * 9)) for i in range(6)] + [(6, None, None), (7, "http://h.example/7", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in template_extract.extract_main_text(df.filter("page_id < 6")).collect()}
    assert got == {i: (f"story number {i} " * 9).strip() for i in range(6)}
    got = {x.page_id: (x.text, x.n_chars) for x in template_extract.extract_main_text(df).collect()}
    assert got[6] == ("", 0) and got[7] == ("", 0) and len(got) == 8
    assert template_extract.extract_main_text(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for x in template_extract.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", x.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        assert x.text == "\n\n".join(p for p in parts if p) and x.n_chars == len(x.text)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import default_path

    t = Tokenizer.from_file(default_path())
    rows = edge_rows()
    expected = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _, _ in rows)
    got = token_count.count_tokens(documents(spark, rows)).collect()
    assert collections.Counter((x.doc_id, x.n_tokens) for x in got) == expected and all(x.over_limit == (x.n_tokens > 1024) for x in got)


def test_packed_ids_are_the_librarys(spark, sf):
    """Every document of the table, with long white space besides, against the tokenizers library."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import default_path

    t = Tokenizer.from_file(default_path())
    own = spark.createDataFrame([(-1, "a" + " " * 10**6 + "b"), (-2, "\n" * 10**6), (-3, None), (-3, None)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(own)
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for x in packing.pack_documents(docs).collect():
        pieces[x.doc_id].append(x)
        filled[x.sequence_id].append((x.offset, x.length))
    for x in docs.distinct().collect():
        ids = np.array([*t.encode(x.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        rows = sorted(pieces.pop(x.doc_id), key=lambda p: p.start)
        assert {p.doc_tokens for p in rows} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in rows)
        if x.doc_id != -3:
            assert [p.start for p in rows] == [sum(q.length for q in rows[:k]) for k in range(len(rows))]
        assert sum(p.length for p in rows) == len(ids) * (1 + (x.doc_id == -3))
    assert not pieces
    for rows in filled.values():
        rows.sort()
        assert [a for a, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 2048


CLASHES = ["score", "Labelled", "_letters", "lang_pred", "n_words", "Removed", "kept_sha256", "_no_text", "text2", "key", "weight", "no_text", "of", "vec", "size", "target", "taken", "matches", "n_tokens", "kept", "component_id"]


@pytest.mark.parametrize("k", range(len(OPERATORS)))
def test_clashing_names(spark, k):
    """Inputs with the names of results and of intermediate columns: no column comes out twice."""
    rows = [(i, f"these words are number {i} of them " * 12, "en", "a") for i in range(6)] + [(6, None, None, None)]
    docs = documents(spark, rows).withColumns({c: F.lit(7) for c in CLASHES})
    out = OPERATORS[k](spark, docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert len(out.select(*[f"`{c}`" for c in out.columns]).collect()) == 7


def test_vectors_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("id", "vec", "n_links", "component_id", "kept", "mark1", "head")})
    got = sorted((x.vec_id or 0, x.n_links, x.component_id) for x in projection_passes.near_vectors(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_a_language_of_long_texts_is_learnt(spark):
    """All texts of one language are longer than the training bound, and only its later parts tell it apart."""
    r = random.Random(0)
    words = {"aa": "the and of with house".split(), "bb": "der und von mit haus".split()}
    rows = [(i, " ".join(r.choices(words["aa"], k=40)), "aa", "s") for i in range(40)]
    rows += [(40 + i, "99 " * 20_000 + " ".join(r.choices(words["bb"], k=20_000)), "bb", "s") for i in range(12)]
    rows += [(60 + i, " ".join(r.choices(words["bb"], k=40)), None, "s") for i in range(8)]
    got = {x.doc_id: x.lang_pred for x in crf_language.identify_language(documents(spark, rows)).collect()}
    assert got == {i: "aa" if i < 40 else "bb" for i, *_ in rows}


def test_more_languages_than_are_learnt(spark):
    """Once an error; now the most frequent ones are learnt, ties by code point."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.col("id").cast("string").alias("lang"))
    found = crf_language.identify_language(docs)
    assert found.count() == 600 and found.filter("lang_pred = 'und'").isEmpty()
    _, labels = crf_language.training_rows(docs, "doc_id", "text", "lang")
    usable = sorted(r["lang"] for r in docs.filter(~crf_language.held_out()).collect())
    assert sorted(labels) == usable[: crf_language.MOST_LANGUAGES]


def test_long_texts(spark):
    """A text of 6 MB goes through all operators whole."""
    words = [f"w{i % 5003}" for i in range(1_000_000)]
    text = " ".join(words)
    docs = documents(spark, [(1, text, "en", "a"), (2, "short text of the same language", "en", "a")])
    assert {x.doc_id: x.n_words for x in phrase_automata.remove_repeats(docs).collect()} == {1: 1_000_000, 2: 6}
    assert {x.doc_id: x.n_shingles for x in minhash_forest.near_duplicates(docs).collect()} == {1: 5003, 2: 2}
    assert {x.doc_id: sum(y.words for y in x.labelled) for x in crf_language.identify_language(docs).collect()} == {1: 1_000_000, 2: 6}
    assert {x.doc_id: x.size for x in mixing.mix_sources(docs).collect()} == {1: 1_000_000, 2: 6}
    assert sum(x.length for x in packing.pack_documents(docs).collect() if x.doc_id == 1) > 1_000_000


@pytest.mark.parametrize("name", ["op2_minhash_forest", "op3_projection_passes", "op5_phrase_automata", "op6_water_filling"])
def test_queries_equal_their_sql(spark, sf, name):
    from compare import connect, same

    from tidemark.llm import queries

    assert same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name]) > 0


def test_licence_query_finds_what_was_written(spark, tmp_path):
    from tidemark.llm import queries

    rows = [(1, "Words. Released under the\nMIT License.\n\nMore."), (2, "SPDX-License-Identifier: MIT OR ISC"), (3, "released into the public\ndomain."), (3, "no licence at all"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.n_matches, x.licences, x.spans) for x in queries.op1_license_sentences(spark, str(tmp_path)).collect())
    expected = [(1, 1, "MIT", "MIT[7:38]mit.name"), (2, 2, "ISC,MIT", "MIT[25:28]spdx ISC[32:35]spdx"), (3, 0, "", ""), (3, 1, "LicenseRef-Public-Domain", "LicenseRef-Public-Domain[0:32]public-domain"), (4, 0, "", "")]
    assert got == expected
