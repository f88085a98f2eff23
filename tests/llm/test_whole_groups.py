"""Large groups of texts, vectors and pages: what no bounded window or list holds."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import minhash_forest, projection_passes, template_extract
from tidemark.llm.words import blocks


def roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_every_link_of_a_large_group(spark):
    """400 texts that are alike but no copies, with pairs just over the limit among them."""
    r = random.Random(5)
    base, texts = [f"w{i}" for i in range(200)], []

    def changed(words, n):
        words = list(words)
        for i in r.sample(range(200), n):
            words[i] = f"x{r.random()}"
        return words

    for _ in range(200):
        texts.append(changed(base, 4))
        texts.append(changed(texts[-1], 5))
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in texts]
    links = [(a, b) for a in range(400) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 150
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(docs).collect()}
    assert got == roots(range(400), links)


def test_every_link_of_scattered_texts(spark):
    """1,500 texts of one region, most of them about 0.7 alike, so that links lie thinly among pairs that are none."""
    r = random.Random(11)
    base, texts = [f"w{i}" for i in range(160)], []
    for _ in range(1500):
        words = list(base)
        for i in r.sample(range(160), r.choice((2, 3, 4, 5))):
            words[i] = f"x{r.randrange(10**9)}"
        texts.append(words)
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) for w in texts]
    links = [(a, b) for a in range(1500) for b in range(a) if 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    expected = roots(range(1500), links)
    assert len(links) > 5000 and len(set(expected.values())) > 5
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(docs).collect()}
    assert got == expected


def test_a_long_text_hashes_like_short_ones():
    words = [f"word{i % 700}" for i in range(700_000)]
    raw = " ".join(words).encode()
    block = next(blocks(pa.array([raw], pa.binary())))
    starts, ends, _ = block.words()
    short = next(blocks(pa.array([" ".join(words[:700]).encode()], pa.binary())))
    own = short.hashes(*short.words()[:2])
    assert len(raw) > 4 << 20 and (block.hashes(starts, ends).reshape(-1, 700) == own).all()


def test_common_shingles_equal_brute_force(monkeypatch):
    monkeypatch.setattr(minhash_forest, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(1, 40, size)] for size in (9, 5))
    assert minhash_forest.common(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


def test_links_in_a_dense_topic(spark):
    """A third of the vectors have a cosine of about 0.88 with each other, and pairs of about 0.96 among them."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    topic = unit(np.sqrt(0.88) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.12) * unit(rng.normal(size=(1000, 64))))
    twins = unit(topic + np.sqrt(1 / 0.96**2 - 1) * unit(rng.normal(size=topic.shape)))
    x = np.vstack((topic, twins, rng.normal(size=(4000, 64))))
    y = unit(x)
    links = [(a, b) for a, b in zip(*(k.tolist() for k in np.nonzero(y @ y.T >= 0.95)), strict=True) if a < b]
    assert 500 < len(links) < 1500
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection_passes.near_vectors(df).collect()}
    n = np.bincount(np.array(links).ravel(), minlength=len(x)).tolist()
    expected = {i: (n[i], c) for i, c in roots(range(len(x)), links).items()}
    assert sum(got[i] != expected[i] for i in expected) <= 0.01 * len(links)


def texts(spark, pages):
    """Main texts of one host's pages by number."""
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {x.page_id: x.text for x in template_extract.extract_main_text(df).collect()}


PAGE = "<html><body><div class=top><span>Menu one</span></div><div class=c><p>{}</p><p>Read on here</p>{}</div><div class=end>bye</div></body></html>"


def test_other_pages_do_not_empty_the_template(spark):
    stories = [f"story number {i} " * 9 for i in range(10)]
    box = "<div class=x><p>Some words to our readers</p></div>"
    pages = [PAGE.format(s, box * (k % 5 != 0) * (1 + k % 2)) for k, s in enumerate(stories)]
    got = texts(spark, [*pages, None, "", "<html><body><table><p>of another layout</table></body></html>"])
    assert [got[i] for i in range(10)] == [s.strip() for s in stories] and got[10] == got[11] == ""


def test_copies_of_an_article_keep_their_text(spark):
    pages = ["<html><body><p>Menu</p><article class=one><p>the same words</p><p>at three places</p></article></body></html>"] * 3
    got = texts(spark, [*pages, *("<html><body><p>Menu</p><article><p>%s</p></article></body></html>" % (w * 9) for w in ("one ", "two ", "three "))])
    assert [got[i] for i in range(3)] == ["the same words\n\nat three places"] * 3


def test_templates_of_any_length(spark, monkeypatch):
    """600 shared text runs in neutral containers, in several parts of a host."""
    monkeypatch.setattr(template_extract, "PART_PAGES", 2)
    notices = "".join(f"<p>clause {k}</p>" for k in range(600))
    stories = [f"story number {i} " * 900 for i in range(9)]
    got = texts(spark, [PAGE.format(s, notices) for s in stories])
    assert got == {i: s.strip() for i, s in enumerate(stories)}


PLAIN = "<html><body><div><p>Top of the site</p><p>{}</p></div><div><div><p>{}</p><div><p>{}</p></div></div><div><p>Share this with friends</p><p>{}</p></div></div><div><p>All rights kept</p></div></body></html>"


def test_articles_in_unnamed_containers(spark):
    """No article, no class: the slots of the template alone tell where the text is, also on a page whose own article is short."""
    r = random.Random(3)
    stories = [" ".join(f"s{i}w{r.randrange(999)}" for _ in range(120 if i else 3)) for i in range(12)]
    pages = [PLAIN.format(f"day {i}", "By our staff", s, f"seen {i} times") for i, s in enumerate(stories)]
    assert texts(spark, pages) == dict(enumerate(stories))


def test_equal_pages_keep_their_article(spark):
    page = PAGE.format("the same story " * 9, "")
    alone = texts(spark, [page] * 3)
    assert len(set(alone.values())) == 1 and "the same story" in alone[0]
    got = texts(spark, [page] * 4 + [PAGE.format(f"story number {i} " * 9, "") for i in range(5)] + [None, "", " "])
    assert [got[i] for i in range(9)] == [("the same story " * 9).strip()] * 4 + [(f"story number {i} " * 9).strip() for i in range(5)]
    assert [got[i] for i in range(9, 12)] == [""] * 3


def test_repeated_rows_and_clashing_names(spark):
    rows = [(None if i > 5 else i, f"http://h.example/{i}", PAGE.format(f"story number {i} " * 9, ""), "x", 1, "r", "h") for i in range(9)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, n_chars int, row string, host string")
    out = template_extract.extract_main_text(df)
    assert out.columns == ["page_id", "url", "row", "host", "text", "n_chars"]
    assert sorted(x.text for x in out.collect()) == sorted([(f"story number {i} " * 9).strip() for i in range(9)] * 2)
