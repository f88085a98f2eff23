"""The pipeline's stages in turn, on the smallest tables."""

import corpus_pipeline
import pytest

from tidemark.llm.minhash_forest import near_duplicates


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)


def test_language_keeps_clean_documents(stages):
    before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in stages[:2])
    assert after <= before and len(after) >= 0.98 * len(before)


def test_one_of_each_group_stays(stages):
    groups = {r.component_id for r in near_duplicates(stages[1]).collect()}
    assert {r.doc_id for r in stages[2].collect()} == groups


def test_nothing_repeats_after_the_cut(stages):
    words = {r.doc_id: r.text.split() for r in stages[2].collect()}
    left = {r.doc_id: r.text.split() for r in stages[3].collect()}
    assert set(left) <= set(words) and all(len(left[k]) <= len(words[k]) for k in left)
    count = {}
    for w in words.values():
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        assert left.get(k, []) == [x for x, g in zip(w, gone) if not g]


def test_packed_documents_are_the_mix(stages):
    mixed = {}
    for r in stages[4].collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    packed = {}
    for r in stages[5].collect():
        packed.setdefault(r.doc_id, []).append(r)
    assert {k: sum(r.length for r in rows) // rows[0].doc_tokens for k, rows in packed.items()} == mixed


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "words here", None, None, 10), (3, "words here", None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} <= {3, None}


def test_rows_without_an_id_stay(spark, sf):
    rows = [(None, f"these words are number {i} of them", "en", "a", 10) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.deduplicated(spark, docs, sf).count() == 3
    assert corpus_pipeline.source_mix(spark, docs, sf).count() == 3


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
    assert docs.count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark, sf):
    r = "one two three four five six seven eight nine ten".split()
    texts = {1: [" ".join(r)], 2: [" ".join(r), " ".join(reversed(r))], 3: [" ".join(reversed(r)) + " more", "a text of its own that nothing else repeats"]}
    rows = [(i, t, "en", "a", len(t)) for i, all_ in texts.items() for t in all_] + [(3, texts[3][1], "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [x.text for x in corpus_pipeline.deduplicated(spark, docs, sf).collect()]
    assert len(got) == 3 and {texts[1][0], texts[3][1]} < set(got)
    assert (texts[2][1] in got) != (texts[3][0] in got)  # near copies of each other under two ids


def test_clashing_names(spark, sf):
    rows = [(i, f"these words are number {i} of them " * 12, "en", "a", 10) for i in range(6)] + [(6, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in corpus_pipeline.STAGES:
        extra = docs.selectExpr("*", *(f"7 AS {c}" for c in ("score", "labelled", "n_words", "removed", "kept", "_key", "size", "carried", "copy", "id", "component_id")))
        out = f(spark, extra, sf)
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() > 0


def test_run_leaves_only_its_result(spark, sf):
    import os

    from tidemark.storage import shared_folder

    root = shared_folder(spark).removeprefix("file://") + "/tidemark"
    before = set(os.listdir(root))
    n = corpus_pipeline.run(spark, sf).count()
    new = set(os.listdir(root)) - before
    assert n > 0 and len(new) == 1 and len(os.listdir(f"{root}/{new.pop()}")) == 1
