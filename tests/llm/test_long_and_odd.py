"""Texts and pages that must not stall a task, sites of odd markup, languages in any number."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf_language, license_scan, template_extract

ARTICLE = "<p>" + "Some real article text that is long enough to count. " * 8 + "</p>"
MENU = '<nav><ul><li><a href="x">Home</a></li></ul></nav>'


@pytest.mark.parametrize("line", ["=====", "| a | b |", "русский текст строка", "一二三", "permission is", "the"])
def test_many_lines_are_scanned_at_once(line):
    start = time.perf_counter()
    license_scan.known_sentences("license\n" + f"{line}\n" * 100_000)
    assert time.perf_counter() - start < 10


def test_lines_without_words_join_nothing():
    text = "=====\nPermission is hereby granted, free of charge,\n=====\n\n=====\nAll rights\n=====\nreserved.\n"
    found = license_scan.known_sentences(text)
    assert [text[a:b] for _, a, b in found if "rights" in text[a:b]] == ["All rights\n=====\nreserved."]


@pytest.mark.parametrize("wrap", ['<div class="elementor-widget">%s</div>', '<div class="page with-sidebar">%s</div>', '<div class="main-content has-header">%s</div>', '<form id="aspnetForm"><div>%s</div></form>', '<div id="search-result-article">%s</div>'])
def test_names_do_not_silence_an_article(wrap):
    page = f"<html><body>{MENU}{wrap % ARTICLE}<footer>foot of the page</footer></body></html>"
    text = template_extract.main_text(page)
    assert text.startswith("Some real article") and "Home" not in text and "foot of" not in text


def test_comments_longer_than_the_article_stay_out():
    page = f'<body><article><header><h1>Title</h1></header>{ARTICLE}</article><div class="comments">{ARTICLE.replace("real", "reader")*3}</div></body>'
    text = template_extract.main_text(page)
    assert text.startswith("Title\n\nSome real") and "reader" not in text


@pytest.mark.parametrize("page", ['<a href="" ' * 90_000 + '"', "<div>" * 20_000 + "text" + "</div>" * 20_000, "<p title='" * 50_000])
def test_odd_pages_take_no_time(page):
    start = time.perf_counter()
    template_extract.main_text(page)
    assert time.perf_counter() - start < 3


def test_no_language_is_lost_by_its_size(spark, monkeypatch):
    assert crf_language.draw_below(10**15) > 0 and crf_language.draw_below(1) == (1 << 63) - 1
    expected = 10**9 * crf_language.draw_below(10**9) / (1 << 63)
    assert abs(expected - 2 * crf_language.FIT_DOCS) < 1
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 5).alias("lang"))
    monkeypatch.setattr(crf_language, "MOST_LANGUAGES", 3)
    _, labels = crf_language.training_rows(rows, "doc_id", "text", "lang")
    assert len(set(labels)) == 3
