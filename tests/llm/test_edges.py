"""Edges of the operators that read pages and fingerprints."""

import base64
import time

import pytest

from augury.llm import chunks, html_text, toxicity, warc


def extract(body):
    return html_text.extract(f"<html><body>{body}</body></html>")


LONG = "This is a sentence of the article, with commas, clauses, and enough words to count as text. " * 3


def test_article_without_an_article_element():
    page = f"""<div class="site-header"><a href="/">Home</a> <a href="/x">Other</a></div><div id="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div>
    <div class="wrap"><div class="story"><h1>Title of it</h1><p>{LONG}</p><div><p>Second, nested, {LONG}</p></div><p>Short end.</p></div>
    <div class="sidebar-right"><p>{LONG}</p></div></div><div class="footer">All of it, (c) 2020, is ours.</div>"""
    assert extract(page).split("\n") == ["Title of it", LONG.strip(), "Second, nested, " + LONG.strip(), "Short end."]


@pytest.mark.parametrize("name, kept", [("header-image", True), ("related-work", True), ("notice-of-terms", True), ("site-header", False), ("cookie-banner", False), ("ad-300x250", False), ("comment-list", False), ("social share", False)])
def test_class_names_inside_an_article(name, kept):
    text = extract(f'<article><p>{LONG}</p><div class="{name}"><p>Inside, here.</p></div></article>')
    assert ("Inside, here." in text) is kept


def test_deep_pages_take_linear_time():
    def took(n):
        start = time.process_time()
        extract("<blockquote>" * n + "words, of some kind, that are text enough " * n + "</blockquote>" * n)
        return time.process_time() - start

    took(100)
    assert took(8000) < 40 * max(took(500), 0.002)


def test_chunk_lengths_have_no_limit():
    digest = b"123456"
    seen = {chunks.encode({digest: n}) for n in (0, 127, 128, (1 << 24) - 1, 1 << 24, (1 << 24) + 1, 1 << 40)}
    assert len(seen) == 7
    assert base64.b64decode(chunks.encode({digest: 300}))[6:] == bytes([300 & 127 | 128, 300 >> 7])


def test_fingerprint_of_a_very_long_repeated_text(spark):
    rows = [(1, "abcdefgh" * 300_000, "x"), (2, "abcdefgh" * 300_001, "y")]
    got = chunks.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, part string"), 2).collect()
    assert got[0].fingerprint != got[1].fingerprint and got[0].near_next > 0.99
    assert chunks.fingerprints(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def test_archives_by_size_class(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", [(50, 3), (2000, 2)])
    pages = [(i, f"http://h/{i}", "x" * n, 0) for i, n in enumerate([0, 10, 50, 51, 1500, 1500, 2001, 9000, 9000])] + [(None, None, None, 1), (20, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40, 1)]
    got = {r.page_id: r for r in warc.verified(spark.createDataFrame(pages, "page_id long, url string, html string, bytes int")).collect()}
    assert len(got) == len(pages) and got[None].payload_bytes == 0
    assert (got[4].record_type, got[4].refers_to, got[5].record_type, got[7].refers_to, got[3].record_type) == ("revisit", 5, "response", 8, "response")
    assert got[20].payload_bytes == 38 * 40


def test_toxicity_without_rows_or_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 0
    some = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (2, "word " * 50_000, "s")], "doc_id long, text string, score string")
    assert {r.predicted for r in toxicity.score(some, model).collect()} == {0} and toxicity.keep_clean(some, model).count() == 3
