"""Inputs on which text, spans, rows or columns were once lost."""

import time

import numpy as np
import pytest

from gesso.llm import html_layout, mixing, near_copies, pii, quality_table


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><meta charset=u><p>Hello one</p><div>two</div>", "Hello one\n\ntwo"),
        ("<head><title>t</title>Hello bare", "Hello bare"),
        ("<html><head>\n <link rel=x>\n<style>p{}</style></head>\n<body>in body", "in body"),
        ("<p>a</p><head><p>b</p>", "a\n\nb"),
        ("<p>a</p><!--><p>b</p>", "a\n\nb"),
        ("<p>a</p><!---><p>b</p>-->", "a\n\nb\n\n-->"),
        ("a<!-- x > y -->b<!-- <p> --!>c", "abc"),
        ("<svg><text><![CDATA[x < y > z]]></text></svg> end", "x < y > z end"),
        ("<p>1<![CDATA[ gone ]]>2", "12"),
    ],
)
def test_text_that_html_shows(page, want):
    assert html_layout.render(page) == want


@pytest.mark.parametrize("piece", ["<blockquote>x", "<ul><li>x", "<ol><li>x", "<table><tr><td>x", "<dl><dd>x", "<div>x"])
def test_deep_nesting_is_linear(piece):
    depth = 50_000
    began = time.process_time()
    out = html_layout.render(piece * depth)
    assert out.count("x") == depth
    assert time.process_time() - began < 30 and len(out) < 400 * depth


def test_three_labelers_that_agree_are_believed():
    votes = np.array([[1, 1, 1, 0, 0, 0], [-1, 0, 0, 0, 0, 0], [0, 0, 0, 0, -1, 0]])
    post, _ = pii.estimate(votes, np.array([50.0, 50.0, 50.0]))
    assert post[0] > pii.ACCEPT and post[1] < 0.5 and post[2] < 0.5


def test_stop_words_are_asked_of_listed_languages_only(spark):
    russian = " ".join(f"слово{i} текст{i} речь{i}" for i in range(100))
    rows = [(1, russian, "ru"), (2, russian, None), (3, russian, "en"), (4, russian, "fr-CA")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality_table.judge_documents(docs).collect() if r["kept"]} == {1, 2}
    assert {r["doc_id"] for r in quality_table.keep_good(docs).collect()} == {1, 2}
    assert {r["doc_id"] for r in quality_table.keep_good(docs.drop("lang")).collect()} == {1, 2, 3, 4}


def test_stages_keep_columns_of_any_name(spark):
    text = "one day the old man went to the sea and did not come back for a very long time"
    schema = "doc_id long, text string, source string, lang string, gesso__n_words int, gesso__row string, gesso__key int, `a.b` int"
    docs = spark.createDataFrame([(1, text, "s", "en", 7, "mine", 3, 4), (2, text + " again", "s", "en", 8, "yours", 5, 6)], schema)
    for stage in (quality_table.keep_good, near_copies.drop_near_copies, mixing.mixed_rows):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    assert quality_table.keep_good(docs).count() == 2
