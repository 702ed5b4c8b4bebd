"""Titles with references that are cut off."""

from chronoweave.operators import clean


def test_references_without_semicolon(spark):
    pages = spark.createDataFrame([(1, "<title>a &amp; b&amp</title>"), (2, "<title>c & d&copy; &x;</title>"), (3, None)], "page_id int, html string")
    titles = lambda **k: {r.page_id: r.title for r in clean.clean(pages, **k).collect()}
    assert titles(open_references=False) == {1: "a & b&amp", 2: "c & d© &x;", 3: "3"}
    assert titles()[1] == "a & b&"
