"""Text functions against plain versions, and globs."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import globs
from textloom.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("How do I set spec.sink-type to v2.3?", ["set", "spec", "sink", "type", "v2", "3", "specsinktype", "v23"]),
        ("-a.b.- _x_ c//d", ["b", "x", "c", "d", "ab", "cd"]),
        ("Größe naïve", ["gr", "e", "na", "ve"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "stripped", "title"),
    [
        ("---\ntitle: \"A b\"\n---\nrest", "rest", "A b"),
        ("---\r\ntitle: 'x'\r\n---  \r\nrest", "rest", "x"),
        ("---\ntitle:\ntitle: y\n---\n", "", "y"),
        ("---\n---\nrest", "rest", None),
        ("---\ntitle: open", "---\ntitle: open", None),
        ("--- x\n---\n", "--- x\n---\n", None),
        ("plain", "plain", None),
    ],
)
def test_front_matter(spark, text, stripped, title):
    assert one(spark, T.strip_front_matter(F.col("t")), t=text) == stripped
    assert one(spark, T.front_matter_title(F.col("t")), t=text) == title


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\n# One ##\n# Two", "One"), ("```\n# no\n```\n# yes", "yes"), ("~~~\n# no\n~~~", None), ("#no\n#  \n  # spaced", "spaced"), ("---\n# no\n---\nx", None)],
)
def test_first_h1(spark, text, want):
    assert one(spark, T.first_h1(F.col("t")), t=text) == want


def test_cleaning(spark):
    assert one(spark, T.clean_content(F.col("t")), t="---\nx: 1\n---\n\n<!-- a\nb -->\nbody \n\n") == "body "
    assert one(spark, T.index_text(F.col("t")), t="![pic](x) [link](y) <b>z</b> 1 < 2") == "pic link  z  1 < 2"
    assert one(spark, T.excerpt(F.col("t"), 2), t="  a b\n c") == "a b"
    assert one(spark, T.shown_excerpt(F.col("t"), 2), t="a b c") == "a b…"


@pytest.mark.parametrize(("url", "slug"), [("https://github.com/a/b.git/", "a/b"), ("https://github.com/a/b", "a/b"), ("https://github.com/a/..", None), ("http://github.com/a/b", None), ("https://github.com/a", None)])
def test_repo_slug(spark, url, slug):
    assert one(spark, T.repo_slug(F.col("u")), u=url) == slug


def test_ids_and_paths(spark):
    assert tuple(one(spark, T.split_page_id(F.col("i")), i="a::b::c")) == ("a", "b::c")
    assert one(spark, T.split_page_id(F.col("i")), i="::b") is None and one(spark, T.split_page_id(F.col("i")), i="a::") is None
    assert one(spark, T.join_path(F.col("a"), F.col("b")), a="docs/x", b="../../../y/./z") == "y/z"
    assert one(spark, T.source_name(F.col("a")), a="My Repo.x_y-z") == "My-Repo-x_y-z"
    rows = spark.createDataFrame([("s", "a.md"), ("s", "a/b.md")], "source string, path string")
    assert [r.path for r in rows.orderBy(*T.page_order(F.col("source"), F.col("path"))).collect()] == ["a/b.md", "a.md"]


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [
        ("docs/*.md", "docs/adr/1.md", True), ("docs/**/*.md", "docs/x.md", True), ("**/x.md", "x.md", True), ("**/x.md", "ax.md", False), ("{a,b}/?.md", "b/1.md", True),
        ("[!a]*.md", "a.md", False), ("[a-c].md", "b.md", True), ("a.md", "A.md", False), ("docs/**", "docs/a/b", True), ("a+b.md", "a+b.md", True),
    ],
)
def test_globs(spark, pattern, path, want):
    assert bool(re.search(globs.to_regex(pattern), path)) == want
    assert one(spark, globs.matches(F.col("p"), [pattern]), p=path) == want


@pytest.mark.parametrize("bad", ["[a", "{a", "a\\"])
def test_bad_globs(bad):
    with pytest.raises(globs.GlobError):
        globs.to_regex(bad)
