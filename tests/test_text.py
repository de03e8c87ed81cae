"""Text and path functions on hand-made inputs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import paths, text


@pytest.fixture
def run(spark):
    def f(fn, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
        return [r[0] for r in df.orderBy("k").select(fn(*[F.col(f"c{i}") for i in range(len(rows[0]))])).collect()]

    return f


def test_tokens(run):
    assert run(text.tokens, "Don't STOP, ÉTÉ 42!", "", "…") == [["don", "t", "stop", "été", "42"], [], []]


def test_excerpt_and_truncate(run):
    assert run(lambda c: text.excerpt(c, 5), "a  b\nc", "abcdef", "😀😀😀😀😀😀") == ["a b c", "abcd…", "😀😀😀😀…"]
    assert run(lambda c: text.truncate(c, 1), "ab", "a") == ["…", "a"]
    assert run(lambda c: text.excerpt(c, 0), "ab") == [""]


def test_snippet_keeps_prose(run):
    got = run(text.snippet, "if x<y and y>z then Vec<String> stays", 'a <svg viewBox="0 0"><rect x="1"/></svg> b', "> quoted\n5 > 3", "```go\ncode\n```\nafter [link](x.md) _it_", "a<b then swap.\n> note")
    assert got == ["if x<y and y>z then Vec<String> stays", "a b", "quoted 5 > 3", "after link it", "a<b then swap. note"]
    assert run(text.snippet, "x" * 200) == ["x" * 160 + "..."]


def test_headings(run):
    md = "# One #\n```\n# no\n```\n####### seven\n#none\n## [Two](a.md) `x`\n# One\n"
    assert run(text.headings, md, "```\n# open fence", "") == [["One", "Two x"], [], []]


def test_slugs_and_terms(run):
    assert run(text.slugify, "Hello, World!", "!!!", "a" * 60, "x" * 47 + " yz") == ["hello-world", "section", "a" * 48, "x" * 47]
    assert run(text.taxonomy_value, " C++ ", "go", "??", "a" * 256) == ["c", "go", None, None]


def test_dates_and_sizes(run):
    assert run(text.valid_date, "2024-02-29", "2023-02-29", "2023-1-5", "2024-01-01x", None) == ["2024-02-29", None, None, None, None]
    assert run(lambda c: text.byte_size(c.cast("long")), "10", "2048", str(5 << 20)) == ["10 B", "2.0 KB", "5.0 MB"]


def test_refusals(run):
    assert run(text.refuses, "", "I don't know.", "It is [1].") == [True, True, False]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<file >cont/\\ax\r", max_size=14), min_size=1, max_size=6))
def test_escaping_round_trip(spark, lines):
    body = "\n".join([*lines, "</file>", "\\<content>"])
    row = spark.createDataFrame([(body,)], "c string").select(text.escape_lines(F.col("c")).alias("e")).select("e", text.unescape_lines(F.col("e")).alias("u")).first()
    assert row["u"] == body
    assert not any(x.startswith(text.MARKERS) for x in row["e"].split("\n"))


def test_output_paths(run):
    out = lambda p, s: paths.output_path(p, s, F.lit(True))
    assert run(out, ("a/b.md", "x"), ("a/index.md", "x"), ("index.md", ""), ("b.md", "../x"), ("b.md", None)) == ["a/x/index.html", "a/index.html", "index.html", "b/index.html", "b/index.html"]
    assert run(paths.public_path, "index.html", "a/index.html", "a.txt") == ["/", "/a/", "/a.txt"]
    assert run(paths.valid_site, "https://x.org", "https://u@x.org", "ftp://x", "https://x.org/a/../b", None) == [True, False, False, False, False]


def test_links(run):
    got = run(paths.resolve_link, ("b.md", "a/c.md"), ("../b.md", "a/c.md"), ("../../b.md", "a/c.md"), ("/x/./y.md#z", "a/c.md"), ("http://h/a.md", "a/c.md"), ("a.txt", "c.md"), ("%2E%2E/b.md", "a/c.md"))
    assert got == ["a/b.md", "b.md", None, "x/y.md", None, None, None]
    assert run(paths.relative_link, ("a/b/index.html", "a/c/index.html"), ("index.html", "a/index.html"), ("a/index.html", "a/index.html"), ("a/b/index.html", "x.md")) == ["../c/", "a/", "./", "../../x.md"]
    assert run(paths.clean_path, "a/../b//./c", "../a", ".", "a/..") == ["b/c", "../a", ".", "."]
