"""Links of Markdown texts: the cases in which CommonMark differs from a plain pattern."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.sources import commonmark
from docweave.sources.commonmark import references

CASES = [
    ("[a](x.md) and [b]( <y z.md> 'title' )", ["x.md", "y z.md"]),
    ("[a][] [B] [c][b]\n\n[a]: one.md\n[b]: two.md 'T'", ["one.md", "two.md", "two.md"]),
    ("[none][] [none] [x]", []),
    ("    [code](a.md)\n\ntext [b](b.md)\n    [lazy](c.md)", ["b.md", "c.md"]),
    ("```\n[a](a.md)\n```\n[b](b.md)\n~~~~\n[c](c.md)\n~~~\n[d](d.md)", ["b.md"]),
    ("`[a](a.md)` ``[b](`b.md)`` [c](c.md) \\[d](d.md) [e\\](e.md)", ["c.md"]),
    ("![img](i.png) [![alt](j.png)](page.md)", ["!i.png", "page.md", "!j.png"]),
    ("[outer [inner](in.md)](out.md)", ["in.md"]),
    ("[brackets [in] text](a.md) [p](a_(b).md) [q](<a)b.md>)", ["a.md", "a_(b).md", "a)b.md"]),
    ('[t](a.md "it\'s") [u](b.md (p)) [v](c.md "open)', ["a.md", "b.md"]),
    ("> quoted [a](a.md)\n> [b]\n>\n> [b]: b.md", ["a.md", "b.md"]),
    ("- item [a](a.md)\n\n  more [b](b.md)\n\n      [code](c.md)\n\n1. [d](d.md)", ["a.md", "b.md", "d.md"]),
    ("<div>\n[a](a.md)\n</div>\n\n[b](b.md) <span>[c](c.md)</span>", ["b.md", "c.md"]),
    ("<!-- [a](a.md)\n\n[b](b.md) -->\n[c](c.md)", ["c.md"]),
    ("# Head [a](a.md)\ntext <https://x.org/[b](b.md)> <i title=\"[c](c.md)\">", ["a.md"]),
    ("[a](x.md?q=1#f) [e]() [f](&auml;.md)", ["x.md?q=1#f", "", "ä.md"]),
    ("text\n[a]: not-a-definition.md\n[a]", []),
    ("[a]: first.md\n[A]: second.md\n\n[a]", ["first.md"]),
    ("| [a](a.md) | b |\n|---|---|\n| [c](c.md) | d |", ["a.md", "c.md"]),
    ("> ```\n> [a](a.md)\n> ```\n> [b](b.md)\n\n> ```\n> [c](c.md)\n\n[d](d.md)", ["b.md", "d.md"]),
    ("", []),
]


@pytest.mark.parametrize("body,want", CASES)
def test_references(body, want):
    assert [("!" if r["image"] else "") + r["dest"] for r in references(body)] == want


def test_long_texts_take_linear_time():
    assert references("[" * 50_000 + "a](b.md)") == [{"dest": "b.md", "image": False}]
    assert references("[a](" * 20_000) == [] and references("x `" * 20_001 + "[a](b.md)") == [{"dest": "b.md", "image": False}]
    assert references("x " + "<" * 20_000 + "[a](b.md)") == references("*" * 20_000 + "[a](b.md)") == [{"dest": "b.md", "image": False}]


def test_simple_texts_are_read_in_the_jvm_as_the_parser_reads_them(spark):
    rng = random.Random(11)
    bits = ["[a](b.md)", "![i](c.png)", "[x](d.md \"t\")", "`code`", "`[no](n.md)`", "text", " ", "\n", "\n\n", "    ", "- ", "> ", "1. ", "# ", "[", "]", "(", ")", "`", "``", "\\", "<b>", "&amp;", "[a](`b`)", "[`t`](e.md)", "[a]()", "[a] (b)", "[r]: u.md\n", "[r]", "\t", "!", "[x](f.md)(g)", "*[e](h.md)*", "| [t](i.md) |", "~~~", "[a\nb](j.md)", "-     [x](k.md)", "é[ü](l.md)", "[a](m%20n.md?q=1#f)", "[ ](o.md)", "[a](p.md \"t)", "====", "---\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(6000)] + ["", None, "[a](b)[c](d)![e](f)"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4)
    rows = frame.select("k", "t", commonmark.parsed_references(F.col("t")).alias("r"), F.coalesce(F.col("t").contains("[") & commonmark._simple(F.col("t")), F.lit(False)).alias("simple")).collect()
    for r in rows:
        assert [(x["dest"], x["image"]) for x in r["r"]] == [(x["dest"], x["image"]) for x in commonmark.references(r["t"])], r["t"]
    assert sum(r["simple"] for r in rows) > 600
