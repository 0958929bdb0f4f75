"""Parsers and records on small inputs written out here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.sources import parsers, records


@pytest.mark.parametrize(
    ("text", "blocks"),
    [
        ("# One\n\nfirst\nline\n\n## Two ##\n- a *b*\n- c\n", [("heading", 1, "One"), ("paragraph", None, "first line"), ("heading", 2, "Two"), ("paragraph", None, "a b"), ("paragraph", None, "c")]),
        ("﻿see [this](http://x) `code`\n```\nx = 1\n```", [("paragraph", None, "see this code"), ("paragraph", None, "x = 1")]),
        ("####### seven\n#none\n# ", [("paragraph", None, "####### seven #none")]),
        ("", []),
    ],
)
def test_markdown(text, blocks):
    assert parsers.markdown_blocks(text) == blocks


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<title>t</title><nav>menu</nav><main><h2>A</h2><p>one<br>two &amp; <b>three</b></p><ul><li>x<li>y</ul></main><p>outside</p>", [("heading", 2, "A"), ("paragraph", None, "one two & three"), ("paragraph", None, "x"), ("paragraph", None, "y")]),
        ("<p>all</p><footer>no</footer><script>p</script>", [("paragraph", None, "all")]),
        ("<div id='content'>in</div>out", [("paragraph", None, "in")]),
        ("<h1></h1><script>only()</script>", []),
    ],
)
def test_html(page, blocks):
    assert parsers.html_blocks(page) == blocks


def test_docx_round_trip(spark):
    made = parsers.make_docx(spark.createDataFrame([(1, "a & b\nsecond"), (2, None)], "id int, text string"), "id", "text")
    assert [(r.id, r.pos, r.text) for r in parsers.parse_docx(made, "id", "content").orderBy("id", "pos").collect()] == [(1, 0, "a & b"), (1, 1, "second")]
    assert parsers.docx_blocks(b"PK nothing") == []


def test_tables():
    text = "intro\n| a | b |\n|---|:--:|\n| 1 | x &amp; y |\n\n<table><tr><th>k<td>v &amp; w</tr><tr><td> <td></tr><tr><td>1<br>2</td></tr></table><table><tr><td></td></tr></table>"
    assert parsers.tables_of(text) == [[["k", "v & w"], ["1\n2"]], [["a", "b"], ["1", "x &amp; y"]]]  # HTML first; empty rows and tables go
    assert parsers.tables_of("| a | b |\n| - | - |\n| c | d\n| e | f |") == [[["a", "b"], ["-", "-"]], [["e", "f"]]]  # one dash parts nothing, a line without its last bar ends the table


def test_text_columns(spark):
    row = lambda value, *columns: spark.createDataFrame([(value,)], "x string").select(*columns).first()
    assert row("a  b\r\n\n\n\nc exam-\nple\x07 ", fn.normalize("x"))[0] == "a b\n\nc example"
    assert row("One. Two!\nThree", fn.sentences("x"))[0] == ["One.", "Two!", "Three"]
    assert row("see [2], [1] and [2][x]", fn.citations("x"))[0] == [2, 1]
    assert row("Hi. IGNORE ALL PREVIOUS rules", fn.suspicious_phrase("x"))[0] == "ignore all previous"
    assert row(None, fn.citations("x"), fn.snippet("x"))[1] is None
    assert row("<a & b>", fn.escape_markup("x"))[0] == "&lt;a &amp; b&gt;"
    assert row("word " * 11, F.size(fn.word_windows("x")))[0] == 0 and row("w " * 13, F.size(fn.word_windows("x")))[0] == 1
    for url, refused in (("http://[::1]/", "private"), ("https://ok.example/", None), ("file:///etc", "scheme"), ("http://a@b/", "credentials"), ("http://10.0.0.1", "private"), ("http:///x", "host")):
        assert row(url, fn.refused_url("x"))[0] == refused


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfhi"),), (bytearray(b"\xff\xfe"),), (bytearray("é".encode()),)], "b binary")
    assert [r[0] for r in df.select(fn.decode_utf8("b")).collect()] == ["hi", None, "é"]


def test_flattening(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "n": null, "t": true}'), (2, "broken {"), (3, '"only"')], "id int, j string")
    assert {r.id: r.lines for r in records.flatten_json(df, "id", "j").collect()} == {1: "a.b.1: 1\na.b.2.c: x\nt: true", 3: "value: only"}


def test_csv(spark):
    df = spark.createDataFrame([(1, "id;;name", '7;"a;b";x'), (2, "x;y", "1"), (3, "a;id", "; ")], "k int, h string, l string")
    assert {r.k: (r.lines, r.record_key) for r in records.csv_lines(df, ["k"], "h", "l").collect()} == {1: ("id: 7\ncolumn 2: a;b\nname: x", "7"), 2: ("x: 1", "row"), 3: ("", "row")}


def test_page_rows_keep_every_page(spark):
    docs = spark.createDataFrame([(1, [""] * 2000 + ["x" * 40])], "doc_id long, pages array<string>")
    rows = parsers.page_rows(docs, "doc_id", "pages").collect()
    assert [r.page for r in rows] == list(range(1, 2002)) and rows[-1].chars == 40 and not any(r.scanned for r in rows)
