"""Fetching in rounds against a client, and learned languages on held-out texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import fetch, language
from corpusmill.queries import Tables

SF = "/root/testdata/sf0.01"


def _site(url: str):
    """A small web: /n leads to /n-1, /0 is a page; pieces of a body come one by one."""
    path = url.removeprefix("https://site.example/")
    if path.isdigit() and int(path):
        return 301, {"location": str(int(path) - 1)}, []
    if path == "inward":
        return 302, {"location": "//127.0.0.1/admin"}, []
    if path == "broken":
        return 302, {"location": "http://[oops"}, []
    if path == "liar":
        return 200, {"content-length": "5"}, iter([b"x" * 600] * 1000)
    if path == "declared":
        return 200, {"content-length": "99999999"}, _never()
    if path == "down":
        raise ConnectionError("no route")
    if path == "empty":
        return 200, {}, []
    return (200, {"content-type": "text/html"}, [b"he", b"llo"]) if path == "0" else (500, {}, [])


def _never():
    raise AssertionError("a body that is declared too large must not be read")
    yield b""


def test_each_hop_is_guarded_and_bodies_are_cut_off(spark):
    paths = ["0", "1", "5", "6", "inward", "broken", "liar", "declared", "down", "empty", "gone", "0"]
    pages = spark.createDataFrame([*[(i, f"https://site.example/{p}") for i, p in enumerate(paths)], (90, None), (91, "file:///etc/passwd"), (92, "not an address")], "page_id long, url string")
    rows = {r.page_id: r for r in fetch.fetch(pages, fetch.by_client(_site, most_bytes=1000)).collect()}
    told = {i: (r.error, r.hops, bytes(r.body) if r.body is not None else None) for i, r in rows.items()}
    refused = ("refused: scheme", 0, None)
    assert told == {
        0: (None, 0, b"hello"), 1: (None, 1, b"hello"), 2: (None, 5, b"hello"), 3: ("redirects", 6, None), 4: ("refused: private", 1, None), 5: ("refused: scheme", 1, None),
        6: ("too large", 0, None), 7: ("too large", 0, None), 8: ("unreachable: no route", 0, None), 9: (None, 0, b""), 10: ("status 500", 0, None), 11: (None, 0, b"hello"), 90: refused, 91: refused, 92: refused,
    }
    assert rows[2].final_url == "https://site.example/0" and rows[3].final_url is None and rows[1].content_type == "text/html"
    assert fetch.fetch(pages.limit(0), fetch.by_client(_site)).count() == 0


def test_languages_are_found_on_held_out_texts(spark):
    docs = Tables(spark, SF).documents.withColumn("margin", F.lit("clashes"))
    held = docs.where("doc_id % 5 = 0")
    model = language.fit(docs.where("doc_id % 5 <> 0"))
    assert model.names == ("de", "en", "es", "fr") and model == language.fit(docs.where("doc_id % 5 <> 0").union(docs.where("doc_id % 5 = 1")))
    for texts in (held, held.withColumn("text", F.regexp_replace(F.substring("text", 1, 60), r"\s+", ""))):
        right = language.detect(texts, model).join(held.select("doc_id", "lang"), "doc_id").agg(F.avg((F.coalesce("guess", F.lit("")) == F.col("lang")).cast("int"))).first()[0]
        assert right >= 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12"), (4, "一二三" * 9), (5, "the and " * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.guess for r in language.detect(odd, model).collect()}.keys() == {1, 2, 3, 4, 5}
    assert all(r.guess is None for r in language.detect(odd.where("doc_id < 5"), model).collect())
    nothing = language.fit(docs.limit(0))
    assert nothing.names == () and all(r.guess is None for r in language.detect(odd, nothing).collect())


def test_a_text_of_several_stretches_has_all_its_runs():
    text = "abcdefg hij" * 20_000
    plain = " ".join(text.split())
    wanted: dict = {}
    for i in range(len(plain) - 2):
        wanted[plain[i : i + 3]] = wanted.get(plain[i : i + 3], 0) + 1
    assert dict(language.runs_of(text)) == wanted
