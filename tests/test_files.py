"""Files of all types come back as chunks, broken ones as rows that say why."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from corpusmill.plans import answer
from corpusmill.sources import files, parsers

SF = "/root/testdata/sf0.001"


def _read_pdf(content):
    if b"loop" in content:
        raise RecursionError("the page tree has no end")
    return content[8:].decode().split("\f")


def _recognize(content):
    if content.endswith(b"down"):
        raise ConnectionError("no answer")
    return [(2, "second page of the picture"), (1, "first page of the picture\n\nand more of it")]


READERS = files.Readers(pdf=_read_pdf, ocr=_recognize)


def test_files_from_the_tables_are_scanned_and_chunked(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(10).collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(10)
    for d in docs:
        (tmp_path / "text").mkdir(exist_ok=True)
        (tmp_path / "text" / f"{d['doc_id']}.txt").write_text(d["text"])
        (tmp_path / f"{d['doc_id']}.pdf").write_bytes(b"%PDF-1.7" + ("\f".join([d["text"], "the last page"])).encode())
    for p in pages:
        (tmp_path / f"{p['page_id']}.html").write_text(p["html"])
    for r in parsers.make_docx(items, "item_id", "text").collect():
        (tmp_path / f"{r['item_id']}.docx").write_bytes(bytes(r["content"]))
    (tmp_path / "courses.json").write_text('[{"id": "rust", "hours": 12}, {"name": "go", "tags": ["a", "b"], "deep": {"x": null, "y": [{"z": true}]}}]')
    (tmp_path / "prices.csv").write_text('sku;name;;price\nA1;"screw; long";x;3\n;nut;;\n;;;\nB2;bolt\n')
    (tmp_path / "guide.md").write_text("# Guide\n\ntext one\n\n## Part\n\ntext two")
    (tmp_path / "photo.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"...")
    for name, content in {"bad.json": b"{", "bad.docx": b"PK\3\4 broken", "loop.pdf": b"%PDF-1.7 loop", "late.png": bytes.fromhex("FFD8FF") + b"down", "empty.txt": b" \n ", "latin.txt": b"caf\xe9", "what.bin": b"?", "noext": b"?", "bad.csv": b'a,b\n"x"y,2'}.items():
        (tmp_path / name).write_bytes(content)
    chunks, lost = answer.ingest_files(files.scan(spark, f"file://{tmp_path}"), READERS)
    name = F.element_at(F.split("doc_id", "/"), -1)
    rows = chunks.withColumn("name", name).collect()
    by_name: dict[str, list] = {}
    for r in rows:
        by_name.setdefault(r["name"], []).append(r)
    assert {r["name"]: (r["error"], r["retryable"]) for r in lost.collect()} == {
        "bad.json": ("no_extractable_text", False), "bad.docx": ("no_extractable_text", False), "loop.pdf": ("no_extractable_text", False), "late.png": ("ocr_unavailable", True), "empty.txt": ("no_extractable_text", False),
        "latin.txt": ("no_extractable_text", False), "what.bin": ("unsupported_file_type", False), "noext": ("unsupported_file_type", False), "bad.csv": ("no_extractable_text", False),
    }
    assert all(f"{d['doc_id']}.txt" in by_name for d in docs) and all(f"{p['page_id']}.html" in by_name for p in pages)
    assert sum(n.endswith(".docx") for n in by_name) == 10
    assert all({r["page"] for r in by_name[f"{d['doc_id']}.pdf"]} >= {1} for d in docs)
    assert [r["heading_path"] for r in sorted(by_name["guide.md"], key=lambda r: r["chunk_index"])] == [["Guide"], ["Guide", "Part"]]
    assert {r["record_key"]: r["content"].split("\n", 1)[1] for r in by_name["courses.json"]} == {"rust": "hours: 12\nid: rust", "go": "deep.y.1.z: true\nname: go\ntags: a, b"}
    assert {r["record_key"]: r["content"].split("\n", 1)[1] for r in by_name["prices.csv"]} == {"A1": "sku: A1\nname: screw; long\ncolumn 3: x\nprice: 3", "nut": "name: nut", "B2": "sku: B2\nname: bolt"}
    assert by_name["photo.png"][0]["page"] == 1 and "first page of the picture" in by_name["photo.png"][0]["content"] and by_name["photo.png"][0]["title"] == "photo"
    assert files.scan(spark, f"file://{tmp_path}", "*.md").count() == 1


def _codes(spark, rows, **options):
    frame = spark.createDataFrame([(n, c, 1) for n, c in rows], "name string, content binary, error int")
    return {r["name"]: (r["error"], r["ocr"], len(r["blocks"] or [])) for r in files.parse(frame, keep=(), **options).collect()}


def test_limits_scans_and_nulls(spark):
    long = b"%PDF-1.7" + b"\f".join(b"page" for _ in range(parsers.MOST_PAGES + 1))
    scan = b"%PDF-1.7 \f"
    rows = [("long.pdf", long), ("scan.pdf", scan), ("null.txt", None), (None, b"text"), ("x.TXT", b"\xef\xbb\xbfa\r\n\r\nb"), ("scalar.json", b"7"), ("none.json", b"null"), ("empty.json", b"[]"), ("deep.json", b"[" * 20_000), ("head.csv", b"a,b\n")]
    assert _codes(spark, rows, readers=READERS) == {
        "long.pdf": ("file_too_large", False, 0), "scan.pdf": (None, True, 3), "null.txt": ("no_extractable_text", False, 0), None: ("unsupported_file_type", False, 0), "x.TXT": (None, False, 2), "scalar.json": (None, False, 1),
        "none.json": ("no_extractable_text", False, 0), "empty.json": ("no_extractable_text", False, 0), "deep.json": ("no_extractable_text", False, 0), "head.csv": ("no_extractable_text", False, 0),
    }
    assert _codes(spark, [("scan.pdf", scan), ("p.png", bytes.fromhex("89504E470D0A1A0A"))]) == {"scan.pdf": ("no_extractable_text", False, 0), "p.png": ("no_extractable_text", False, 0)}
    assert _codes(spark, []) == {}

    def slow(content):
        time.sleep(0.2)
        return ["a page with text enough for a page, is it not"]

    assert _codes(spark, [("slow.pdf", b"%PDF-1.7")], readers=files.Readers(pdf=slow), most_seconds=0.1) == {"slow.pdf": ("parse_timeout", False, 0)}


@pytest.mark.parametrize("text, wanted", [("{}", []), ('{"a": {"x": 1}, "b": {"y": 2}}', ["a", "b"]), ('{"a": {"x": 1}, "b": 2}', ["record 1"]), ('[1, [], {"title": " t "}, {"id": true}]', ["record 1", "t", "record 4"])])
def test_json_records_are_called_by_what_names_them(text, wanted):
    assert [b[4] for b in files.json_records(text)] == wanted
