"""Files of any type to blocks: a scan of bytes, dispatch by type, one row a file.

What cannot be read becomes a row with the code of its refusal, so a broken file
fails neither its task nor the job.  Extractors that need a library or a service
(text of PDF pages, recognition of pictures) are injected.
"""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.sources import parsers, records

#: Bytes of a pdf -> texts of its pages; bytes of a picture or a scan -> (page, text) in any order.
Extractor = Callable[[bytes], list[str]]
Recognizer = Callable[[bytes], list[tuple[int, str]]]
#: Refusals that a later try may not meet again.
RETRYABLE = ("ocr_unavailable", "parse_timeout")
#: kind, level, text, page, key.
Block = tuple[str, int | None, str, int | None, str | None]

_BLOCKS = "array<struct<kind:string,level:int,text:string,page:int,key:string>>"
_KINDS = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("page", pa.int32()), ("key", pa.string())]))


class Refused(Exception):
    """A file that gives no blocks: the code, and what there is to say."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Readers:
    """What reads the types that need more than the standard library; without one their files are refused."""

    pdf: Extractor | None = None
    ocr: Recognizer | None = None


def scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, name, length and content of the files below ``path``, those whose name fits ``pattern`` if given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise Refused("no_extractable_text", f"the file is not UTF-8: {error.reason}") from None


def _paragraphs(text: str) -> list[Block]:
    return [("paragraph", None, p.strip(), None, None) for p in parsers.blank_lines(text) if p.strip()]


def _plain(found: list[tuple[str, int | None, str]]) -> list[Block]:
    return [(*b, None, None) for b in found]


def _leaves(value: object, path: tuple[str, ...] = ()) -> Iterator[str]:
    """``path.to.leaf: value`` of a JSON value; lists of plain values on one line, null says nothing."""
    if isinstance(value, dict) and len(path) < records.DEEPEST:
        for name, inner in sorted(value.items()):
            yield from _leaves(inner, (*path, name))
    elif isinstance(value, list) and not any(isinstance(x, dict | list) for x in value):
        yield from _leaf(path, ", ".join(_said(x) for x in value if x is not None))
    elif isinstance(value, list) and len(path) < records.DEEPEST:
        for i, inner in enumerate(value, 1):
            yield from _leaves(inner, (*path, str(i)))
    elif value is not None:
        yield from _leaf(path, _said(value))


def _leaf(path: tuple[str, ...], text: str) -> Iterator[str]:
    if text.strip():
        yield f"{'.'.join(path) or 'value'}: {text}"


def _said(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _named(value: object, otherwise: str) -> str:
    named = (value[k] for k in records.KEY_FIELDS if k in value) if isinstance(value, dict) else ()
    return next((_said(v).strip() for v in named if (isinstance(v, str) and v.strip()) or (isinstance(v, int | float) and not isinstance(v, bool))), otherwise)


def json_records(text: str) -> list[Block]:
    """A record of every item of a list, of every value of an object of objects, or of the whole."""
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        raise Refused("no_extractable_text", "the file is not valid JSON") from None
    if isinstance(whole, list):
        pairs = [(_named(x, f"record {i}"), x) for i, x in enumerate(whole, 1)]
    elif isinstance(whole, dict) and all(isinstance(x, dict) for x in whole.values()):
        pairs = sorted(whole.items())
    else:
        pairs = [(_named(whole, "record 1"), whole)]
    return _of_records((key, "\n".join(_leaves(x))) for key, x in pairs)


def csv_records(text: str) -> list[Block]:
    """A record of every row, ``name: value`` of its filled cells, called by its key column or its number."""
    lines = text.splitlines()
    head = lines[0] if lines else ""
    delimiter = max(",;\t", key=lambda d: (head.count(d), d != ",", d == "\t"))
    try:
        rows = list(csv.reader(io.StringIO(text), delimiter=delimiter if delimiter in head else ",", strict=True))
    except csv.Error as error:
        raise Refused("no_extractable_text", f"the file is not readable as CSV: {error}") from None
    names = [n.strip() or f"column {i}" for i, n in enumerate(rows[0], 1)] if rows else []

    def each() -> Iterator[tuple[str, str]]:
        for number, row in enumerate(rows[1:], 1):
            cells = {n: c.strip() for n, c in zip(names, row, strict=False) if c.strip()}
            low = {n.lower(): c for n, c in reversed(cells.items())}
            yield next((low[k] for k in records.KEY_FIELDS if k in low), f"row {number}"), "\n".join(f"{n}: {c}" for n, c in cells.items())

    return _of_records(each())


def _of_records(pairs: Iterator[tuple[str, str]]) -> list[Block]:
    found = [("record", None, text, None, key) for key, text in pairs if text.strip()]
    if len(found) > parsers.MOST_RECORDS:
        raise Refused("file_too_large", f"{len(found)} records")
    return found


def _pages(pages: list[tuple[int, str]]) -> list[Block]:
    if len(pages) > parsers.MOST_PAGES:
        raise Refused("file_too_large", f"{len(pages)} pages")
    return [("paragraph", None, p.strip(), number, None) for number, text in sorted(pages) for p in parsers.blank_lines(text) if p.strip()]


def _recognized(content: bytes, readers: Readers) -> list[Block]:
    if readers.ocr is None:
        raise Refused("no_extractable_text", "only pictures, and nothing to read them")
    try:
        return _pages(readers.ocr(content))
    except (ConnectionError, TimeoutError) as error:  # of the service, not of the file: may be tried again
        raise Refused("ocr_unavailable", str(error)) from None


def _chars(blocks: list[Block]) -> int:
    return sum(len(b[2].strip()) for b in blocks)


def blocks_of(kind: str | None, content: bytes, readers: Readers) -> tuple[list[Block], bool]:
    """The blocks of a file of a type, and whether they were recognized on pictures; Refused if there are none."""
    recognized = False
    match kind:
        case "text":
            found = _paragraphs(_decoded(content))
        case "markdown":
            found = _plain(parsers.markdown_blocks(_decoded(content)))
        case "html":
            found = _plain(parsers.html_blocks(_decoded(content)))
        case "json":
            found = json_records(_decoded(content))
        case "csv":
            found = csv_records(_decoded(content))
        case "docx":
            if parsers.docx_size(content) > parsers.MOST_XML:
                raise Refused("file_too_large", "its text is too large")
            found = _plain(parsers.docx_blocks(content))
        case "pdf":
            found = _pages(list(enumerate(readers.pdf(content), 1))) if readers.pdf else []
            if _chars(found) < parsers.LEAST_CHARS:  # a scan
                found, recognized = _recognized(content, readers), True
        case "image":
            found, recognized = _recognized(content, readers), True
        case _:
            raise Refused("unsupported_file_type", "nothing reads files of this type")
    if not found or (recognized and _chars(found) < parsers.LEAST_CHARS):
        raise Refused("no_extractable_text", "the file holds no text")
    return found, recognized


def parse(files: DataFrame, readers: Readers = Readers(), most_seconds: float = parsers.MOST_SECONDS, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The columns ``keep``, name, source_type, title, blocks, ocr, error and message of every file (name, content).

    The type follows the first bytes, and the name where they say nothing.  A file that
    is refused, breaks its reader or takes longer than ``most_seconds`` has no blocks
    but an error code; only ``ocr_unavailable`` and ``parse_timeout`` are worth another
    try.  A null content counts as empty.  Files are read one at a time, nothing is shuffled.
    """
    n = len(keep)
    typed = files.select(*keep, "name", F.coalesce(fn.type_by_magic("content"), fn.type_by_name("name")).alias("source_type"), F.coalesce("content", F.lit(b"")).alias("content"))
    schema = f"{', '.join(f'`{k}` {files.schema[k].dataType.simpleString()}' for k in keep)}{', ' if keep else ''}name string, source_type string, title string, blocks {_BLOCKS}, ocr boolean, error string, message string"
    names = [*keep, "name", "source_type", "title", "blocks", "ocr", "error", "message"]

    def one(kind: str | None, content: bytes) -> tuple[list[Block] | None, bool, str | None, str | None]:
        began = time.monotonic()
        try:
            found, recognized = blocks_of(kind, content, readers)
        except Refused as refused:
            return None, False, refused.code, str(refused)
        except Exception as error:  # noqa: BLE001  whatever a broken file does to its reader
            return None, False, "no_extractable_text", f"{type(error).__name__}: {error}"
        if (took := time.monotonic() - began) > most_seconds:
            return None, False, "parse_timeout", f"{took:.0f} seconds"
        return found, recognized, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                name, kind, content = (row.column(n + k)[0].as_py() for k in range(3))
                found, recognized, error, message = one(kind, content)
                title = (name or "").rpartition(".")[0] or name
                blocks = None if found is None else [dict(zip(("kind", "level", "text", "page", "key"), b, strict=True)) for b in found]
                rest = [pa.array([title], pa.string()), pa.array([blocks], _KINDS), pa.array([recognized]), pa.array([error], pa.string()), pa.array([message], pa.string())]
                yield pa.RecordBatch.from_arrays([*row.columns[: n + 2], *rest], names=names)

    return typed.mapInArrow(run, schema)
