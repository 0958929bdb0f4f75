"""Parsers from bytes, texts and pages to block rows.

Every parser takes a DataFrame with an id and a content column and returns one row
per block: id, pos, kind (heading, paragraph or record), level, text and page.
What cannot be parsed gives no rows; parsing errors never fail a job.  Plain
texts and page lists are parsed in SQL functions; formats with a grammar of their
own stream through Arrow, in small per-row helpers on the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as fn
from corpusmill.sources import tables

#: Source type -> parser, and the limits of a document.
PARSERS = {"text": "text", "markdown": "markdown", "html": "html", "json": "json", "csv": "csv", "pdf": "pdf", "docx": "docx", "image": "image"}
LEAST_CHARS, MOST_XML = 32, 64 << 20

_BLOCK_FIELDS = [T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]


# fixed values: pages, records and seconds that a file may take
MOST_PAGES, MOST_RECORDS, MOST_SECONDS = 2000, 100_000, 120


def refusal(kind: Column, text: Column, pages: Column, records: Column, seconds: Column, xml_bytes: Column, can_ocr: Column) -> Column:
    """The code under which a file is refused, null for one that is taken; null counts are within their limits.

    What cannot be read at all comes first, then what is too large or took too long, and
    last what holds no text, or only on pictures while nothing can recognize it.
    """
    large = F.coalesce(pages > MOST_PAGES, F.lit(False)) | F.coalesce(records > MOST_RECORDS, F.lit(False)) | F.coalesce(xml_bytes > MOST_XML, F.lit(False))
    return (
        F.when(kind.isNull(), "unsupported_file_type")
        .when(large, "file_too_large")
        .when(F.coalesce(seconds > MOST_SECONDS, F.lit(False)), "parse_timeout")
        .when(((kind == "image") & ~F.coalesce(can_ocr, F.lit(False))) | (fn.strip(F.coalesce(text, F.lit(""))) == ""), "no_extractable_text")
    )


# fixed values: records, blocks and pages whose text tells the language
SAMPLED = {"record": 20, "block": 40, "page": 5}


def language_sample(parts: Column, kind: str) -> Column:
    """The text that a file's language is told from: its first parts, as many as fit their kind."""
    return F.array_join(F.slice(parts, 1, SAMPLED[kind]), "\n")


def parser_for(source_type: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.col(source_type) if isinstance(source_type, str) else source_type), F.lit("unsupported"))


def _blocks(df: DataFrame, id_col: str, content_col: str, parse: Callable[[object], list[tuple[str, int | None, str]]]) -> DataFrame:
    schema = T.StructType([df.schema[id_col], *_BLOCK_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, rows = [], []
                for i, content in enumerate(some.column(1).to_pylist()):
                    for pos, (kind, level, text) in enumerate(parse(content) if content is not None else []):
                        ids.append(i)
                        rows.append((pos, kind, level, text))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int32(), pa.string(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(ids)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return df.select(id_col, content_col).mapInArrow(run, schema)


def parse_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs of plain text, parted by blank lines; empty texts give none."""
    found = df.select(id_col, F.posexplode(fn.paragraphs(fn.normalize(text_col))).alias("pos", "text"))
    return found.select(id_col, "pos", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), "text")


def blank_lines(text: str) -> list[str]:
    """A text's paragraphs as ``parse_text`` parts them: at blank lines, after white space is made plain."""
    text = re.sub(r"[\x00-\x08\x0B-\x1F\x7F]", "", re.sub(r"\r\n?", "\n", text))
    return re.split(r"\n{2,}", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", text)))


def text_blocks(text_col: str) -> Column:
    """The same paragraphs as one array of blocks, which chunking takes as it is."""
    return F.transform(fn.paragraphs(fn.normalize(text_col)), lambda p: F.struct(F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), p.alias("text")))


_INLINE = [(re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"(\*\*|__)(.+?)\1"), r"\2"), (re.compile(r"(?<!\w)([*_])(\S.*?\S|\S)\1(?!\w)"), r"\2"), (re.compile(r"`([^`]*)`"), r"\1")]
_ITEM = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,9}[.)])\s+(.*)$")


def markdown_blocks(text: str) -> list[tuple[str, int | None, str]]:
    """Headings, paragraphs, list items and code of a Markdown text, inline marks dropped."""
    out: list[tuple[str, int | None, str]] = []
    run: list[str] = []
    fence = None

    def close() -> None:
        joined = " ".join(x.strip() for x in run).strip()
        for pattern, by in _INLINE:
            joined = pattern.sub(by, joined)
        if joined:
            out.append(("paragraph", None, joined))
        run.clear()

    code: list[str] = []
    for line in text.lstrip("﻿").replace("\r\n", "\n").split("\n"):
        mark = re.match(r"^\s{0,3}(```+|~~~+)", line)
        if fence is not None:
            if mark and mark[1].startswith(fence):
                if "\n".join(code).strip():
                    out.append(("paragraph", None, "\n".join(code)))
                fence, code = None, []
            else:
                code.append(line)
        elif mark:
            close()
            fence = mark[1]
        elif heading := re.match(r"^\s{0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$", line):
            close()
            if heading[2].strip():
                out.append(("heading", len(heading[1]), heading[2].strip()))
        elif item := _ITEM.match(line):
            close()
            run.append(item[1])
        elif not line.strip():
            close()
        else:
            run.append(line)
    close()
    if "\n".join(code).strip():
        out.append(("paragraph", None, "\n".join(code)))
    return out


def parse_markdown(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _blocks(df, id_col, text_col, markdown_blocks)


# fixed values: what is never text, what ends a block, and where the text begins
_FURNITURE = frozenset("script style noscript template nav header footer aside form iframe svg button".split())
_BREAKS = frozenset("p div section article main li ul ol table tr td th blockquote pre dl dt dd figure figcaption hr body".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.blocks: list[tuple[str, int | None, str]] = []
        self.inside: list[int] = []  # per block: 0 in the root, 1 outside
        self.run: list[str] = []
        self.heading: int | None = None
        self.skip = self.root = 0
        self.title: str | None = None
        self.in_title = False

    def close_run(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.blocks.append(("heading" if self.heading else "paragraph", self.heading, text))
            self.inside.append(0 if self.root else 1)
        self.run.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.run.append(" ")
            return
        if tag == "title":
            self.in_title = True
        level = int(tag[1]) if re.fullmatch(r"h[1-6]", tag) else None
        if level or tag in _BREAKS:
            self.close_run()
        if level:
            self.heading = level
        if tag in _VOID:
            return
        values = dict(attrs)
        root = tag in ("main", "article") or values.get("role") == "main" or values.get("id") == "content" or "content" in (values.get("class") or "").split()
        self.stack.append((tag, root))
        self.skip += tag in _FURNITURE
        self.root += root

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if all(t != tag for t, _ in self.stack):
            return
        if re.fullmatch(r"h[1-6]", tag) or tag in _BREAKS:
            self.close_run()
            self.heading = None
        while self.stack:
            name, root = self.stack.pop()
            self.skip -= name in _FURNITURE
            self.root -= root
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.skip and all(t != "head" for t, _ in self.stack):
            self.run.append(data)


def html_blocks(page: str) -> list[tuple[str, int | None, str]]:
    """Headings and paragraphs inside the page's main element, or of its body without one."""
    reader = _Page()
    reader.feed(page)
    reader.close()
    reader.close_run()
    inside = [b for b, out in zip(reader.blocks, reader.inside, strict=True) if not out]
    return inside or reader.blocks


def parse_html(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return _blocks(df, id_col, html_col, html_blocks)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_size(content: bytes) -> int:
    """Bytes of a Word file's text as it says itself; 0 if there is none to read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.getinfo("word/document.xml").file_size
    except (KeyError, zipfile.BadZipFile, OSError):
        return 0


def docx_blocks(content: bytes) -> list[tuple[str, int | None, str]]:
    """Paragraphs and headings of a Word file; none if it is broken or too large."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            info = archive.getinfo("word/document.xml")
            if info.file_size > MOST_XML:
                return []
            tree = ElementTree.fromstring(archive.read(info))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, OSError):
        return []
    out = []
    for paragraph in tree.iter(f"{_W}p"):
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading\s?([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        text = " ".join("".join(" " if x.tag in (f"{_W}tab", f"{_W}br") else x.text or "" for x in paragraph.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).split())
        if text:
            out.append(("heading", int(level[1]), text) if level else ("paragraph", None, text))
    return out


def parse_docx(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return _blocks(df, id_col, content_col, docx_blocks)


def make_docx(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and content: each text as a small Word file, one paragraph a line."""
    schema = T.StructType([df.schema[id_col], T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for text in batch.column(1).to_pylist():
                body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in (text or "").split("\n"))
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as archive:
                    archive.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
                files.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def page_rows(df: DataFrame, id_col: str, pages_col: str) -> DataFrame:
    """id, page (from 1), chars, scanned: whether all pages together have too little text to be more than a scan."""
    pages = F.transform(F.col(pages_col), lambda p: F.char_length(F.trim(p)))
    total = F.aggregate(pages, F.lit(0), lambda a, n: a + n)
    return df.select(id_col, (total < LEAST_CHARS).alias("scanned"), F.posexplode(pages).alias("pos", "chars")).select(id_col, (F.col("pos") + 1).alias("page"), "chars", "scanned")


def _lines_as_pages(content: bytes) -> list[tuple[int, str]]:
    pages = list(enumerate(content.decode().split("\n"), 1))
    return pages[1::2] + pages[::2]


#: Characters of pages that a task holds before it hands them on, and what a page costs besides its text.
PAGES_HELD, PAGE_COST = 4 << 20, 200


def ocr_pages(df: DataFrame, id_col: str, content_col: str, client: Callable[[bytes], list[tuple[int, str]]] = _lines_as_pages) -> DataFrame:
    """Pages in order from a client that may return them in any: id, page, text, chars, error.

    A client's ValueError is final and becomes an error row; other errors reach
    Spark, which tries the task again.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("chars", T.LongType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            rows, at, held = [], [], 0
            for i in range(batch.num_rows):  # a file at a time
                try:
                    found = [(page, text, len(text), None) for page, text in sorted(client(batch.column(1)[i].as_py() or b""))]
                except ValueError as error:
                    found = [(None, None, None, str(error))]
                rows += found
                at += [i] * len(found)
                held += sum(PAGE_COST + (size or 0) for _, _, size, _ in found)
                if rows and (held >= PAGES_HELD or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)
                    rows, at, held = [], [], 0

    tables.small_batches(df.sparkSession)
    return df.select(id_col, content_col).mapInArrow(run, schema)


def tables_to_text(c: Column | str) -> Column:
    """HTML tables as paragraphs of cells parted by bars; other tags go, references are decoded."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"(?is)<page_number>.*?</page_number>", "")
    c = F.regexp_replace(c, r"(?i)</t[dh]>\s*", " | ")
    c = F.regexp_replace(c, r"(?i)</tr>\s*", "\n\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(c, r"(?m)(?:[ \t]*\|[ \t]*)+$", "")
    for mark, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(by))
    return fn.strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")
            self.cell = True
        elif tag == "br" and self.cell:
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.cell = False

    def handle_data(self, data: str) -> None:
        if self.cell and self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] += data


#: A tag without attributes, and the elements whose text may hold tags that are none.
_BARE, _RAW = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)>"), {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _read_tables(text: str) -> list[list[list[str]]]:
    """The rows of a text's HTML tables; a text of bare tags only, without references, is read without the parser's states."""
    reader = _Tables()
    pieces = _BARE.split(text)  # text and tags in turn
    tags = [tag.lower() for tag in pieces[1::2]]
    if "&" in text or text.count("<") != len(tags) or not _RAW.isdisjoint(tags):
        reader.feed(text)
        reader.close()
        return reader.tables
    for tag, after in zip(tags, pieces[2::2], strict=True):
        if tag[0] == "/":
            reader.handle_endtag(tag[1:])
        else:
            reader.handle_starttag(tag, ())
        if after and reader.cell:
            reader.handle_data(after)
    return reader.tables


def tables_of(text: str) -> list[list[list[str]]]:
    """HTML tables and then Markdown pipe tables of a text, as rows of trimmed cells.

    Rows of HTML whose cells are all empty go, and tables without rows.  A line is of
    a pipe table if a bar begins and ends it; a line of two dashes or more a cell parts
    the head from the body.
    """
    found: list[list[list[str]]] = []
    if "<table" in text:
        kept = ([[c.strip() for c in row] for row in table if any(c.strip() for c in row)] for table in _read_tables(text))
        found = [table for table in kept if table]
    now: list[list[str]] = []
    for line in [*text.splitlines(), ""] if "|" in text else ():
        line = line.strip()
        if line.startswith("|") and line.endswith("|"):
            cells = [x.strip() for x in line.strip("|").split("|")]
            if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                now.append(cells)
        elif now:
            found.append(now)
            now = []
    return found


def table_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, table, row, cells of every table row of a document."""
    schema = T.StructType([df.schema[id_col], T.StructField("table", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, table in enumerate(tables_of(text) if text else []):
                    rows += [(k, r, cells) for r, cells in enumerate(table)]
                    at += [i] * len(table)
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def with_tables(df: DataFrame, text_col: str, name: str = "tables") -> DataFrame:
    """``df`` and all tables of each row's text in one column, as rows of cells: what needs a document's rows together takes no shuffle."""
    kind = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
    at, names = df.columns.index(text_col), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([tables_of(text) if text else [] for text in batch.column(at).to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))
