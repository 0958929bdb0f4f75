"""Sources: type sniffing, decoding, parsing of texts, records and tables, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.operators import fetch, lifecycle, metrics, usage
from corpusmill.queries import Registry, Tables
from corpusmill.sources import files, parsers, records, tables
from corpusmill.sources.objects import ObjectStore, object_key

R = Registry()

_HEADS = ("255044462D312E37", "504B030414", "89504E470D0A1A0A", "FFD8FFE0", "52494646000000005745425056503820", "52494646000000005741564566", "")
_NAMES = ("a.PDF", "b.docx", "c.tar.gz", "d.htm", "noext", "e.Md", "f.heic", "g.jpeg", "h.csv")
_TYPES = ("pdf", "docx", None, "html", None, "markdown", None, "image", "csv")


def _pick(key: str, values: tuple) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _duck_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@R.query(
    "source_type_magic",
    f"""WITH b AS (SELECT doc_id, hex(from_hex({_duck_list(_HEADS)}[(doc_id % {len(_HEADS)} + 1)::INT]) || encode(coalesce(text, ''))) AS h FROM documents)
    SELECT doc_id, CASE WHEN starts_with(h, '255044462D') THEN 'pdf' WHEN starts_with(h, '504B0304') THEN 'docx'
      WHEN starts_with(h, '89504E470D0A1A0A') OR starts_with(h, 'FFD8FF') OR (starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250') THEN 'image' END AS source_type FROM b""",
)
def source_type_magic(t: Tables):
    content = F.concat(F.unhex(_pick("doc_id", _HEADS)), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return t.documents.select("doc_id", fn.type_by_magic(content).alias("source_type"))


@R.query(
    "source_type_ext",
    f"SELECT doc_id, {_duck_list(_NAMES)}[(doc_id % {len(_NAMES)} + 1)::INT] AS name, {_duck_list(_TYPES)}[(doc_id % {len(_NAMES)} + 1)::INT] AS source_type FROM documents",
)
def source_type_ext(t: Tables):
    return t.documents.select("doc_id", _pick("doc_id", _NAMES).alias("name")).withColumn("source_type", fn.type_by_name("name"))


_FILES = ("a.txt", "b.md", "c.csv", "d.json", "e.pdf", "f.html", "g.png", "h.tar", "i.txt")


def _as_files(t: Tables):
    """Every document as a file of one of several types, some of them broken."""
    text = F.coalesce("text", F.lit(""))
    lines = F.concat(F.lit("id;text\n"), F.col("doc_id"), F.lit(';"'), F.regexp_replace(text, '"', ""), F.lit('"\n'))
    body = [
        text, F.concat(F.lit("# Part\n\n"), text), lines, F.to_json(F.struct(F.col("doc_id").alias("id"), text.alias("text"))), F.concat(F.lit("%PDF-1.7"), text),
        F.concat(F.lit("<main><h1>Part</h1><p>"), F.regexp_replace(text, "[<&]", " "), F.lit("</p></main>")), F.concat(F.lit("PNG"), text), text, F.lit("  \n"),
    ]
    kind = F.col("doc_id") % len(_FILES)
    content = F.coalesce(*[F.when(kind == k, b.cast("binary")) for k, b in enumerate(body)])
    broken = F.when((F.col("doc_id") % 4 == 1) & (kind == 0), F.concat(content, F.unhex(F.lit("C328")))).when((F.col("doc_id") % 4 == 1) & (kind == 3), F.concat(content, F.lit("}").cast("binary")))
    return t.documents.select("doc_id", _pick("doc_id", _FILES).alias("name"), F.coalesce(broken, content).alias("content"))


def _read_pages(content: bytes) -> list[str]:
    """The extractor of the query: what follows the mark, pages parted by line feeds; files of few bytes break it."""
    if len(content) < 200:
        raise KeyError("no page tree")
    return content[8:].decode().split("\n")


@R.query(
    "parser_dispatch",
    f"""WITH f AS (SELECT doc_id, {_duck_list(_FILES)}[(doc_id % {len(_FILES)} + 1)::INT] AS name, doc_id % {len(_FILES)} AS k, coalesce(text, '') AS t FROM documents),
    e AS (SELECT *, trim(t, E' \\n\\t') = '' AS empty, doc_id % 4 = 1 AND k IN (0, 3) AS broken FROM f)
    SELECT doc_id, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'csv' WHEN 3 THEN 'json' WHEN 4 THEN 'pdf' WHEN 5 THEN 'html' WHEN 6 THEN 'image' WHEN 8 THEN 'text' END AS source_type,
      CASE WHEN k = 7 THEN 'unsupported_file_type' WHEN k IN (6, 8) OR broken OR (k = 0 AND empty) OR (k = 4 AND strlen(t) + 8 < 200) THEN 'no_extractable_text' END AS error,
      CASE WHEN k IN (1, 5) THEN 'Part' WHEN k IN (2, 3) AND NOT broken THEN doc_id::VARCHAR WHEN k = 4 AND strlen(t) + 8 >= 200 THEN '1' END AS first_block FROM e""",
)
def parser_dispatch(t: Tables):
    """Files of eight types to their parsers: refusals, headings, records with their keys, pages."""
    parsed = files.parse(_as_files(t), files.Readers(pdf=_read_pages), keep=("doc_id",))
    first = F.col("blocks")[0]
    told = F.when(F.col("source_type").isin("markdown", "html"), first["text"]).when(F.col("source_type") == "pdf", first["page"].cast("string")).otherwise(first["key"])
    return parsed.select("doc_id", "source_type", "error", told.alias("first_block"))


@R.query(
    "decode_utf8",
    """SELECT doc_id, doc_id % 5 <> 0 AS valid, CASE WHEN doc_id % 5 <> 0 THEN sha256(coalesce(text, '')) END AS text_sha256 FROM documents""",
)
def decode_utf8(t: Tables):
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(body, F.unhex(F.lit("C328")))).when(F.col("doc_id") % 5 == 1, F.concat(F.unhex(F.lit("EFBBBF")), body)).otherwise(body)
    decoded = t.documents.select("doc_id", fn.decode_utf8(content).alias("decoded"))
    return decoded.select("doc_id", F.col("decoded").isNotNull().alias("valid"), F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256"))


_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"""


@R.query(
    "parse_text",
    f"""WITH n AS (SELECT doc_id, {_NORMAL} AS x FROM documents),
    p AS (SELECT doc_id, [trim(s, E' \\n\\t') FOR s IN string_split(x, chr(10) || chr(10)) IF trim(s, E' \\n\\t') <> ''] AS ps FROM n)
    SELECT doc_id, unnest(range(len(ps))) AS pos, unnest([sha256(s) FOR s IN ps]) AS text_sha256 FROM p""",
)
def parse_text(t: Tables):
    blocks = parsers.parse_text(t.documents.select("doc_id", "text"), "doc_id", "text")
    return blocks.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@R.query("has_headings", r"""SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN '## Part ' || doc_id || chr(10) || text ELSE text END, '(?m)^#{1,6} .*\S') AS has_headings FROM documents""")
def has_headings(t: Tables):
    headed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Part "), F.col("doc_id"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", fn.has_headings(headed).alias("has_headings"))


@R.query("parse_markdown")
def parse_markdown(t: Tables):
    marked = F.concat(F.lit("# Document\n\n"), F.regexp_replace("text", "\n", "\n\n## Part\n\n"))
    return parsers.parse_markdown(t.documents.select("doc_id", marked.alias("text")), "doc_id", "text")


@R.query("parse_html")
def parse_html(t: Tables):
    return parsers.parse_html(t.pages.select("page_id", "html"), "page_id", "html")


@R.query(
    "parse_json",
    """SELECT event_id, j.key AS field, j.value ->> '$' AS value FROM events, json_each(props::JSON) AS j""",
)
def parse_json(t: Tables):
    return records.fields_of(t.events, "event_id", "props").select("event_id", "field", "value")


@R.query("json_record_key", """SELECT event_id, coalesce(nullif(trim(props::JSON->>'id'), ''), nullif(trim(props::JSON->>'key'), ''), nullif(trim(props::JSON->>'name'), ''), 'record ' || (event_id + 1)) AS record_key FROM events""")
def json_record_key(t: Tables):
    return t.events.select("event_id", records.record_key(F.col("props"), F.col("event_id")).alias("record_key"))


@R.query("json_flatten", """SELECT event_id, string_agg(j.key || ': ' || (j.value ->> '$'), chr(10) ORDER BY j.key) AS lines FROM events, json_each(props::JSON) AS j GROUP BY event_id""")
def json_flatten(t: Tables):
    return records.flatten_json(t.events.select("event_id", "props"), "event_id", "props")


@R.query(
    "parse_csv",
    """SELECT p_partkey, 'id: ' || p_partkey || chr(10) || 'name: ' || p_name || chr(10) || 'size: ' || p_size AS lines, p_partkey::VARCHAR AS record_key FROM part""",
)
def parse_csv(t: Tables):
    line = F.concat_ws(";", F.col("p_partkey"), F.col("p_name"), F.lit(""), F.col("p_size"))
    made = t.part.select("p_partkey", F.lit("id;name;remark;size").alias("header"), line.alias("line"))
    return records.csv_lines(made, ["p_partkey"], "header", "line")


@R.query(
    "csv_delimiter",
    r"""WITH h AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a,b;c' WHEN 1 THEN 'a;b;c' WHEN 2 THEN 'a' ELSE E'a,b\tc' END AS header FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ';' WHEN 1 THEN ';' WHEN 2 THEN ',' ELSE chr(9) END AS delimiter FROM h""",
)
def csv_delimiter(t: Tables):
    header = F.element_at(F.array(F.lit("a,b;c"), F.lit("a;b;c"), F.lit("a"), F.lit("a,b\tc")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", fn.csv_delimiter(header).alias("delimiter"))


@R.query("csv_row_key", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'row ' || (p_partkey + 1) ELSE p_name END AS record_key FROM part""")
def csv_row_key(t: Tables):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", records.first_filled([name], F.concat(F.lit("row "), F.col("p_partkey") + 1)).alias("record_key"))


@R.query("field_names", """SELECT event_type, list_sort(list_distinct(list(key))) AS names FROM events, json_each(props::JSON) GROUP BY event_type""")
def field_names(t: Tables):
    return records.fields_of(t.events, "event_id", "props", keep=["event_type"]).groupBy("event_type").agg(F.array_sort(F.collect_set("field")).alias("names"))


@R.query("parse_docx")
def parse_docx(t: Tables):
    """Word files made of the questions, parsed back."""
    return parsers.parse_docx(parsers.make_docx(t.benchmark, "item_id", "text"), "item_id", "content")


@R.query(
    "parse_pdf",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents)
    SELECT doc_id, unnest(range(1, len(pages) + 1)) AS page, unnest([length(trim(x)) FOR x IN pages]) AS chars, list_sum([length(trim(x)) FOR x IN pages]) < 32 AS scanned FROM p""",
)
def parse_pdf(t: Tables):
    """Page rows of an extractor's output (page texts parted by line feeds here)."""
    return parsers.page_rows(t.documents.select("doc_id", F.split("text", "\n").alias("pages")), "doc_id", "pages").withColumn("page", F.col("page").cast("long")).withColumn("chars", F.col("chars").cast("long"))


@R.query("parse_image", """SELECT doc_id, 1 AS page, text FROM documents WHERE length(trim(text)) >= 32""")
def parse_image(t: Tables):
    return t.documents.where(F.char_length(F.trim("text")) >= 32).select("doc_id", F.lit(1).alias("page"), "text")


@R.query(
    "ocr_tables_to_text",
    """SELECT o_orderkey, string_agg(l_linenumber || ' | ' || l_returnflag || ' & co', chr(10) || chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def ocr_tables_to_text(t: Tables):
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber"), F.lit("</td><td>"), F.col("l_returnflag"), F.lit(" &amp; co</td><td></td></tr>"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"))
    page = F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table><page_number>3</page_number>"))
    return t.orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", parsers.tables_to_text(page).alias("text"))


@R.query("ocr_connector", """SELECT doc_id, list_sum([length(x) FOR x IN string_split(text, chr(10))])::BIGINT AS chars, len(string_split(text, chr(10))) AS pages FROM documents""")
def ocr_connector(t: Tables):
    """Pages that an OCR client returns in any order, put in order."""
    return parsers.ocr_pages(t.documents.select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "content").groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.count("*").alias("pages"))


@R.query(
    "url_guard",
    r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ftp://x.example/' WHEN 1 THEN 'http://me:pw@x.example/' WHEN 2 THEN 'http://192.168.0.7:80/a' WHEN 3 THEN 'http://172.32.0.1/' ELSE url END AS url FROM pages)
    SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'credentials' WHEN 2 THEN 'private' END AS refused FROM u""",
)
def url_guard(t: Tables):
    urls = F.when(F.col("page_id") % 5 == 0, "ftp://x.example/").when(F.col("page_id") % 5 == 1, "http://me:pw@x.example/").when(F.col("page_id") % 5 == 2, "http://192.168.0.7:80/a").when(F.col("page_id") % 5 == 3, "http://172.32.0.1/").otherwise(F.col("url"))
    return t.pages.select("page_id", urls.alias("url")).withColumn("refused", fn.refused_url("url"))


@R.query("url_sizes", """SELECT page_id, url, strlen(html) AS bytes, strlen(html) <= 10485760 AS accepted FROM pages""")
def url_sizes(t: Tables):
    return t.pages.select("page_id", "url", F.octet_length("html").cast("long").alias("bytes")).withColumn("accepted", F.col("bytes") <= 10 << 20)


#: How the address of a page number answers: most lead to the next one.
_ANSWER = """CASE WHEN {k} % 17 = 3 THEN 'missing' WHEN {k} % 19 = 4 THEN 'lost' WHEN {k} % 23 = 5 THEN 'inward' WHEN {k} % 29 = 6 THEN 'itself' WHEN {k} % 10 BETWEEN 1 AND 8 THEN 'next' ELSE 'page' END"""


@R.query(
    "url_fetch",
    f"""WITH RECURSIVE a AS (SELECT page_id AS k, {_ANSWER.format(k="page_id")} AS kind, strlen(coalesce(html, '')) AS bytes FROM pages),
    r AS (SELECT page_id, page_id AS k, 0 AS hops FROM pages UNION ALL SELECT r.page_id, CASE kind WHEN 'itself' THEN r.k ELSE r.k + 1 END, hops + 1 FROM r JOIN a ON a.k = r.k WHERE kind IN ('itself', 'next') AND hops < 6),
    l AS (SELECT page_id, max_by(k, hops) AS k, max(hops) AS hops FROM r GROUP BY 1)
    SELECT page_id, CASE WHEN kind = 'inward' AND hops < 6 THEN hops + 1 ELSE hops END::INT AS hops, CASE WHEN hops = 6 THEN 'redirects' WHEN kind IS NULL THEN 'unreachable' WHEN kind = 'missing' THEN 'status 404' WHEN kind = 'lost' THEN 'no location' WHEN kind = 'inward' THEN 'refused: private' END AS error,
      CASE WHEN kind = 'page' AND hops < 6 THEN 'https://pages.example/p/' || l.k END AS final_url, CASE WHEN kind = 'page' AND hops < 6 THEN bytes END AS bytes FROM l LEFT JOIN a ON a.k = l.k""",
)
def url_fetch(t: Tables):
    """Every page by address from a recorded web in which addresses lead on, in circles, inward and nowhere."""
    k, kind = F.col("page_id"), F.expr(_ANSWER.format(k="page_id"))
    location = F.when(kind == "next", F.concat(F.lit("../p/"), k + 1)).when(kind == "itself", F.concat(F.lit("/p/"), k)).when(kind == "inward", "http://169.254.169.254/latest")
    status = F.when(kind == "page", 200).when(kind == "missing", 404).otherwise(302)
    url = F.concat(F.lit("https://pages.example/p/"), k)
    archive = t.pages.select(url.alias("url"), status.alias("status"), location.alias("location"), F.lit("text/html").alias("content_type"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    found = fetch.fetch(t.pages.select("page_id", url.alias("url")), fetch.from_archive(archive))
    return found.select("page_id", "hops", "error", "final_url", F.octet_length("body").cast("long").alias("bytes"))


@R.query("upload_receive", """SELECT doc_id, strlen(text) AS bytes, sha256(text) AS content_hash, strlen(text) <= 10485760 AS within_cap FROM documents""")
def upload_receive(t: Tables):
    size = F.octet_length("text").cast("long")
    return t.documents.select("doc_id", size.alias("bytes"), fn.content_hash("text").alias("content_hash"), (size <= 10 << 20).alias("within_cap"))


@R.query(
    "scan_binary",
    """SELECT source, count(*) AS objects, sum(CASE WHEN doc_id % 5 = 1 THEN strlen(coalesce(text, '')) + 1 ELSE strlen(coalesce(text, '')) END)::BIGINT AS bytes FROM documents WHERE source NOT IN ('src3') AND doc_id % 7 <> 2 GROUP BY source""",
)
def scan_binary(t: Tables):
    """Texts put as objects, a fifth of them put again, some deleted by key and one source's by prefix; then listed."""
    docs = t.documents
    store = ObjectStore(docs.sparkSession, tables.shared(docs.sparkSession, "objects"))
    body = F.coalesce("text", F.lit(""))
    key = object_key(F.lit("org"), F.col("source"), F.col("doc_id"), F.lit(1)).alias("key")
    store.put(docs.select(key, body.alias("content"), F.lit("text/plain").alias("content_type")))
    store.put(docs.where("doc_id % 5 = 1").select(key, F.concat(body, F.lit("!")).alias("content"), F.lit("text/plain").alias("content_type")))
    store.delete(docs.where("doc_id % 7 = 2").select(key))
    store.delete_prefix("tenant/org/src3/")
    return store.listed().groupBy(F.split("key", "/")[2].alias("source")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@R.query("metrics_sink", """SELECT le, (SELECT count(*) FROM events WHERE value / 5 <= le) AS observations FROM (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5, 3.0, 6.0, 15.0, 30.0, 60.0])::DOUBLE AS le)""")
def metrics_sink(t: Tables):
    return lifecycle.cumulative_histogram(t.events.select((F.col("value") / 5).alias("seconds")), "seconds", usage.LATENCY)


@R.query("metrics_observed", """SELECT le, (SELECT count(*) FROM events WHERE value / 5 <= le) AS observations, (SELECT count(*) FROM events) AS written FROM (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5, 3.0, 6.0, 15.0, 30.0, 60.0])::DOUBLE AS le)""")
def metrics_observed(t: Tables):
    """The histogram of a table that is written, taken while it is."""
    rows, seen = metrics.measured(t.events.select("event_id", (F.col("value") / 5).alias("seconds")), "seconds")
    kept = tables.written(rows)
    found = seen.get
    ladder = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.lit(found[f"le_{i}"]).cast("long").alias("observations")) for i, b in enumerate(usage.LATENCY)])).alias("r")
    return kept.agg(F.count("*").alias("written")).select("written", ladder).select("r.le", "r.observations", "written")


@R.query("table_source_md", """SELECT l_orderkey, count(*) AS table_rows, 3 * count(*) AS cells FROM lineitem GROUP BY 1""")
def table_source_md(t: Tables):
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "l_linenumber", "l_returnflag", "l_linestatus"), F.lit(" |"))
    made = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("md"))
    rows = parsers.table_rows(made.select("l_orderkey", F.concat(F.lit("intro\n"), F.col("md")).alias("md")), "l_orderkey", "md")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("table_rows"), F.sum(F.size("cells")).alias("cells"))
