"""Text functions as Spark columns: cleaning, splitting, sizes, labels and citations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence ends, and the phrases that a message is warned about.
SENTENCE_END = r"(?<=[.!?\n。๚])"
SUSPICIOUS = (
    "ignore previous instructions",
    "ignore all previous",
    "disregard the above",
    "system prompt",
    "reveal your instructions",
    "you are now",
    "ละเว้นคำสั่งก่อนหน้า",
    "ลืมคำสั่งทั้งหมด",
)
#: Longest message, snippet and verbatim run, in characters, characters and words.
MAX_MESSAGE, SNIPPET, RUN = 4000, 200, 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, line ends included."""
    return let(_col(c), stripped)


def stripped(x: Column) -> Column:
    """``strip`` of what costs nothing to name again, as the variable of a lambda."""
    # a regular expression also strips before a last line end that is no white space to it; few texts have one
    odd = reduce(or_, [x.contains(s) for s in ("\x85", "\u2028", "\u2029")])
    return F.when(odd, F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(" \t\n\x0b\f\r")))


def dehyphenate(c: Column | str) -> Column:
    """Words that a hyphen parts at a line's end are joined, if the next line begins with a small letter."""
    return F.regexp_replace(_col(c), r"-[ \t]*\n\s*(?=\p{Ll})", "")


def normalize(c: Column | str) -> Column:
    """Hyphens at line ends joined, control characters dropped, blanks and blank lines folded."""

    def where(c: Column, signs: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
        """Only a text that has one of the signs is changed, which spares the others the regular expression."""
        return let(c, lambda x: F.when(reduce(or_, [x.contains(s) for s in signs]), change(x)).otherwise(x))

    c = where(_col(c), ("\r",), lambda x: F.regexp_replace(x, r"\r\n?", "\n"))
    c = where(c, ("-\n", "- ", "-\t"), dehyphenate)
    c = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    c = where(c, ("  ", "\t"), lambda x: F.regexp_replace(x, r"[ \t]+", " "))
    c = where(c, (" \n", "\n "), lambda x: F.regexp_replace(x, r" ?\n ?", "\n"))
    return strip(where(c, ("\n\n\n",), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n")))


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(c), "\n\n"), strip), lambda x: x != "")


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(c), SENTENCE_END), strip), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(strip(c), r"\s+"), lambda x: x != ""))


def estimate_tokens(c: Column | str, chars_per_token: int = 3, least: int = 1) -> Column:
    """The larger of words and characters by ``chars_per_token``, at least ``least``."""
    c = _col(c)
    return F.greatest(word_count(c), F.floor(F.char_length(c) / chars_per_token).cast("int"), F.lit(least))


def truncate_tokens(c: Column | str, tokens: int, chars_per_token: int = 3) -> Column:
    return F.left(_col(c), F.lit(tokens * chars_per_token))


def has_headings(c: Column | str) -> Column:
    return _col(c).rlike(r"(?m)^#{1,6} .*\S")


def snippet(c: Column | str, chars: int = SNIPPET) -> Column:
    c = _col(c)
    return F.when(F.char_length(c) > chars, F.concat(F.left(c, F.lit(chars)), F.lit("…"))).otherwise(c)


def escape_markup(c: Column | str) -> Column:
    c = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def title_of(document: Column | str, headings: Column | str) -> Column:
    """Document and last heading; ``Untitled`` without a document."""
    last = F.try_element_at(_col(headings), F.lit(-1))
    name = F.coalesce(_col(document), F.lit("Untitled"))
    return F.when(last.isNotNull(), F.concat(name, F.lit(" — "), last)).otherwise(name)


def chunk_header(title: Column | str, headings: Column | str, record: Column | str) -> Column:
    """What stands before a chunk's text: document, section path and record."""
    path = F.array_join(_col(headings), " > ")
    parts = F.concat_ws(
        " > ",
        F.concat(F.lit("Document: "), _col(title)),
        F.when(F.size(_col(headings)) > 0, F.concat(F.lit("Section: "), path)),
        F.when(_col(record).isNotNull(), F.concat(F.lit("Record: "), _col(record))),
    )
    return F.concat(F.lit("["), parts, F.lit("]"))


def citations(c: Column | str) -> Column:
    """Numbers cited as [n], each once, in order; those beyond an int are passed over."""
    found = F.regexp_extract_all(_col(c), F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def suspicious_phrase(c: Column | str) -> Column:
    """The first listed phrase that the lower-cased message contains, or null."""
    low = F.lower(_col(c))
    return F.try_element_at(F.filter(F.array(*[F.lit(p) for p in SUSPICIOUS]), lambda p: F.contains(low, p)), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_windows(c: Column | str, run: int = RUN) -> Column:
    """Distinct runs of ``run`` lower-cased words; none if there are fewer words."""
    words = F.filter(F.split(F.lower(strip(c)), r"\s+"), lambda x: x != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - run + 1), lambda i: F.array_join(F.slice(w, i, F.lit(run)), " "))
    return let(words, lambda w: F.when(F.size(w) >= run, F.array_distinct(runs(w))).otherwise(F.array().cast("array<string>")))


def lexemes(c: Column | str) -> Column:
    """Distinct lower-cased runs of letters and digits: what keyword search looks up."""
    return F.filter(F.array_distinct(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+")), lambda x: x != "")


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def short_id(c: Column | str) -> Column:
    return F.left(content_hash(c), F.lit(32))


def human_bytes(c: Column | str) -> Column:
    c = _col(c)
    unit = lambda size, name: F.concat(F.format_string("%.1f", c / float(size)), F.lit(f" {name}"))
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024**2, unit(1024, "KB")).when(c < 1024**3, unit(1024**2, "MB")).otherwise(unit(1024**3, "GB"))


def type_by_name(name: Column | str) -> Column:
    """Source type by a file name's last extension; null for others."""
    # fixed values: extension -> type
    kinds = {"pdf": "pdf", "docx": "docx", "txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "json": "json", "csv": "csv", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    extension = F.lower(F.element_at(F.split(_col(name), r"\."), -1))
    return F.when(F.contains(_col(name), F.lit(".")), F.try_element_at(known, extension))


def type_by_magic(content: Column | str) -> Column:
    """Source type by the first bytes; null for others."""
    head = F.hex(F.substring(_col(content), 1, 12))
    return (
        F.when(head.startswith("255044462D"), "pdf")
        .when(head.startswith("504B0304"), "docx")
        .when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")), "image")
    )


def decode_utf8(content: Column | str) -> Column:
    """Text of UTF-8 bytes without a byte-order mark; null if they are not UTF-8."""
    text = F.try_validate_utf8(_col(content).cast("string"))
    return F.when(text.startswith("﻿"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def csv_delimiter(header: Column | str) -> Column:
    """The most frequent of comma, semicolon and tab; of equals the last; comma if none."""
    c = _col(header)
    counted = F.array(*[F.struct(F.regexp_count(c, F.lit(p)).alias("n"), F.lit(i).alias("i"), F.lit(ch).alias("ch")) for i, (p, ch) in enumerate(((",", ","), (";", ";"), ("\t", "\t")))])
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["ch"]).otherwise(",")


def refused_url(url: Column | str) -> Column:
    """Why a page must not be fetched: scheme, credentials, or a private address; null if it may."""
    url = _col(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    private = r"^(localhost|.*\.localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|192\.168\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|\[(::1?|f[cd].*|fe[89ab].*)\])$"
    return (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(host == "", "host")
        .when(host.rlike(private), "private")
    )
