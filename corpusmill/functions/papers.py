"""Business papers (Thai invoices and delivery notes) as Spark columns.

Fixed values: the patterns and words below are those of the paper forms.
"""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import let, stripped

MONEY = r"\d{1,3}(?:,\d{3})*\.\d{2}"
QTY = r"^(\d{1,3}(?:,\d{3})+|\d+)(?:\s*([ก-๙A-Za-z.]{1,12}))?$"
AMBIGUOUS = r"^\d{1,3}\.\d{3}$"
DOC_NO = r"(?:เลขที่|No\.?)[\s:：]*([A-Z]{2,4}[-/]?\s?\d[\d/\-]+)"
DOC_NO_TH = r"(?:เลขที่|ที่)[\s:：]*([ก-๙]{1,5}\s?\d{3,5}/[ก-๙]?\s?\d{1,6})"
DOC_DATE = r"วันที่[\s:：]*(\d{1,2}[\s/][ก-๙\d\s.]{2,20}\d{4}|\d{2}/\d{2}/\d{4})"
TAX_ID = r"\b(\d{13})\b"
EXCEPTION = r"(ชำรุด|เสียหาย|แตก|หัก|ขาด|ไม่ครบ|คืน|เปลี่ยน|ค้างส่ง|รอส่ง)"
REMARK = "หมายเหตุ"
EXCEPTION_QTY = r"(?:ชำรุด|เสียหาย|แตก|หัก|ขาด|คืน|ค้าง)\s*(\d+)"
REDUCING = ("ชำรุด", "เสียหาย", "แตก", "หัก", "ขาด", "คืน")
TOTAL_WORDS = {"subtotal": ("รวมเป็นเงิน",), "vat": ("ภาษีมูลค่าเพิ่ม", "VAT"), "grand_total": ("รวมทั้งสิ้น", "จำนวนเงินรวมทั้งสิ้น", "ยอดสุทธิ")}
#: Words that head the column of descriptions.
DESCRIBES = "รายการ|รายละเอียด|วัสดุ|สินค้า"
#: A line that gives a name and a value, and the most characters of a name in a cell.
PAIR, NAME_MOST = r"^([ก-๙A-Za-z./ ]{2,20})[\s:：]+(.{2,})$", 20
#: Header pattern -> role, the first that fits.
ROLES = (("amount", "จำนวนเงิน|รวมเงิน|มูลค่า|^รวม"), ("unit_price", "ราคา|หน่วยละ"), ("qty", "จำนวน|ปริมาณ"), ("unit", "หน่วย"), ("note", "หมายเหตุ"), ("desc", DESCRIBES), ("idx", r"^(?i:ลำดับ|ที่|No\.?|#)$"))
UNIT_ALIASES = {"กก": "กก.", "กิโลกรัม": "กก.", "ลบ.ม": "ลบ.ม.", "ตร.ม": "ตร.ม.", "เมตร": "ม."}
#: The units that papers name.
UNITS = (
    "ก้อน", "ถุง", "คิว", "ลบ.ม.", "ลบ.ม", "ตร.ม.", "ตร.ม", "ตร.ว.", "เส้น", "กก.", "กก", "กิโลกรัม", "ตัน", "แผ่น", "ม.", "เมตร", "ม้วน", "ชุด", "ตัว", "อัน", "ชิ้น", "กล่อง", "ลัง",
    "แท่ง", "ท่อน", "ถัง", "ลิตร", "แกลลอน", "กระป๋อง", "หลอด", "มัด", "คู่", "ใบ", "แพ็ค", "ลูก", "คัน", "เที่ยว", "งาน", "หน่วย", "จุด", "ชั้น", "ตร.ฟุต", "ฟุต", "นิ้ว", "หลา", "ซม.", "มม.",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def number(c: Column) -> Column:
    return F.try_to_number(F.replace(c, F.lit(","), F.lit("")), F.lit("999999999999.99")).cast("double")


def money(c: Column | str) -> Column:
    return F.replace(found(c, MONEY, 0), F.lit(","), F.lit("")).cast("double")


#: Tags that end a block or a cell: br, hr and the ends of p, li, div, td, th, tr and h1 to h6.
_ENDS = "[bh]r|/(?:p|li|div|t[dhr]|h[1-6])"


@F.pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def plain_lines(c: Column | str) -> Column:
    """Lines of a page without tags, references decoded; what ends a block or a cell ends a line; blank lines go."""
    text = _col(c)
    c = F.regexp_replace(text, rf"(?i)<(?:{_ENDS})(?:\s[^<>]*)?/?>", "\n")
    c = F.regexp_replace(c, "<[^<>]+>", " ")
    # only what has a reference goes to Python; asked is the text as it came, as the other would be made once more for it
    c = F.coalesce(_decoded(F.when(text.contains("&"), c)), c)
    return F.filter(F.transform(F.split(c, "\n"), stripped), lambda x: x != "")


def role(header: Column | str) -> Column:
    """What a column holds, by its header without blanks."""
    name = F.replace(_col(header), F.lit(" "), F.lit(""))
    out = F.when(name == "", F.lit(None).cast("string"))
    for what, pattern in ROLES:
        out = out.when(name.rlike(pattern), what)
    return out


def roles(headers: Column | str) -> Column:
    """role -> column number, of equals the first."""
    known = F.filter(F.transform(_col(headers), lambda h, i: F.struct(role(h).alias("key"), i.alias("value"))), lambda x: x["key"].isNotNull())
    first = lambda k: F.filter(k, lambda x, i: F.array_position(F.transform(k, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(let(known, first))


def quantity(cell: Column | str) -> Column:
    """qty, unit and qty_raw of a cell; what is ambiguous or unreadable stays raw."""
    c = F.trim(_col(cell))
    fits = c.rlike(QTY)
    qty = F.when(fits, F.replace(found(c, QTY), F.lit(","), F.lit("")).cast("double"))
    return F.struct(qty.alias("qty"), F.when(fits, found(c, QTY, 2)).alias("unit"), F.when(~fits & (c.rlike(AMBIGUOUS) | c.rlike(r"\d")), c).alias("qty_raw"))


def unit_name(unit: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in UNIT_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, _col(unit)), _col(unit))


def unknown_units(units: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.array_except(F.array_compact(_col(units)), F.array(*[F.lit(u) for u in UNITS]))))


def totals(lines: Column | str) -> Column:
    """subtotal, vat and grand_total: the money on the first line that names each."""

    def first(words: tuple[str, ...]) -> Column:
        named = F.filter(_col(lines), lambda x: x.rlike("|".join(words)) & x.rlike(MONEY))
        return money(F.try_element_at(named, F.lit(1)))

    return F.struct(*[first(words).alias(name) for name, words in TOTAL_WORDS.items()])


def exception(note: Column | str, qty: Column, description: Column | str | None = None) -> Column:
    """kind, qty and net_qty of a remark, in the note or the description, that what came is not what is written; null kind without one."""
    said = F.concat_ws(" ", _col(note), *([] if description is None else [_col(description)]))
    kind = found(said, EXCEPTION)
    less = found(said, EXCEPTION_QTY).cast("double")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), less).alias("qty"), F.when(kind.isin(*REDUCING) & less.isNotNull(), qty - less).otherwise(qty).alias("net_qty"))


def remarks(lines: Column | str) -> Column:
    """Kind and text of every remark on the whole paper that names an exception."""
    said = F.filter(_col(lines), lambda x: x.startswith(REMARK) & x.rlike(EXCEPTION))
    return F.transform(said, lambda x: F.struct(found(x, EXCEPTION).alias("kind"), x.alias("text")))


def arithmetic(items_sum: Column, subtotal: Column, vat: Column, grand: Column) -> Column:
    """items_match_subtotal, vat_is_7pct and total_adds_up; null where a number is missing."""
    return F.struct(
        (F.abs(F.round(items_sum, 2) - subtotal) < 0.01).alias("items_match_subtotal"),
        F.when(grand.isNotNull(), F.abs(subtotal * 0.07 - vat) < 1.0).alias("vat_is_7pct"),
        (F.abs(subtotal + vat - grand) < 0.02).alias("total_adds_up"),
    )


def paper_type(has_items: Column, has_money: Column) -> Column:
    return F.when(has_items & has_money, "invoice_like").when(has_items, "delivery_note").otherwise("text")
