"""Business papers: extraction, checks and reconciliation.

Papers are made of orders and their lines: a head, a table in Thai, totals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import papers as fn
from corpusmill.functions import scalars
from corpusmill.operators import lifecycle, papers, reconcile
from corpusmill.queries import Registry, Tables

R = Registry()

#: Lines of an order by their own order, numbered; the data's line numbers repeat.
_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::INT AS k FROM lineitem)"


def _lines(t: Tables):
    return lifecycle.row_numbers(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], "k")


def _papers(t: Tables):
    """l_orderkey and md: a delivery note with a head, a table and, for every second order, money."""
    money = F.format_number("l_extendedprice", 2)
    row = F.concat(F.lit("<tr><td>"), F.col("k"), F.lit("</td><td>item "), F.col("l_partkey"), F.lit("</td><td>"), F.col("l_quantity").cast("int"), F.lit(" เส้น</td><td>"), F.when(F.col("l_orderkey") % 2 == 0, money).otherwise("-"), F.lit("</td></tr>"))
    body = _lines(t).groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", row.alias("r")))), lambda x: x["r"]), "").alias("body"), F.sum("l_extendedprice").alias("total"))
    head = F.concat(F.lit("<p>เลขที่ PO-"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), F.lit("</p><p>วันที่ 12/03/2568</p><p>ผู้รับ: คลัง "), F.col("l_orderkey") % 7, F.lit("</p>"))
    table = F.concat(F.lit("<table><tr><th>ลำดับ</th><th>รายการ</th><th>จำนวน</th><th>จำนวนเงิน</th></tr>"), F.col("body"), F.lit("</table>"))
    foot = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("<p>รวมเป็นเงิน "), F.format_number("total", 2), F.lit("</p>"))).otherwise("")
    return body.select("l_orderkey", F.concat(head, table, foot).alias("md"))


@R.query("ex_strip_html", "SELECT l_orderkey, 4 * count(*)::INT + 7 + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_lines FROM lineitem GROUP BY 1")
def ex_strip_html(t: Tables):
    return _papers(t).select("l_orderkey", F.size(fn.plain_lines("md")).alias("n_lines"))


@R.query("ex_col_roles", "SELECT p_partkey, ['amount', 'unit_price', 'qty', 'unit', 'desc', NULL][(p_partkey % 6 + 1)::INT] AS role FROM part")
def ex_col_roles(t: Tables):
    heads = F.array(*[F.lit(h) for h in ("จำนวนเงิน", "ราคา/หน่วย", "จำนวน", "หน่วย", "ราย การ", " ")])
    return t.part.select("p_partkey", fn.role(F.element_at(heads, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("role"))


@R.query("ex_parse_qty", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 4000.0 END AS qty, CASE p_partkey % 4 WHEN 0 THEN 'kg' END AS unit, CASE p_partkey % 4 WHEN 2 THEN '4.000' WHEN 3 THEN NULL END AS qty_raw FROM part")
def ex_parse_qty(t: Tables):
    cell = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_size", F.lit(" kg"))).when(F.col("p_partkey") % 4 == 1, "4,000").when(F.col("p_partkey") % 4 == 2, "4.000").otherwise("-")
    return t.part.select("p_partkey", fn.quantity(cell).alias("q")).select("p_partkey", "q.*")


@R.query(
    "ex_line_items",
    f"WITH {_LINES} SELECT l_orderkey, k AS idx, 'item ' || l_partkey AS description, l_quantity::INT::DOUBLE AS qty, 'เส้น' AS unit, CASE WHEN l_orderkey % 2 = 0 THEN round(l_extendedprice, 2) END AS amount FROM lines",
)
def ex_line_items(t: Tables):
    return papers.line_items(_papers(t), "l_orderkey", "md").select("l_orderkey", "idx", "description", "qty", "unit", "amount")


@R.query("ex_kv_pairs", "SELECT l_orderkey, 'คลัง ' || (l_orderkey % 7) AS receiver FROM lineitem GROUP BY 1")
def ex_kv_pairs(t: Tables):
    found = papers.pairs(_papers(t), "l_orderkey", "md").where(F.col("key").rlike("^ผู้รับ$"))
    return found.groupBy("l_orderkey").agg(F.min("value").alias("receiver"))


@R.query("ex_totals", "SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN round(sum(l_extendedprice), 2) END AS subtotal FROM lineitem GROUP BY 1")
def ex_totals(t: Tables):
    return _papers(t).select("l_orderkey", fn.totals(fn.plain_lines("md"))["subtotal"].alias("subtotal"))


@R.query("ex_year", "SELECT l_orderkey, 2025 AS year_ce, 'PO-' || lpad(l_orderkey::VARCHAR, 6, '0') AS doc_no FROM lineitem GROUP BY 1")
def ex_year(t: Tables):
    text = F.array_join(fn.plain_lines("md"), "\n")
    return _papers(t).select("l_orderkey", scalars.year_ce(fn.found(text, fn.DOC_DATE)).alias("year_ce"), fn.found(text, fn.DOC_NO).alias("doc_no"))


@R.query(
    "ex_exceptions",
    f"""WITH {_LINES} SELECT l_orderkey, k, CASE WHEN l_quantity > 40 THEN 'ชำรุด' WHEN l_quantity > 30 THEN 'ค้างส่ง' WHEN l_quantity > 20 THEN 'แตก' END AS kind,
    l_quantity - CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 30 THEN 0 WHEN l_quantity > 20 THEN 3 ELSE 0 END AS net_qty FROM lines""",
)
def ex_exceptions(t: Tables):
    """Remarks in the note or, where that says nothing, in the description; not all make the quantity less."""
    note = F.when(F.col("l_quantity") > 40, "ชำรุด 2 เส้น").when(F.col("l_quantity") > 30, "ค้างส่ง 5").when(F.col("l_quantity") > 20, "-")
    description = F.concat(F.lit("item "), F.col("l_partkey"), F.when((F.col("l_quantity") > 20) & (F.col("l_quantity") <= 30), " (แตก 3)").otherwise(""))
    return _lines(t).select("l_orderkey", "k", fn.exception(note, F.col("l_quantity"), description).alias("e")).select("l_orderkey", "k", "e.kind", "e.net_qty")


@R.query("ex_remarks", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['คืน'] WHEN 1 THEN ['ไม่ครบ', 'คืน'] ELSE []::VARCHAR[] END AS kinds FROM orders")
def ex_remarks(t: Tables):
    """Remarks on whole papers: only lines that begin as one and name an exception count."""
    last = F.lit("<p>หมายเหตุ: คืน 1 เส้น &amp; ใบเดิม</p>")
    page = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<p>รายการ แตก</p>"), last)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("<div>หมายเหตุ ไม่ครบ</div>"), last)).otherwise("<p>หมายเหตุ: ครบ</p><p>ที่ หมายเหตุ คืน</p>")
    return t.orders.select("o_orderkey", F.transform(fn.remarks(fn.plain_lines(page)), lambda x: x["kind"]).alias("kinds"))


@R.query("ex_similarity")
def ex_similarity(t: Tables):
    """The part names of each order's lines matched with those of its smaller lines."""
    named = _lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("k").alias("place"), F.col("p_name").alias("item"), F.col("l_quantity").alias("qty"))
    return reconcile.by_name(named, named.where("qty < 25").withColumnRenamed("qty", "net"), "l_orderkey")


_BOUGHT = "SELECT o_custkey, l_partkey, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@R.query(
    "ex_reconcile",
    f"""WITH a AS ({_BOUGHT} WHERE l_linenumber <= 5 GROUP BY 1, 2), b AS ({_BOUGHT} WHERE l_returnflag <> 'R' GROUP BY 1, 2)
    SELECT o_custkey, l_partkey, a.qty AS ordered, b.qty AS delivered, CASE WHEN b.qty IS NULL THEN 'missing' WHEN a.qty IS NULL THEN 'unexpected' WHEN abs(b.qty - a.qty) < 1e-9 THEN 'ok' WHEN b.qty > a.qty THEN 'over' ELSE 'under' END AS status
    FROM a FULL JOIN b USING (o_custkey, l_partkey)""",
)
def ex_reconcile(t: Tables):
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    total = lambda df: df.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return reconcile.by_key(total(bought.where("l_linenumber <= 5")), total(bought.where("l_returnflag <> 'R'")), ["o_custkey", "l_partkey"])


def _heads(t: Tables, made=None):
    text = F.array_join(fn.plain_lines("md"), "\n")
    money = fn.totals(fn.plain_lines("md"))["subtotal"].isNotNull()
    return (_papers(t) if made is None else made).select("l_orderkey", fn.found(text, fn.DOC_NO).alias("doc_no"), fn.found(text, fn.DOC_DATE).alias("date"), fn.paper_type(F.lit(True), money).alias("doc_type"))


def _with_faults(t: Tables):
    """Papers of which a fifth each has no number, a date of long ago, no date at all, or rows that begin with 9."""
    md, fault = F.col("md"), F.col("l_orderkey") % 5
    faulty = (
        F.when(fault == 1, F.regexp_replace(md, "<p>เลขที่ [^<]*</p>", ""))
        .when(fault == 2, F.replace(md, F.lit("12/03/2568"), F.lit("12/03/2540")))
        .when(fault == 3, F.replace(md, F.lit("<tr><td>1</td>"), F.lit("<tr><td>9</td>")))
        .when(fault == 4, F.replace(md, F.lit("<p>วันที่ 12/03/2568</p>"), F.lit("")))
    )
    return _papers(t).select("l_orderkey", F.coalesce(faulty, md).alias("md"))


@R.query(
    "ex_structural",
    """SELECT l_orderkey, f <> 1 AS has_doc_no, f NOT IN (2, 4) AS date_plausible, f <> 3 AS rows_sequential, TRUE AS all_rows_have_qty, TRUE AS units_recognized,
      [['has_doc_no'], ['date_plausible'], ['rows_sequential'], ['has_date', 'date_plausible'], []][CASE f WHEN 0 THEN 5 ELSE f END] AS reasons FROM (SELECT DISTINCT l_orderkey, (l_orderkey % 5)::INT AS f FROM lineitem)""",
)
def ex_structural(t: Tables):
    made = _with_faults(t)
    checked = papers.structural(papers.line_items(made, "l_orderkey", "md"), _heads(t, made), "l_orderkey", 2026)
    return checked.select("l_orderkey", "has_doc_no", "date_plausible", "rows_sequential", "all_rows_have_qty", "units_recognized", "reasons")


@R.query(
    "ex_arithmetic",
    """WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, abs(s - (s + l_orderkey % 2)) < 0.01 AS items_match_subtotal, abs((s + l_orderkey % 2) * 0.07 - (s * 0.07 + l_orderkey % 3)) < 1.0 AS vat_is_7pct FROM s""",
)
def ex_arithmetic(t: Tables):
    s = F.round(F.sum("l_extendedprice"), 2)
    sums = t.lineitem.groupBy("l_orderkey").agg(s.alias("s")).withColumn("sub", F.col("s") + F.col("l_orderkey") % 2).withColumn("vat", F.col("s") * 0.07 + F.col("l_orderkey") % 3)
    c = fn.arithmetic(F.col("s"), F.col("sub"), F.col("vat"), F.col("sub") + F.col("vat"))
    return sums.select("l_orderkey", c.alias("c")).select("l_orderkey", "c.items_match_subtotal", "c.vat_is_7pct")


@R.query("ex_doc_type", "SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'invoice_like' ELSE 'delivery_note' END AS doc_type FROM lineitem GROUP BY 1")
def ex_doc_type(t: Tables):
    return _heads(t).select("l_orderkey", "doc_type")


@R.query("ex_review", "SELECT l_orderkey, l_orderkey % 2 = 1 AND l_orderkey % 3 <> 0 AS needs_review FROM lineitem GROUP BY 1")
def ex_review(t: Tables):
    checked = papers.structural(papers.line_items(_papers(t), "l_orderkey", "md"), _heads(t), "l_orderkey", 2026)
    return checked.select("l_orderkey", papers.review(F.col("reasons"), F.col("doc_type"), F.col("l_orderkey") % 3 == 0).alias("needs_review"))


@R.query(
    "ex_accuracy",
    r"""WITH b AS (SELECT item_id, lower(regexp_replace(text, '[\s,]+', '', 'g')) AS bare, lower(regexp_replace(left(text, 15), '[\s,]+', '', 'g')) AS head FROM benchmark)
    SELECT item_id, len([v FOR v IN [head, 'the', 'ation', 'und', '~~~'] IF contains(bare, v)]) AS hits, 5 AS fields, len([v FOR v IN [head, 'the', 'ation', 'und', '~~~'] IF contains(bare, v)]) / 5.0::DOUBLE AS accuracy FROM b""",
)
def ex_accuracy(t: Tables):
    """Five expected values of each text: its beginning, words that some have, and one that none has."""
    fields = t.benchmark.select("item_id", F.explode(F.array(F.left("text", F.lit(15)), *[F.lit(v) for v in ("T he", "at,ion", "UND", "~~~")])).alias("value"))
    return papers.field_accuracy(fields, t.benchmark, "item_id")
