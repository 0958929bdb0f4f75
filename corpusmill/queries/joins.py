"""Joins and set operations (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import papers
from corpusmill.functions import text as fn
from corpusmill.operators import guard, lifecycle, links, reconcile
from corpusmill.queries import Registry, Tables

R = Registry()


@R.query("join_inner_key_org", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner_key_org(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@R.query("join_membership_org", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def join_membership_org(t: Tables):
    return t.customer.where("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@R.query("join_semi_exists", "SELECT DISTINCT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def join_semi_exists(t: Tables):
    return links.prefix_or_exists(t.part, "p_partkey", "p_brand", "Brand#1", t.lineitem.where("l_quantity > 49"), "l_partkey").select("p_partkey", "p_brand").distinct()


@R.query("join_semi_in", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 25)")
def join_semi_in(t: Tables):
    """A claim of a fixed number of jobs: the limit is the feature."""
    first = t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey")
    return t.orders.join(first, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority", "o_orderdate")


@R.query("join_count_check", "SELECT l_orderkey, count(*) AS wanted, count(p_partkey) AS found, count(*) = count(p_partkey) AS all_found FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 45) ON l_partkey = p_partkey GROUP BY 1")
def join_count_check(t: Tables):
    return links.all_found(t.lineitem, "l_orderkey", "l_partkey", t.part.where("p_size <= 45"), "p_partkey")


@R.query("join_vector_cache", "SELECT d.doc_id, c.first_id AS cached_from, c.first_id IS NULL AS to_embed FROM documents d LEFT JOIN (SELECT source, sha256(text) AS h, min(doc_id) AS first_id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2) c ON d.source = c.source AND sha256(d.text) = c.h")
def join_vector_cache(t: Tables):
    hashed = t.documents.select("doc_id", "source", fn.content_hash("text").alias("h"))
    cache = hashed.where("doc_id % 3 = 0").groupBy("source", "h").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(cache, ["source", "h"], "left").select("doc_id", F.col("first_id").alias("cached_from"), F.col("first_id").isNull().alias("to_embed"))


@R.query("join_fusion_merge", "SELECT doc_id, max(a) AS in_first, max(b) AS in_second FROM (SELECT doc_id, 1 AS a, 0 AS b FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 0, 1 FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def join_fusion_merge(t: Tables):
    first = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("in_first"), F.lit(0).alias("in_second"))
    second = t.documents.where("doc_id % 5 = 0").select("doc_id", F.lit(0).alias("in_first"), F.lit(1).alias("in_second"))
    return first.unionByName(second).groupBy("doc_id").agg(F.max("in_first").alias("in_first"), F.max("in_second").alias("in_second"))


@R.query("join_citations", "SELECT conv_id, turn, 1 + turn % 3 AS source_index FROM conversations WHERE role = 'assistant'")
def join_citations(t: Tables):
    answers = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("see ["), F.col("turn") % 3 + 1, F.lit("] and [9]")).alias("answer"))
    offered = answers.select("conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("source_index"))
    return links.cited(answers, offered, ["conv_id", "turn"], "answer", "source_index").select("conv_id", "turn", F.col("source_index").cast("long").alias("source_index"))


@R.query("join_agent_kb", "SELECT c_custkey AS agent, count(*) AS chunks FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_agent_kb(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("c_custkey").alias("agent")).agg(F.count("*").alias("chunks"))


@R.query(
    "join_verbatim_run",
    r"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> ''] AS ws FROM documents), q AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> ''] AS ws FROM benchmark),
    a AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[i:i+11], ' ') FOR i IN range(1, len(ws) - 10)]) AS run FROM w WHERE len(ws) >= 12),
    b AS (SELECT DISTINCT item_id, unnest([array_to_string(ws[i:i+11], ' ') FOR i IN range(1, len(ws) - 10)]) AS run FROM q WHERE len(ws) >= 12)
    SELECT doc_id, item_id, count(*) AS shared_runs FROM a JOIN b USING (run) GROUP BY 1, 2""",
)
def join_verbatim_run(t: Tables):
    return guard.verbatim_runs(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text"), "doc_id", "item_id")


@R.query("join_header_zip", "SELECT p_partkey, ['name', 'brand', 'size'] AS fields, [p_name, p_brand, p_size::VARCHAR] AS cells FROM part")
def join_header_zip(t: Tables):
    pairs = F.arrays_zip(F.array(F.lit("name"), F.lit("brand"), F.lit("size")).alias("field"), F.array("p_name", "p_brand", F.col("p_size").cast("string")).alias("cell"))
    return t.part.select("p_partkey", pairs.alias("p")).select("p_partkey", F.col("p.field").alias("fields"), F.col("p.cell").alias("cells"))


@R.query("join_text_embedding_zip", "SELECT vec_id, len(embedding)::INT AS width, embedding[1] AS first FROM embeddings")
def join_text_embedding_zip(t: Tables):
    return t.embeddings.select("vec_id", F.size("embedding").alias("width"), F.element_at("embedding", 1).alias("first"))


@R.query("join_scoped_agents", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS scopes FROM orders GROUP BY 1")
def join_scoped_agents(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("scopes"))


@R.query("set_union_lists", "SELECT label, count(*) AS candidates FROM (SELECT label FROM embeddings WHERE label < 5 UNION ALL SELECT label FROM embeddings WHERE label >= 3) GROUP BY 1")
def set_union_lists(t: Tables):
    return t.embeddings.where("label < 5").select("label").unionByName(t.embeddings.where("label >= 3").select("label")).groupBy("label").agg(F.count("*").alias("candidates"))


@R.query(
    "set_jaccard",
    r"""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS b FROM part)
    SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS jaccard FROM w""",
)
def set_jaccard(t: Tables):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat("p_type", F.lit(" "), "p_name")), " ")
    return t.part.select("p_partkey", reconcile.jaccard(a, b).alias("jaccard"))


@R.query("set_difference_unexpected", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def set_difference_unexpected(t: Tables):
    return lifecycle.missing_ids(t.part.select("p_partkey"), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@R.query("set_unknown_units", "SELECT l_orderkey, list_sort([x FOR x IN list(DISTINCT ['กก.', 'กล่อง', 'crate', 'ลัง', 'barrel', NULL][(l_partkey % 6 + 1)::INT]) IF x IN ('crate', 'barrel')]) AS unknown FROM lineitem GROUP BY 1")
def set_unknown_units(t: Tables):
    """Units of each order's lines, two of them in no list and one missing."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("กก.", "กล่อง", "crate", "ลัง", "barrel", None)]), (F.col("l_partkey") % 6 + 1).cast("int"))
    return t.lineitem.groupBy("l_orderkey").agg(papers.unknown_units(F.collect_set(unit)).alias("unknown"))


@R.query("set_replace_links", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, 1 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0)")
def set_replace_links(t: Tables):
    old = t.lineitem.select("l_orderkey", "l_partkey")
    return lifecycle.replace_links(old, "l_orderkey", old.where("l_orderkey % 4 = 0").select("l_orderkey", F.lit(1).cast("long").alias("l_partkey")).distinct())


@R.query("set_dedupe_citations", "SELECT conv_id, turn, [x FOR x, i IN all_of IF list_position(all_of, x) = i] AS cited FROM (SELECT conv_id, turn, [(turn % 4)::INT, 1, (conv_id % 3)::INT, 2, 1] AS all_of FROM conversations)")
def set_dedupe_citations(t: Tables):
    answer = F.concat(F.lit("["), F.col("turn") % 4, F.lit("][1] and ["), F.col("conv_id") % 3, F.lit("], [2] [x] [] [1]"))
    return t.conversations.select("conv_id", "turn", fn.citations(answer).alias("cited"))
