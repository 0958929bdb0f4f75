"""Windows, ordered folds, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.operators import chunking, fusion, lifecycle, search, vector_index
from corpusmill.queries import Registry, Tables

R = Registry()


@R.query("win_list_rank", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id)::INT AS rank FROM embeddings")
def win_list_rank(t: Tables):
    hits = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.element_at("embedding", 1).alias("score"))
    return fusion.ranked(hits).select(F.col("chunk_id").alias("vec_id"), F.col("query_id").alias("label"), "rank")


@R.query("win_topk_per_query", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 30")
def win_topk_per_query(t: Tables):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return lifecycle.row_numbers(t.lineitem, ["l_suppkey"], order, "k").where("k <= 30").select("l_suppkey", "l_orderkey", "l_linenumber")


@R.query("win_chunk_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS chunk_index FROM lineitem")
def win_chunk_index(t: Tables):
    found = lifecycle.row_numbers(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], "k")
    return found.select("l_orderkey", "l_linenumber", (F.col("k") - 1).cast("long").alias("chunk_index"))


@R.query(
    "win_heading_path",
    """WITH RECURSIVE h AS (SELECT conv_id, coalesce(length(text), 0) % 4 + 1 AS level, role || ' ' || turn AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    s AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS path FROM h UNION ALL SELECT h.conv_id, h.n, s.path[1:(level - 1)] || [head] FROM s JOIN h ON h.conv_id = s.conv_id AND h.n = s.n + 1)
    SELECT conv_id, arg_max(path, n) AS path FROM s GROUP BY 1""",
)
def win_heading_path(t: Tables):
    """Turns as headings whose level follows their length: deeper, back, and levels passed over."""
    head = F.struct("turn", (F.coalesce(F.char_length("text"), F.lit(0)) % 4 + 1).alias("level"), F.concat("role", F.lit(" "), "turn").alias("text"))
    return t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(head)).alias("heads")).select("conv_id", chunking.heading_path(F.col("heads")).alias("path"))


@R.query(
    "win_pack_paragraphs",
    r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    s AS (SELECT doc_id, i, greatest(len([w FOR w IN regexp_split_to_array(p, '[\t-\r ]+') IF w <> '']), length(p) // 3, 1)::INT AS n FROM l),
    f AS (SELECT doc_id, i, n, 0 AS group_no, n AS held FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, s.n, f.group_no + (f.held >= 100)::INT, CASE WHEN f.held >= 100 THEN s.n ELSE f.held + s.n END FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
    SELECT doc_id, group_no, sum(n)::BIGINT AS tokens, count(*) AS parts FROM f GROUP BY 1, 2""",
)
def win_pack_paragraphs(t: Tables):
    """Lines packed into groups of 100 tokens and more."""
    return chunking.pack(t.documents.select("doc_id", F.split("text", "\n").alias("parts")), "doc_id", "parts", target=100)


@R.query("win_sentence_pack")
def win_sentence_pack(t: Tables):
    return chunking.split_to_size(t.documents.select("doc_id", "text"), "doc_id", "text")


@R.query(
    "win_budget_greedy",
    """WITH RECURSIVE s AS (SELECT l_orderkey, list(struct_pack(n := l_linenumber, q := l_quantity::BIGINT) ORDER BY l_linenumber, l_quantity) AS xs FROM lineitem GROUP BY 1),
    f AS (SELECT l_orderkey, xs, 1 AS i, 0::BIGINT AS used, []::INT[] AS taken FROM s
      UNION ALL SELECT l_orderkey, xs, i + 1, CASE WHEN used + xs[i].q <= 80 AND len(taken) < 3 THEN used + xs[i].q ELSE used END, CASE WHEN used + xs[i].q <= 80 AND len(taken) < 3 THEN list_append(taken, xs[i].n) ELSE taken END FROM f WHERE i <= len(xs))
    SELECT l_orderkey, taken FROM f WHERE i > len(xs)""",
)
def win_budget_greedy(t: Tables):
    items = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("tokens")))).alias("xs"))
    return items.select("l_orderkey", F.transform(fusion.within_budget(F.col("xs"), 80, 3), lambda x: x["l_linenumber"]).alias("taken"))


def mmr_sql(score: str, most: int) -> str:
    """Marginal relevance as recursive SQL over the first ``most`` vectors of each label: picks and each one's nearest pick so far."""
    return f"""WITH RECURSIVE c AS (SELECT label AS query_id, vec_id, embedding::DOUBLE[] AS v, {score} AS score, row_number() OVER (PARTITION BY label ORDER BY {score} DESC, vec_id) AS k FROM embeddings QUALIFY k <= {most}),
    g AS (SELECT query_id, list(vec_id ORDER BY k) AS ids, list(score ORDER BY k) AS scores, list(v ORDER BY k) AS vs FROM c GROUP BY 1),
    f AS (SELECT query_id, 1 AS pick, 1 AS best, [1] AS picks, [0.0::DOUBLE FOR x IN ids] AS near FROM g
      UNION ALL SELECT query_id, pick + 1, best, picks || [best], near FROM (
        SELECT query_id, pick, picks, near, list_position(worth, list_max(worth))::INT AS best FROM (
          SELECT f.query_id, pick, picks, near, [CASE WHEN list_contains(picks, i::INT) THEN '-infinity'::DOUBLE ELSE 0.7 * scores[i] - 0.3 * near[i] END FOR i IN range(1, len(ids) + 1)] AS worth FROM (
            SELECT f.query_id, pick, picks, ids, scores, [greatest(near[i], list_cosine_similarity(vs[i], vs[best])) FOR i IN range(1, len(ids) + 1)] AS near FROM f JOIN g ON g.query_id = f.query_id WHERE pick < least(16, len(ids))) f)))
    SELECT f.query_id, ids[best] AS chunk_id, pick FROM f JOIN g ON g.query_id = f.query_id"""


@R.query("win_mmr", mmr_sql("embedding[1]::DOUBLE", 30))
def win_mmr(t: Tables):
    candidates = fusion.ranked(t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.element_at("embedding", 1).cast("double").alias("score"), "embedding"), most=30)
    return fusion.diversify(candidates)


@R.query("win_recent_n", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def win_recent_n(t: Tables):
    return lifecycle.row_numbers(t.conversations, ["conv_id"], [F.desc("turn")], "k").where("k <= 6").select("conv_id", "turn", "role")


@R.query("win_history_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') WHERE k <= 2 * 2")
def win_history_turns(t: Tables):
    return chunking.history(t.conversations, 2).select("conv_id", "turn", "role")


@R.query("win_dehyphenate", r"""SELECT doc_id, sha256(regexp_replace(replace(replace(text, 'e ', '- ' || chr(10)), 'n ', '-' || chr(10) || ' '), '-[ \t]*\n[ \t-\r]*(\p{Ll})', '\1', 'g')) AS digest FROM documents""")
def win_dehyphenate(t: Tables):
    """Whole texts with hyphens and line ends put where many of their words end."""
    broken = F.replace(F.replace("text", F.lit("e "), F.lit("- \n")), F.lit("n "), F.lit("-\n "))
    return t.documents.select("doc_id", fn.content_hash(fn.dehyphenate(broken)).alias("digest"))


@R.query("win_first_wins", "SELECT doc_id, min(l) AS list_no FROM (SELECT doc_id, 0 AS l FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY 1")
def win_first_wins(t: Tables):
    both = t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("list_no")).unionByName(t.documents.select("doc_id", F.lit(1).alias("list_no")))
    return both.groupBy("doc_id").agg(F.min("list_no").alias("list_no"))


@R.query("win_rows_sequential", "SELECT l_orderkey, list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS sequential FROM lineitem GROUP BY 1")
def win_rows_sequential(t: Tables):
    numbers = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ns"))
    return numbers.select("l_orderkey", (F.col("ns") == F.sequence(F.lit(1), F.size("ns"))).alias("sequential"))


@R.query(
    "topk_vector",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id AS chunk_id, rank::INT AS rank, score FROM r WHERE rank <= 30""",
)
def topk_vector(t: Tables):
    """Every fiftieth vector as a query against all vectors."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.vector_topk(queries, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), 30, digits=9)
    return found.select("query_id", "chunk_id", "rank", "score")


@R.query("topk_vector_index")
def topk_vector_index(t: Tables):
    """The same questions walked through a graph index of all vectors."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_topk(queries, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), 30, digits=9, ann=True)


@R.query("vector_index_recall", "SELECT count(*) * least(30, (SELECT count(*) FROM embeddings)) AS wanted, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(t: Tables):
    """How many of the exact hits there are, and whether the index finds nine of ten of them."""
    held = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    counted = vector_index.recall(search.vector_topk(queries, held, 30, ann=True), search.vector_topk(queries, held, 30))
    return counted.agg(F.sum("wanted").alias("wanted"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("enough"))


@R.query(
    "topk_keyword",
    r"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct([x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''])) AS word FROM benchmark),
    t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS terms FROM q),
    d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    h AS (SELECT query_id, doc_id FROM t JOIN (SELECT DISTINCT doc_id, word FROM w) USING (word) GROUP BY query_id, doc_id, terms HAVING count(*) = terms),
    o AS (SELECT query_id, doc_id, word, terms, i, lead(i) OVER (PARTITION BY query_id, doc_id, word ORDER BY i) AS again FROM h JOIN t USING (query_id) JOIN w USING (doc_id, word)),
    a AS (SELECT query_id, doc_id, max(i) AS all_seen FROM (SELECT query_id, doc_id, word, min(i) AS i FROM o GROUP BY ALL) GROUP BY 1, 2),
    l AS (SELECT x.query_id, x.doc_id, x.i, x.terms, min(y.i) AS low FROM o x JOIN a ON a.query_id = x.query_id AND a.doc_id = x.doc_id AND x.i >= all_seen
      JOIN o y ON y.query_id = x.query_id AND y.doc_id = x.doc_id AND y.i <= x.i AND (y.again IS NULL OR y.again > x.i) GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, lag(low) OVER (PARTITION BY query_id, doc_id ORDER BY i) AS before FROM l),
    r AS (SELECT query_id, doc_id AS chunk_id, round(sum(0.1::DOUBLE / (1 + i - low + 1 - terms)), 9) AS score FROM b WHERE before IS NULL OR low > before GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r QUALIFY rank <= 30""",
)
def topk_keyword(t: Tables):
    """Whole benchmark texts searched in all documents."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return search.keyword_topk(asked, t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), 30)


@R.query("sort_fused", "SELECT vec_id, label FROM embeddings ORDER BY embedding[1] DESC, vec_id")
def sort_fused(t: Tables):
    return t.embeddings.orderBy(F.element_at("embedding", 1).desc(), "vec_id").select("vec_id", "label")


@R.query("sort_coalesce_desc", "SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, o_orderdate) DESC, o_orderkey LIMIT 50")
def sort_coalesce_desc(t: Tables):
    """A page of the latest: the limit is the feature."""
    return t.orders.orderBy(F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.col("o_orderdate")).desc(), "o_orderkey").limit(50).select("o_orderkey")


@R.query("sort_priority", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def sort_priority(t: Tables):
    return t.orders.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(20).select("o_orderkey")


@R.query("sort_created", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC")
def sort_created(t: Tables):
    return t.customer.orderBy(F.desc("c_acctbal")).select("c_custkey", "c_name")


@R.query("sort_version_desc", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) <= 10")
def sort_version_desc(t: Tables):
    """The ten latest versions of everything: the limit is the feature."""
    return lifecycle.row_numbers(t.lineitem, ["l_orderkey"], [F.desc("l_linenumber")], "k").where("k <= 10").select("l_orderkey", "l_linenumber")


@R.query("sort_model_priority", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def sort_model_priority(t: Tables):
    return fusion.placed(t.part.select("p_partkey", "p_size"), ["p_size", "p_partkey"], "place").select("p_partkey", "place")


@R.query("sort_reindex", "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS in_order FROM lineitem GROUP BY 1")
def sort_reindex(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"]).alias("in_order"))
