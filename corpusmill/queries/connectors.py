"""Connectors, sinks, pairwise joins and sessions that complete the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import vectors
from corpusmill.operators import connectors, fusion, lifecycle, reconcile, search
from corpusmill.operators.chunk_table import ChunkTable
from corpusmill.queries import Registry, Tables
from corpusmill.sources import tables

R = Registry()


_WORDS = r"""SELECT item_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> '']) AS word FROM benchmark"""


@R.query(
    "embed_connector",
    f"""WITH w AS ({_WORDS}), h AS (SELECT item_id, hex(encode(word)) AS x FROM w),
    d AS (SELECT item_id, (list_reduce([('0x' || x[2 * i + 1 : 2 * i + 2])::INT::UHUGEINT FOR i IN range(length(x) // 2)], lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 1469598103934665603::UHUGEINT) % 64)::INT AS place FROM h),
    n AS (SELECT item_id, place, count(*) AS c FROM d GROUP BY 1, 2) SELECT item_id, 64 AS width, count(*)::INT AS filled, arg_max(place, (c, -place))::INT AS heaviest, round(max(c) / sqrt(sum(c * c)), 5) AS weight FROM n GROUP BY 1""",
)
def embed_connector(t: Tables):
    """What a client answers out of order, back with its texts: width, places filled, the heaviest of them and its weight."""
    found = connectors.embed(t.benchmark, "item_id", "text")
    heaviest = F.array_max(F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("x"), (-i).alias("i"))))
    return found.select("item_id", F.size("embedding").alias("width"), F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"), (-heaviest["i"]).alias("heaviest"), F.round(heaviest["x"], 5).alias("weight"))


_ROUTED = "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' END AS model, CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END::INT AS attempts, s_suppkey % 3 = 2 AS failed FROM supplier"


@R.query("rag_route_call", _ROUTED)
def rag_route_call(t: Tables):
    """Two models, the first, none or both of them out of order."""
    models = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("a!"), F.lit("b"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a!"), F.lit("b!")))
    asked = t.supplier.select("s_suppkey", models.alias("models"), F.col("s_name").alias("prompt"))
    return connectors.call(asked, "s_suppkey").select("s_suppkey", "model", "attempts", F.col("error").isNotNull().alias("failed"))


@R.query("chat_connectors", "SELECT conv_id, turn, 'echo: ' || left(text, 40) AS answer FROM conversations WHERE role = 'user'")
def chat_connectors(t: Tables):
    asked = t.conversations.where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array(F.lit("echo")).alias("models"), F.col("text").alias("prompt"))
    ids = F.split("id", ":")
    return connectors.call(asked, "id").select(ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), "answer")


@R.query(
    "chunk_sink",
    """SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE 1 END::INT AS version, count(*) AS chunks, sum(l_quantity)::BIGINT AS tokens FROM lineitem
    WHERE l_orderkey % 5 <> 1 AND (l_orderkey % 3 <> 0 OR l_linenumber % 2 = 0) GROUP BY 1""",
)
def chunk_sink(t: Tables):
    """Lines as chunks of their orders: all in a first version, some orders again in a second, some retired; what is served then."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("version"), F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").cast("long").alias("token_count"))
    table = ChunkTable(lines.sparkSession, tables.shared(lines.sparkSession, "chunks"))
    again = lines.where("document_id % 3 = 0")
    table.append(lines)
    table.append(again.where("chunk_index % 2 = 0").withColumn("version", F.lit(2)))
    # an order without such lines has no second version and is gone with the first
    table.retire_others(again.select("document_id", F.lit(2).alias("version")).distinct(), F.current_timestamp())
    table.retire_documents(lines.where("document_id % 5 = 1").select("document_id"), F.current_timestamp())
    return table.served().groupBy(F.col("document_id").alias("l_orderkey"), "version").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@R.query(
    "join_vector_cross",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings)
    SELECT query_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""",
)
def join_vector_cross(t: Tables):
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_topk(queries, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10, digits=9).drop("rank")


_FIRST = "SELECT label AS query_id, vec_id AS chunk_id, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) <= 8"


@R.query(
    "join_mmr_pairwise",
    f"""WITH c AS ({_FIRST}) SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS likeness FROM c a JOIN c b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id""",
)
def join_mmr_pairwise(t: Tables):
    """Likeness between the eight candidates of each question: few by the cut of the search."""
    hits = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.element_at("embedding", 1).alias("score"), "embedding")
    first = fusion.ranked(hits, most=8)
    a, b = (first.select("query_id", F.col("chunk_id").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab")
    return a.join(b, "query_id").where("a < b").select("query_id", "a", "b", F.round(vectors.cosine("va", "vb"), 9).alias("likeness"))


@R.query("join_fuzzy_reconcile")
def join_fuzzy_reconcile(t: Tables):
    """The lines of each order by part name, and as written on delivery: upper case, signs added, some lines gone."""
    lines = lifecycle.row_numbers(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], "place")
    ordered = lines.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "place", F.col("p_name").alias("item"), F.col("l_quantity").alias("qty"))
    noted = ordered.where("place % 4 <> 0").select("l_orderkey", "place", F.concat(F.upper("item"), F.lit(" -")).alias("item"), (F.col("qty") - F.col("place") % 2).alias("net"))
    return reconcile.by_name(ordered, noted, "l_orderkey")


@R.query("agg_context_tokens", "SELECT conv_id, sum(length(text))::BIGINT AS context_tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 8 GROUP BY 1")
def agg_context_tokens(t: Tables):
    items = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("tokens")))).alias("xs"))
    taken = fusion.within_budget(F.col("xs"), 2**62, 8)
    return items.select("conv_id", F.aggregate(taken, F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("context_tokens"))


@R.query("st_rate_open", "SELECT user_id, max(ts) AS last_hit FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR")
def st_rate_open(t: Tables):
    """Windows that are still open at a given time; the others are forgotten."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last_hit"))
    return last.where(F.col("last_hit") >= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz") - F.expr("INTERVAL '6' HOUR"))


@R.query(
    "st_session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, count(*) AS events FROM s GROUP BY user_id, s""",
)
def st_session_window(t: Tables):
    """Sessions that each event extends by half a day."""
    found = t.events.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "events")
