"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import scalars
from corpusmill.functions import text as fn
from corpusmill.operators import filters, language, lifecycle
from corpusmill.queries import Registry, Tables

R = Registry()


@R.query("filter_tenant", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7")
def filter_tenant(t: Tables):
    return filters.TenantScope(7, "user_id").of(t.events).select("event_id", "user_id", "event_type")


@R.query("filter_in_array", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def filter_in_array(t: Tables):
    return filters.any_of(t.documents, "source", ["src1", "src3", "src5"]).select("doc_id", "source")


@R.query("filter_optional", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en'")
def filter_optional(t: Tables):
    return filters.optional(t.documents, lang="en", source=None).select("doc_id", "lang", "source")



@R.query("filter_live", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate IS NULL")
def filter_live(t: Tables):
    gone = t.orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return lifecycle.live(gone).select("o_orderkey")


@R.query("filter_include_deleted", "SELECT o_orderkey, o_orderstatus FROM orders WHERE TRUE OR o_orderstatus <> 'F'")
def filter_include_deleted(t: Tables):
    return filters.unless(t.orders, True, F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderstatus")


@R.query("filter_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'STANDARD') OR starts_with(p_name, 'a')")
def filter_prefix(t: Tables):
    return t.part.where(F.col("p_type").startswith("STANDARD") | F.col("p_name").startswith("a")).select("p_partkey", "p_name")


@R.query("filter_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def filter_time_range(t: Tables):
    return filters.between(t.events, "ts", "2024-01-05", "2024-01-12").select("event_id", "ts")


@R.query("filter_older_than", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR")
def filter_older_than(t: Tables):
    return filters.older_than(t.events, "ts", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 36).select("event_id")


@R.query("filter_relevance", "SELECT event_id, value FROM events WHERE event_type = 'view' OR value IS NULL OR value >= 25")
def filter_relevance(t: Tables):
    scored = t.events.withColumn("score", F.when(F.col("event_type") != "view", F.col("value")))
    return filters.relevant(scored, "score", 25.0).select("event_id", "value")


@R.query("project_json_field", "SELECT event_id, coalesce((props::JSON->>'k')::INT, 1) AS version FROM events WHERE coalesce((props::JSON->>'k')::INT, 1) < 5")
def project_json_field(t: Tables):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(1)).alias("version")).where("version < 5")


@R.query("project_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'running' END AS job_status, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at FROM orders")
def project_case(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return t.orders.select("o_orderkey", status.alias("job_status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"))


@R.query("project_greatest", "SELECT c_custkey, greatest(0, c_acctbal - 1000) AS balance FROM customer")
def project_greatest(t: Tables):
    return t.customer.select("c_custkey", lifecycle.clamp_add("c_acctbal", F.lit(-1000.0)).alias("balance"))


@R.query("project_id_prefix", "SELECT 'doc_' || doc_id AS document_id, 'chk_' || doc_id || '_0' AS chunk_id FROM documents")
def project_id_prefix(t: Tables):
    return t.documents.select(F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.concat(F.lit("chk_"), "doc_id", F.lit("_0")).alias("chunk_id"))


@R.query("project_effective_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'revoked' END AS status FROM orders")
def project_effective_status(t: Tables):
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("revoked")
    return t.orders.select("o_orderkey", scalars.effective_status(status, F.col("o_orderdate"), F.lit("1997-01-01").cast("timestamp_ntz")).alias("status"))


@R.query("project_meta_defaults", "SELECT event_id, coalesce(try_cast(props::JSON->>'k' AS BIGINT), -1) AS k, coalesce(props::JSON->>'title', 'Untitled') AS title FROM events")
def project_meta_defaults(t: Tables):
    meta = F.try_parse_json("props")
    return t.events.select("event_id", F.coalesce(F.try_variant_get(meta, "$.k", "bigint"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(meta, "$.title", "string"), F.lit("Untitled")).alias("title"))


@R.query(
    "validate_config",
    """SELECT p_partkey, [x FOR x IN [CASE WHEN p_partkey % 20 = 0 THEN 'schema_version' END, CASE WHEN length(p_name) * p_size * 30 > 20000 THEN 'instructions' END, CASE WHEN p_size * 2 NOT BETWEEN 1 AND 50 THEN 'top_k' END,
      CASE WHEN (p_partkey * 997) % 120000 NOT BETWEEN 500 AND 100000 THEN 'budget' END, CASE WHEN p_size / 40.0 > 1 THEN 'relevance' END, CASE WHEN p_partkey % 13 - 1 < 0 OR p_partkey % 13 - 1 > 10 THEN 'lambda' END,
      CASE WHEN p_partkey % 3 = 0 AND p_size < 10 THEN 'fallback' END, CASE WHEN p_partkey % 60 > 50 THEN 'history' END, CASE WHEN p_partkey % 17 = 0 THEN 'tools' END] IF x IS NOT NULL] AS problems FROM part""",
)
def validate_config(t: Tables):
    key, size = F.col("p_partkey"), F.col("p_size")
    settings = {
        "schema_version": F.when(key % 20 == 0, 2).otherwise(1), "instructions": F.repeat("p_name", size * 30), "top_k": size * 2, "budget": key * 997 % 120_000, "relevance": size / 40, "lambda": (key % 13 - 1) / 10,
        "strict": key % 3 == 0, "fallback": F.when(size < 10, " ").otherwise("Ask us."), "history": key % 60, "tools": F.when(key % 17 == 0, F.array(F.lit("search"))).otherwise(F.array()),
    }
    return t.part.select("p_partkey", scalars.config_problems(settings).alias("problems"))


@R.query(
    "validate_ranges",
    """SELECT p_partkey, [x FOR x IN [CASE WHEN p_size NOT BETWEEN 1 AND 45 THEN 'top_k' END, CASE WHEN p_retailprice * 10 NOT BETWEEN 500 AND 100000 THEN 'budget' END,
      CASE WHEN p_size / 40.0 NOT BETWEEN 0 AND 1 THEN 'relevance' END] IF x IS NOT NULL] AS problems FROM part""",
)
def validate_ranges(t: Tables):
    ranges = {"top_k": (F.col("p_size"), 1, 45), "budget": (F.col("p_retailprice") * 10, 500, 100_000), "relevance": (F.col("p_size") / 40, 0, 1)}
    return t.part.select("p_partkey", scalars.out_of_range(ranges).alias("problems"))


@R.query("validate_name", r"""SELECT c_custkey, length(trim(c_name)) BETWEEN 1 AND 200 AS name_ok, regexp_full_match(lower(replace(c_name, '#', '-')), '[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?') AS slug_ok, lower(trim(c_name || '@Example.ORG ')) AS email FROM customer""")
def validate_name(t: Tables):
    slug = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    return t.customer.select("c_custkey", scalars.valid_name("c_name").alias("name_ok"), scalars.valid_slug(slug).alias("slug_ok"), scalars.normal_email(F.concat("c_name", F.lit("@Example.ORG "))).alias("email"))


@R.query(
    "fn_sentences",
    r"""WITH s AS (SELECT doc_id, [trim(x, E' \n\t\r') FOR x IN string_split(regexp_replace(text, '([.!?\n。๚])', '\1' || chr(1), 'g'), chr(1)) IF trim(x, E' \n\t\r') <> ''] AS ss FROM documents)
    SELECT doc_id, len(ss)::INT AS sentences, sha256(array_to_string(ss, chr(1))) AS digest FROM s""",
)
def fn_sentences(t: Tables):
    return t.documents.select("doc_id", fn.sentences("text").alias("ss")).select("doc_id", F.size("ss").alias("sentences"), F.sha2(F.array_join("ss", "\x01").cast("binary"), 256).alias("digest"))


@R.query(
    "fn_token_estimates",
    r"""WITH w AS (SELECT doc_id, text, len([x FOR x IN regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') IF x <> ''])::INT AS words FROM documents)
    SELECT doc_id, greatest(words, (length(text) // 3)::INT, 1) AS chunk_tokens, greatest(words, (length(text) // 4)::INT, 0) AS query_tokens, left(text, 30) AS ten_tokens FROM w""",
)
def fn_token_estimates(t: Tables):
    return t.documents.select("doc_id", fn.estimate_tokens("text").alias("chunk_tokens"), fn.estimate_tokens("text", 4, 0).alias("query_tokens"), fn.truncate_tokens("text", 10).alias("ten_tokens"))


@R.query(
    "fn_labels",
    """SELECT doc_id, '[Document: ' || source || ' > Section: ' || lang || ' > p]' AS header, source || ' — p' AS title, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS snippet,
      replace(replace(replace(left(text, 50) || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents""",
)
def fn_labels(t: Tables):
    path = F.array(F.col("lang"), F.lit("p"))
    return t.documents.select(
        "doc_id", fn.chunk_header("source", path, F.lit(None).cast("string")).alias("header"), fn.title_of("source", path).alias("title"), fn.snippet("text").alias("snippet"),
        fn.escape_markup(F.concat(F.left("text", F.lit(50)), F.lit("<&>"))).alias("escaped"),
    )


@R.query("fn_citations", """SELECT conv_id, turn, [1 + turn, 2] AS expected, CASE WHEN turn = 1 THEN [2] ELSE [1 + turn, 2] END AS cited FROM conversations""")
def fn_citations(t: Tables):
    answer = F.concat(F.lit("As ["), F.col("turn") + 1, F.lit("] says, and [2], and ["), F.col("turn") + 1, F.lit("] again, not [x]."))
    return t.conversations.select("conv_id", "turn", F.array(F.col("turn") + 1, F.lit(2).cast("long")).alias("expected"), fn.citations(answer).alias("cited"))


@R.query("fn_hashes", """SELECT doc_id, sha256(text) AS content_hash, left(sha256(source), 32) AS tenant_hash FROM documents""")
def fn_hashes(t: Tables):
    return t.documents.select("doc_id", fn.content_hash("text").alias("content_hash"), fn.short_id("source").alias("tenant_hash"))


@R.query("fn_backoff", """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 600 END AS backoff_seconds, l_linenumber * 10 + l_linenumber * 10 // 5 AS max_tokens, (l_linenumber - 1) // 3 AS batch FROM lineitem""")
def fn_backoff(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", scalars.backoff_seconds("l_linenumber").alias("backoff_seconds"),
        scalars.with_fifth(F.col("l_linenumber") * 10).alias("max_tokens"), F.expr("cast((l_linenumber - 1) div 3 as int)").alias("batch"),
    )


@R.query("fn_cost", """SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT * 1500000) // 1000000 + (l_linenumber::BIGINT * 6000001) // 1000000 AS cost_micro FROM lineitem""")
def fn_cost(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.cost_micro(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.lit(1_500_000), F.lit(6_000_001)).alias("cost_micro"))


@R.query("fn_dates", """SELECT event_id, date_trunc('month', ts)::DATE AS period, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS next_period, date_trunc('day', ts)::TIMESTAMP AS day, strftime(ts, '%-d %B %Y') AS spoken FROM events""")
def fn_dates(t: Tables):
    return t.events.select("event_id", scalars.period("ts").alias("period"), scalars.next_period("ts").alias("next_period"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.date_format("ts", "d MMMM yyyy").alias("spoken"))


@R.query("fn_bytes", """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0, 1)) || ' KB' ELSE printf('%.1f', round(n / 1048576.0, 1)) || ' MB' END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def fn_bytes(t: Tables):
    return t.documents.select("doc_id", fn.human_bytes(F.octet_length("text")).alias("size"))


@R.query("fn_year", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2025 WHEN 1 THEN 1995 WHEN 2 THEN NULL ELSE 2026 END AS year_ce FROM orders""")
def fn_year(t: Tables):
    written = F.element_at(F.array(F.lit("12 ม.ค. 2568"), F.lit("03/04/1995"), F.lit("เลข 3000"), F.lit("1 มี.ค. 2569 (2026)")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", scalars.year_ce(written).alias("year_ce"))


@R.query("fn_ids", """SELECT doc_id, left(sha256(doc_id || ':1:0'), 26) AS chunk_key FROM documents""")
def fn_ids(t: Tables):
    return t.documents.select("doc_id", scalars.stable_id(F.col("doc_id"), F.lit(1), F.lit(0)).alias("chunk_key"))


@R.query("fn_json_metadata", """SELECT doc_id, json_object('source_type', 'text', 'title', source, 'language', lang, 'chunker_version', 2)::VARCHAR AS metadata FROM documents""")
def fn_json_metadata(t: Tables):
    return t.documents.select("doc_id", F.to_json(F.struct(F.lit("text").alias("source_type"), F.col("source").alias("title"), F.col("lang").alias("language"), F.lit(2).alias("chunker_version"))).alias("metadata"))


@R.query("fn_text_search", r"""WITH l AS (SELECT doc_id, list_distinct([x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> '']) AS ls FROM documents)
    SELECT doc_id, len(ls)::INT AS lexemes, list_has_all(ls, ['the', 'of']) AS matches FROM l""")
def fn_text_search(t: Tables):
    return t.documents.select("doc_id", fn.lexemes("text").alias("ls")).select("doc_id", F.size("ls").alias("lexemes"), (F.size(F.array_except(F.array(F.lit("the"), F.lit("of")), "ls")) == 0).alias("matches"))


@R.query("fn_windows", r"""WITH w AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(trim(text, E' \n\t')), '\s+') IF x <> ''] AS ws FROM benchmark)
    SELECT item_id, CASE WHEN len(ws) >= 12 THEN len(list_distinct([array_to_string(ws[i:i+11], ' ') FOR i IN range(1, len(ws) - 10)]))::INT ELSE 0 END AS windows FROM w""")
def fn_windows(t: Tables):
    return t.benchmark.select("item_id", F.size(fn.word_windows("text")).alias("windows"))


@R.query(
    "fn_cover_density",
    r"""WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    p AS (SELECT doc_id, i, max(i) FILTER (WHERE word = 'the') OVER o AS a, max(i) FILTER (WHERE word = 'of') OVER o AS b FROM w WHERE word IN ('the', 'of') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    l AS (SELECT doc_id, i, least(a, b) AS low, lag(least(a, b)) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
    r AS (SELECT doc_id, sum(0.1::DOUBLE / (i - low)) AS rank FROM l WHERE before IS NULL OR low > before GROUP BY 1)
    SELECT d.doc_id, round(coalesce(rank, 0), 9) AS rank FROM d LEFT JOIN r USING (doc_id)""",
)
def fn_cover_density(t: Tables):
    """Cover-density rank of two common words in every document."""
    return t.documents.select("doc_id", F.round(scalars.cover_density(F.col("text"), ["the", "of"]), 9).alias("rank"))


_COMMON_SQL = ", ".join("{{'n': len([x FOR x IN ws IF x IN ({})]), 'name': '{}'}}".format(", ".join(f"'{w}'" for w in words), name) for name, words in scalars.COMMON.items())


@R.query(
    "fn_language",
    rf"""WITH w AS (SELECT doc_id, lang, length(text) AS chars, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS ws FROM documents),
    c AS (SELECT doc_id, lang, chars, list_reverse_sort([{_COMMON_SQL}]) AS ranked FROM w)
    SELECT doc_id, lang, CASE WHEN chars >= 20 AND ranked[1].n > ranked[2].n THEN ranked[1].name END AS guess FROM c""",
)
def fn_language(t: Tables):
    return t.documents.select("doc_id", "lang", scalars.language("text").alias("guess"))


@R.query("fn_language_learned")
def fn_language_learned(t: Tables):
    """The language of every document by runs of characters, learned from four fifths of the labelled ones."""
    model = language.fit(t.documents.where("doc_id % 5 <> 0"))
    return t.documents.select("doc_id", "lang", (F.col("doc_id") % 5 == 0).alias("held_out")).join(language.detect(t.documents, model), "doc_id").drop("margin")
