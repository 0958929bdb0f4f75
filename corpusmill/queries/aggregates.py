"""Aggregations and metering."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import vectors
from corpusmill.operators import fusion, lifecycle, usage
from corpusmill.queries import Registry, Tables

R = Registry()


@R.query("agg_count", "SELECT source, count(*) AS live FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1")
def agg_count(t: Tables):
    return t.documents.where("doc_id % 7 <> 0").groupBy("source").agg(F.count("*").alias("live"))


@R.query("agg_count_filter", "SELECT count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE event_type = 'click') AS running, count(*) FILTER (WHERE event_type = 'error') AS dead FROM events")
def agg_count_filter(t: Tables):
    return usage.depth(t.events, "event_type", {"pending": "view", "running": "click", "dead": "error"})


@R.query("agg_sum_coalesce", "SELECT n_nationkey, coalesce(sum(s_acctbal), 0) AS total FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def agg_sum_coalesce(t: Tables):
    return t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)).alias("total"))


@R.query("agg_daily_usage", "SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'purchase') AS messages, sum(floor(value)::BIGINT)::BIGINT AS tokens, sum(floor(value * 100)::BIGINT)::BIGINT AS cost_micro FROM events GROUP BY 1, 2")
def agg_daily_usage(t: Tables):
    return usage.daily(_usage(t)).withColumnRenamed("tenant", "user_id")


@R.query("agg_month_counter", "SELECT user_id AS tenant, date_trunc('month', ts)::DATE AS period, count(*) FILTER (WHERE event_type = 'purchase') AS messages, sum(floor(value)::BIGINT)::BIGINT AS tokens, sum(floor(value * 100)::BIGINT)::BIGINT AS cost_micro FROM events GROUP BY 1, 2")
def agg_month_counter(t: Tables):
    return usage.monthly(_usage(t))


def _usage(t: Tables):
    """Events as usage facts: purchases are messages, values tokens and cost."""
    kind = F.when(F.col("event_type") == "purchase", "chat").otherwise(F.col("event_type"))
    return t.events.select(F.col("user_id").alias("tenant"), "ts", kind.alias("kind"), F.floor("value").cast("long").alias("tokens"), F.floor(F.col("value") * 100).cast("long").alias("cost_micro"))


@R.query("agg_max_version", "SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY 1")
def agg_max_version(t: Tables):
    return lifecycle.next_version(t.orders, ["o_custkey"], "o_orderkey")


@R.query("agg_distinct", "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def agg_distinct(t: Tables):
    return t.events.select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()


@R.query("agg_distinct_on", "SELECT DISTINCT ON (h) h, doc_id, source FROM (SELECT sha256(text) AS h, doc_id, source FROM documents) ORDER BY h, doc_id")
def agg_distinct_on(t: Tables):
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min(F.struct("doc_id", "source")).alias("r")).select("h", "r.*")


@R.query("agg_rrf", "WITH r AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings UNION ALL SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) FROM embeddings) SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM r GROUP BY 1")
def agg_rrf(t: Tables):
    lists = [lifecycle.row_numbers(t.embeddings.select("vec_id", "label", F.element_at("embedding", k).alias("s")), ["label"], [F.desc("s"), "vec_id"], "rank").select(F.lit(0).alias("query_id"), F.col("vec_id").alias("chunk_id"), "rank") for k in (1, 2)]
    return fusion.reciprocal_rank(lists).select(F.col("chunk_id").alias("vec_id"), F.round("score", 12).alias("score"))


@R.query("agg_group_model", "SELECT p_brand AS model, list_sort(list(p_partkey)) AS bases FROM part GROUP BY 1")
def agg_group_model(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("model")).agg(F.array_sort(F.collect_list("p_partkey")).alias("bases"))


@R.query("agg_total_tokens", "SELECT l_orderkey, sum(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY 1")
def agg_total_tokens(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"))


@R.query("agg_percentile_nearest", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def agg_percentile_nearest(t: Tables):
    return usage.percentiles(t.events, ["event_type"], "value")


@R.query("agg_latency_hist", "SELECT b.le, count(*) AS n FROM (SELECT value / 5 AS seconds FROM events) e LEFT JOIN (SELECT le, coalesce(lag(le) OVER (ORDER BY le), '-infinity'::DOUBLE) AS low FROM (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5, 3.0, 6.0, 15.0, 30.0, 60.0])::DOUBLE AS le)) b ON seconds > low AND seconds <= b.le GROUP BY 1")
def agg_latency_hist(t: Tables):
    return usage.buckets(t.events.select((F.col("value") / 5).alias("seconds")), "seconds", usage.LATENCY)


@R.query("agg_quota_fraction", "SELECT user_id, CASE WHEN user_id % 4 = 3 THEN 0.0 ELSE count(*) / (100.0 * (1 + user_id % 4)) END::DOUBLE AS fraction, user_id % 4 <> 3 AND count(*) >= 100 * (1 + user_id % 4) AS refused FROM events GROUP BY 1")
def agg_quota_fraction(t: Tables):
    used = t.events.groupBy("user_id").agg(F.count("*").alias("used"))
    limit = F.when(F.col("user_id") % 4 != 3, 100 * (1 + F.col("user_id") % 4))
    return used.select("user_id", usage.fraction(F.col("used"), limit).alias("fraction"), usage.over(F.col("used"), limit).alias("refused"))


@R.query("agg_dedupe_hash", "WITH h AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS k FROM documents) SELECT source, count(*) AS texts, count(*) FILTER (WHERE k = 1) AS embedded, (sum(n) FILTER (WHERE k = 1))::BIGINT AS billable FROM h GROUP BY 1")
def agg_dedupe_hash(t: Tables):
    return usage.billable(t.documents.select("source", "doc_id", F.char_length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("h")), "source", "h", "doc_id", "n")


@R.query(
    "agg_bow_vector",
    r"""WITH w AS (SELECT doc_id, unnest([x FOR x IN regexp_split_to_array(lower(text), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') IF x <> '']) AS word FROM documents),
    v AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM w),
    h AS (SELECT word, (list_reduce([('0x' || x[2 * i + 1 : 2 * i + 2])::INT::UHUGEINT FOR i IN range(length(x) // 2)], lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 1469598103934665603::UHUGEINT) % 64)::INT AS place FROM v),
    n AS (SELECT doc_id, place, count(*) AS c FROM w JOIN h USING (word) GROUP BY 1, 2),
    m AS (SELECT doc_id, map_from_entries(list((place, c))) AS counts, sqrt(sum(c * c)) AS size FROM n GROUP BY 1)
    SELECT d.doc_id, [coalesce(counts[i::INT] / size, 0)::FLOAT FOR i IN range(64)] AS embedding FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""",
)
def agg_bow_vector(t: Tables):
    return t.documents.select("doc_id", vectors.hashed_words(64)("text").alias("embedding"))


@R.query("agg_field_accuracy", "SELECT source, avg(CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS fields FROM documents GROUP BY 1")
def agg_field_accuracy(t: Tables):
    return t.documents.groupBy("source").agg(F.avg(F.contains(F.lower("text"), F.lit("the")).cast("double")).alias("accuracy"), F.count("*").alias("fields"))


@R.query("agg_items_sum", "SELECT l_orderkey, round(sum(l_extendedprice), 2) AS items_sum FROM lineitem GROUP BY 1")
def agg_items_sum(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("items_sum"))


@R.query("repo_latest_snapshot", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def repo_latest_snapshot(t: Tables):
    return lifecycle.latest(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@R.query("repo_purge_retired", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' OR l_shipdate >= TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR")
def repo_purge_retired(t: Tables):
    rows = t.lineitem.withColumn("deleted_at", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return lifecycle.purge(rows, "deleted_at", F.lit("1998-06-01").cast("timestamp_ntz"), 24).select("l_orderkey", "l_linenumber")


@R.query("repo_retire_versions", "SELECT l_orderkey, l_linenumber, l_linenumber <> max(l_linenumber) OVER (PARTITION BY l_orderkey) AS retired FROM lineitem")
def repo_retire_versions(t: Tables):
    served = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return lifecycle.retire_others(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", served)


@R.query(
    "health_rollup",
    """WITH m AS (SELECT p_brand, p_type, count(*) FILTER (WHERE p_size > 30) AS enabled, count(*) FILTER (WHERE p_size > 30 AND p_partkey % 3 = 0) AS usable, count(*) FILTER (WHERE p_size = 7) AS dead FROM part GROUP BY ALL)
    SELECT p_brand, p_type, CASE WHEN usable = 0 THEN 'failing' WHEN usable < enabled THEN 'degraded' ELSE 'ok' END AS models, CASE WHEN dead > 0 THEN 'degraded' ELSE 'ok' END AS queue, CASE WHEN usable = 0 THEN 'failing' ELSE 'ok' END AS health FROM m""",
)
def health_rollup(t: Tables):
    """Instances by brand and type; parts are their models, some switched off, some with an open circuit, and some dead jobs."""
    on = F.col("p_size") > 30
    counts = t.part.groupBy("p_brand", "p_type").agg(F.count_if(on).alias("enabled"), F.count_if(on & (F.col("p_partkey") % 3 == 0)).alias("usable"), F.count_if(F.col("p_size") == 7).alias("dead"))
    models, queue, whole = usage.readiness(F.col("usable"), F.col("enabled"), F.col("dead"))
    return counts.select("p_brand", "p_type", models.alias("models"), queue.alias("queue"), whole.alias("health"))


@R.query("health_by_user", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') * 2 > count(*) THEN 'failing' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'degraded' ELSE 'ok' END AS health FROM events GROUP BY 1")
def health_by_user(t: Tables):
    return usage.health(t.events, "user_id", F.col("event_type") == "error")
