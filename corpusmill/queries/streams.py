"""Stateful streams over the events, drained by ``availableNow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import lifecycle
from corpusmill.operators.chunk_table import ChunkTable
from corpusmill.queries import Registry
from corpusmill.streaming import dispatch, jobs, limits, run, sessions

R = Registry()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")
    return run.read_table(spark, sf_dir, "events").select("user_id", "event_id", at, "event_type")


def _steps(seed: str, step: str, verdict: str, extra: str = "0") -> str:
    """A state machine a key as recursive SQL: ``seed`` is the state before a key's first event, ``step``
    the columns after the event ``e`` in the state ``s``."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS at, {extra} AS extra, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS n, 0::DOUBLE AS at, {seed} FROM events
      UNION ALL SELECT e.user_id, e.event_id, e.n, e.at, {step} FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, event_id, {verdict} FROM s WHERE n > 0"""


def _limit(name: str, step, out: str, state: str, extra=None, sql: str | None = None, idle: float | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir).withColumn("extra", extra() if extra is not None else F.lit(0))
        return run.drain(limits.keyed(rows, "user_id", "at", "event_id", "extra", step, out, state, idle))

    R.queries[name] = query
    if sql:
        R.sql[name] = sql


_DAY = 86400.0
_IN_WINDOW = "s.n > 0 AND e.at - s.began < 86400"


def _window_sql(hits: str, allowed: str) -> str:
    return _steps(
        "0::DOUBLE AS began, 0 AS hits, FALSE AS allowed",
        f"CASE WHEN {_IN_WINDOW} THEN s.began ELSE e.at END, CASE WHEN {_IN_WINDOW} THEN {hits} ELSE 1 END, CASE WHEN {_IN_WINDOW} THEN {allowed} ELSE TRUE END",
        "allowed, greatest(0, 3 - hits)::INT AS remaining, began + 86400 - s.at AS reset",
    )


_RECENT_SQL = _steps(
    "[]::DOUBLE[] AS recent, FALSE AS allowed",
    "[x FOR x IN s.recent IF e.at - x < 86400] || CASE WHEN len([x FOR x IN s.recent IF e.at - x < 86400]) < 3 THEN [e.at] ELSE [] END, len([x FOR x IN s.recent IF e.at - x < 86400]) < 3",
    "allowed, len(recent)::INT AS hits",
)
_PHASE = "CASE WHEN s.opened < 0 THEN 'closed' WHEN e.at - s.opened >= 86400 THEN 'half_open' ELSE 'open' END"
_FAILED = "[x FOR x IN s.recent IF e.at - x < 172800] || [e.at]"
_CIRCUIT_SQL = _steps(
    "[]::DOUBLE[] AS recent, -1::DOUBLE AS opened, '' AS phase",
    f"""CASE WHEN {_PHASE} = 'open' THEN s.recent WHEN e.extra THEN {_FAILED} ELSE [] END,
      CASE WHEN {_PHASE} = 'open' THEN s.opened WHEN NOT e.extra THEN -1 WHEN {_PHASE} = 'half_open' OR len({_FAILED}) >= 3 THEN e.at ELSE s.opened END, {_PHASE}""",
    "phase, phase <> 'open' AS called",
    "event_type IN ('error', 'view')",
)
_KEPT = "s.n > 0 AND e.at - s.since < 86400"


def _since_sql(verdict: str) -> str:
    return _steps("0::DOUBLE AS since, FALSE AS kept", f"CASE WHEN {_KEPT} THEN s.since ELSE e.at END, {_KEPT}", verdict)


def _job_sql(most_tries: int, stale_days: int, event: str) -> str:
    gone = f"(s.status = 'running' AND e.at - s.locked > {stale_days * 86400})"
    again = f"s.attempts < {most_tries}"
    wait = "e.at + [30, 120, 600][least(s.attempts, 3)]"
    ready = f"CASE WHEN {gone} AND {again} THEN {wait} ELSE s.ready END"
    claimed = f"(e.extra = 'claim' AND e.at >= {ready} AND (s.status = 'pending' OR ({gone} AND {again})))"
    failed = f"(e.extra IN ('transient', 'permanent') AND s.status = 'running' AND NOT {gone})"
    retried = f"({failed} AND e.extra = 'transient' AND {again})"
    return _steps(
        "'pending' AS status, 0 AS attempts, 0::DOUBLE AS ready, 0::DOUBLE AS locked",
        f"""CASE WHEN {claimed} THEN 'running' WHEN {gone} THEN CASE WHEN {again} THEN 'pending' ELSE 'dead' END WHEN {retried} THEN 'pending' WHEN {failed} THEN 'dead'
        WHEN e.extra = 'complete' AND s.status = 'running' THEN 'complete' ELSE s.status END,
      s.attempts + {claimed}::INT, CASE WHEN {retried} THEN {wait} ELSE {ready} END, CASE WHEN {claimed} THEN e.at WHEN {gone} OR {failed} THEN 0 ELSE s.locked END""",
        "status, attempts::INT AS attempts, ready AS run_after",
        event,
    )


_limit("st_rate_limit", limits.fixed_window(3, _DAY), "allowed boolean, remaining int, reset double", "began double, hits int", sql=_window_sql("s.hits + 1", "s.hits < 3"), idle=_DAY)
_limit("st_site_limit", limits.fixed_window(3, _DAY, count_denied=False), "allowed boolean, remaining int, reset double", "began double, hits int", sql=_window_sql("least(s.hits + 1, 3)", "s.hits < 3"), idle=_DAY)
_limit("st_sliding_limit", limits.sliding_window(3, _DAY), "allowed boolean, hits int", "recent array<double>", sql=_RECENT_SQL, idle=_DAY)
_limit("st_circuit", limits.circuit(3, 2 * _DAY, _DAY), "phase string, called boolean", "recent array<double>, opened double", lambda: F.col("event_type").isin("error", "view"), _CIRCUIT_SQL)
_limit("st_touch_throttle", limits.throttle(_DAY), "touched boolean", "last double", sql=_since_sql("NOT kept AS touched"), idle=_DAY)
_limit("st_ttl_cache", limits.cached(_DAY), "hit boolean", "loaded double", sql=_since_sql("kept AS hit"), idle=_DAY)


def _job_event():
    return F.element_at(F.array(*[F.lit(x) for x in ("claim", "transient", "claim", "complete", "claim", "permanent")]), (F.col("event_id") % 6 + 1).cast("int"))


_limit("st_queue", jobs.lifecycle(stale=5 * _DAY), "status string, attempts int, run_after double", "status string, attempts int, ready double, locked double", _job_event, _job_sql(4, 5, "['claim', 'transient', 'claim', 'complete', 'claim', 'permanent'][(event_id % 6 + 1)::INT]"))
_limit("st_retry", jobs.lifecycle(most_tries=2, stale=30 * _DAY), "status string, attempts int, run_after double", "status string, attempts int, ready double, locked double", lambda: F.when(F.col("event_id") % 2 == 0, "claim").otherwise("transient"), _job_sql(2, 30, "CASE WHEN event_id % 2 = 0 THEN 'claim' ELSE 'transient' END"))
_limit("st_reaper", jobs.lifecycle(most_tries=3, stale=_DAY), "status string, attempts int, run_after double", "status string, attempts int, ready double, locked double", lambda: F.lit("claim"), _job_sql(3, 1, "'claim'"))


def _ending(name: str, turn, event, out: str, living: str, lasting: str | None, sql: str) -> None:
    """A stream over three stretches of the events, started anew for each."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", at, event().alias("extra"))
        return run.replay(rows, "at", lambda s: sessions.keyed(s, "user_id", "at", "event_id", "extra", turn, out, living, lasting))[0]

    R.queries[name], R.sql[name] = query, sql


_LIVE = "s.expires > e.at"
_SESSION_SQL = _steps(
    "0::DOUBLE AS expires, 0 AS opened, '' AS verdict",
    f"""CASE WHEN e.extra THEN 0 WHEN {_LIVE} AND s.expires - e.at >= 43200 THEN s.expires ELSE e.at + 86400 END, s.opened + (NOT e.extra AND NOT {_LIVE})::INT,
      CASE WHEN e.extra AND {_LIVE} THEN 'signed_out' WHEN e.extra THEN 'none' WHEN NOT {_LIVE} THEN 'opened' WHEN s.expires - e.at < 43200 THEN 'extended' ELSE 'used' END""",
    "verdict, nullif(expires, 0) AS expires, opened::INT AS sessions",
    "event_type = 'error'",
)
_OPEN = "s.hits > 0 AND e.at - s.began < 86400"
_FORGET_SQL = _steps(
    "0::DOUBLE AS began, 0 AS hits",
    f"CASE WHEN {_OPEN} THEN s.began ELSE e.at END, CASE WHEN e.extra THEN 0 WHEN {_OPEN} THEN s.hits + 1 ELSE 1 END",
    "CASE WHEN hits > 0 THEN hits <= 2 END AS allowed, greatest(0, 2 - hits)::INT AS remaining",
    "event_type = 'purchase'",
)
_ending("st_session", sessions.sliding_session(_DAY), lambda: F.col("event_type") == "error", "verdict string, expires double, sessions int", "began double, expires double", "opened int", _SESSION_SQL)
_ending("st_rate_evict", sessions.forgettable_window(2, _DAY), lambda: F.col("event_type") == "purchase", "allowed boolean, remaining int", "began double, hits int", None, _FORGET_SQL)


def st_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly counters kept by a stream in update mode."""
    events = run.read_table(spark, sf_dir, "events")
    counted = events.groupBy("user_id", F.trunc("ts", "month").alias("period")).agg(F.count_if(F.col("event_type") == "purchase").alias("messages"), F.count("*").alias("events"))
    return run.drain_latest(counted, ["user_id", "period"])


def st_windowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day by event time, rows later than two days left out."""
    events = run.read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    counted = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"))
    latest = run.drain_latest(counted, ["window", "event_type"])
    return latest.select(F.col("window.start").cast("date").alias("day"), "event_type", "events")


def st_version_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in versions by a stream; each batch is one commit of the chunk table, whatever other batches wrote.

    A batch that is repeated finds its transaction committed.  Then the newest versions are served.
    """
    folder = run.shared(spark, "stream")
    table = ChunkTable(spark, f"{folder}/chunks")
    docs = run.read_table(spark, sf_dir, "documents", files=1).select(F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 3 + 1)).alias("version"), F.char_length("text").alias("chars"))

    def swap(batch: DataFrame, number: int) -> None:
        table.append(batch, transaction=f"swap-{number}")

    docs.writeStream.foreachBatch(swap).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return table.served().groupBy("version").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


R.queries |= {"st_counter": st_counter, "st_windowed_usage": st_windowed_usage, "st_version_swap": st_version_swap}
R.sql |= {
    "st_counter": "SELECT user_id, date_trunc('month', ts)::DATE AS period, count(*) FILTER (WHERE event_type = 'purchase') AS messages, count(*) AS events FROM events GROUP BY 1, 2",
    "st_windowed_usage": "SELECT ts::DATE AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "st_version_swap": "SELECT doc_id % 3 + 1 AS version, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1",
}


@R.query("st_claim", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 10")
def st_claim(t):
    """One claim of ten jobs: the limit is the feature."""
    due = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    queue = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), due.alias("run_after"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return jobs.claim(queue, 4e9, 10).select("job_id")


@R.query("st_purge", "SELECT event_id FROM events WHERE event_type <> 'error' OR ts >= TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR")
def st_purge(t):
    rows = t.events.withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts")))
    return lifecycle.purge(rows, "deleted_at", F.lit("2024-01-15").cast("timestamp_ntz"), 24).select("event_id")


@R.query("st_reembed", "SELECT source, count(*) AS documents FROM documents WHERE doc_id % 4 < 2 GROUP BY 1")
def st_reembed(t):
    """Documents of each knowledge base whose chunker is out of date."""
    return t.documents.withColumn("chunker", F.col("doc_id") % 4).where("chunker < 2").groupBy("source").agg(F.count("*").alias("documents"))


def _document_handlers(table: ChunkTable) -> dict[str, dispatch.Handler]:
    """Ingestion, of which some documents fail at first, and deletion."""

    def ingest(jobs: DataFrame, transaction: str) -> DataFrame:
        early = (F.col("document_id") % 11 == 3) & (F.col("attempts") < 2)
        table.append(jobs.where(~early).select("document_id", F.lit(1).alias("version"), "chars"), transaction)
        return jobs.where(early).select("job_id", F.lit("transient").alias("outcome"), F.lit("not yet").alias("message"))

    def delete(jobs: DataFrame, transaction: str) -> None:
        table.retire_documents(jobs, F.lit("2024-01-01"), transaction)

    return {"ingest": ingest, "delete": delete}


def st_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document ingested by a job, a fifth deleted by another, some of a kind nobody handles; then a later run for retries."""
    folder = run.shared(spark, "stream")
    table = ChunkTable(spark, f"{folder}/chunks")
    queue = dispatch.Dispatcher(spark, f"{folder}/queue", _document_handlers(table))
    number = F.col("doc_id")
    kinds = F.array(F.lit("ingest"), F.when(number % 5 == 1, "delete"), F.when(number % 7 == 2, "audit"))
    rows = run.read_table(spark, sf_dir, "documents").select(number.alias("document_id"), F.char_length("text").alias("chars"), F.posexplode(kinds).alias("place", "kind")).where("kind IS NOT NULL")
    queue.follow(rows.select((F.col("document_id") * 3 + F.col("place")).alias("job_id"), "kind", F.col("place").alias("priority"), "document_id", "chars"), f"{folder}/state", lambda n: float(n))
    queue.run(1000.0)
    live = table.served().select("document_id", F.lit(True).alias("served"))
    return queue.states().join(live, "document_id", "left").select("job_id", "kind", "status", "attempts", "message", F.coalesce("served", F.lit(False)).alias("served"))


R.queries["st_dispatch"] = st_dispatch
R.sql["st_dispatch"] = """WITH j AS (SELECT doc_id, unnest([0, 1, 2]) AS place FROM documents)
    SELECT doc_id * 3 + place AS job_id, ['ingest', 'delete', 'audit'][place + 1] AS kind, CASE WHEN place = 2 THEN 'dead' ELSE 'complete' END AS status, CASE WHEN place = 0 AND doc_id % 11 = 3 THEN 2 ELSE 1 END::INT AS attempts,
      CASE WHEN place = 2 THEN 'no handler' END AS message, (doc_id % 5 <> 1 OR doc_id % 11 = 3) AS served FROM j WHERE place = 0 OR (place = 1 AND doc_id % 5 = 1) OR (place = 2 AND doc_id % 7 = 2)"""
