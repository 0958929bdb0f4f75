"""Keyed state over several micro-batches: verdicts as in one, and state that ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.streaming import limits, run


def _drained(stream, folder):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return query, {(r.user, r.event_id): r.allowed for r in stream.sparkSession.read.parquet(f"{folder}/out").collect()}


def test_idle_state_ends_and_verdicts_stay(spark, tmp_path):
    # a file a batch: user 1 hits at all times, users 10 to 19 only in the first
    rows = [[(1, 1e6 + 100.0 * b + k, 10 * b + k, 0) for k in range(4)] for b in range(5)]
    rows[0] += [(10 + u, 1e6 + 50.0, 1000 + u, 0) for u in range(10)]
    for batch in rows:
        spark.createDataFrame(batch, "user long, at double, event_id long, extra int").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    schema = spark.read.parquet(str(tmp_path / "events")).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    step, out, state = limits.fixed_window(3, 60.0), "allowed boolean, remaining int, reset double", "began double, hits int"
    ends, found = _drained(limits.keyed(events, "user", "at", "event_id", "extra", step, out, state, idle=60.0, late=10.0), tmp_path / "ends")
    stays, kept = _drained(limits.keyed(events, "user", "at", "event_id", "extra", step, out, state), tmp_path / "stays")
    assert found == kept == {(u, e): u != 1 or e % 10 < 3 for batch in rows for u, _, e, _ in batch}
    left = lambda q: q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left(stays) == 11 and left(ends) == 1


def test_one_batch_or_many_give_one_answer(spark, tmp_path):
    users = spark.range(300).select((F.col("id") % 7).alias("user"), (1e6 + F.col("id") * 11.0).alias("at"), F.col("id").alias("event_id"), F.lit(0).alias("extra"))
    for k in range(4):
        users.where((F.col("event_id") >= 75 * k) & (F.col("event_id") < 75 * k + 75)).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    step, out, state = limits.sliding_window(3, 300.0), "allowed boolean, hits int", "recent array<double>"
    answers = []
    for name, most in (("one", 100), ("many", 1)):
        events = spark.readStream.schema(users.schema).option("maxFilesPerTrigger", most).parquet(str(tmp_path / "events"))
        answers.append(_drained(limits.keyed(events, "user", "at", "event_id", "extra", step, out, state, idle=300.0), tmp_path / name)[1])
    assert answers[0] == answers[1] and len(answers[0]) == 300 and len(set(answers[0].values())) == 2
    assert run.drain(limits.keyed(events, "user", "at", "event_id", "extra", step, out, state, idle=300.0)).count() == 300


def test_sessions_slide_past_half_and_their_state_ends(spark):
    from corpusmill.streaming import sessions

    hour = 3600.0
    # user 1: opened, used (half is left), extended, signed out, none, opened; user 2 only at the start; user 3 keeps time going
    mine = [(1, 0.0, 0), (1, 12.0, 0), (1, 13.0, 0), (1, 14.0, 1), (1, 15.0, 1), (1, 16.0, 0)]
    rows = [(u, 1e6 + h * hour, i, e) for i, (u, h, e) in enumerate(mine + [(2, 0.5, 0), (3, 40.0, 0), (3, 90.0, 0), (3, 200.0, 0), (3, 201.0, 0)])]
    events = spark.createDataFrame([*rows, (None, 1e6, 99, 0), (4, None, 98, 0)], "user long, at double, id long, out int")
    build = lambda s: sessions.keyed(s, "user", "at", "id", "out", sessions.sliding_session(24 * hour), "verdict string, expires double, sessions int", "began double, expires double", "opened int", late=hour)
    found, progress = run.replay(events, "at", build, parts=4)
    told = {r.id: (r.verdict, r.expires and (r.expires - 1e6) / hour, r.sessions) for r in found.collect()}
    assert [told[i] for i in range(7)] == [("opened", 24.0, 1), ("used", 24.0, 1), ("extended", 37.0, 1), ("signed_out", None, 1), ("none", None, 1), ("opened", 40.0, 2), ("opened", 24.5, 1)]
    assert [told[i][0] for i in range(7, 11)] == ["opened", "opened", "opened", "used"] and len(told) == 11
    assert len({p["batchId"] for p in progress if p["numInputRows"]}) > 1
    held = [o.numRowsTotal for p in progress for o in p.stateOperators]
    # three counts of sessions stay; timers took the sessions of users 1 and 2 and the first of user 3
    assert max(held) == 6 and held[-1] == 4


def test_a_forgotten_key_begins_anew(spark):
    from corpusmill.streaming import sessions

    events = spark.createDataFrame([(1, 1e6 + i, i, int(i == 4)) for i in range(8)] + [(1, 1e6 + 200, 8, 0)], "user long, at double, id long, forget int")
    build = lambda s: sessions.keyed(s, "user", "at", "id", "forget", sessions.forgettable_window(2, 60.0), "allowed boolean, remaining int", "began double, hits int", late=10.0)
    found = {r.id: (r.allowed, r.remaining) for r in run.replay(events, "at", build)[0].collect()}
    assert found == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (None, 2), 5: (True, 1), 6: (True, 0), 7: (False, 0), 8: (True, 1)}
