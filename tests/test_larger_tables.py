"""Queries over tables that the small scale factors do not have: long texts, copies, many keys."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.functions import papers as paper_functions
from corpusmill.functions import text as text_functions
from corpusmill.functions import vectors
from corpusmill.operators import keyword_index, language, papers, reconcile, search, vector_index
from corpusmill.plans import answer
from corpusmill.queries import Tables, retrieval
from corpusmill.sources import parsers
from corpusmill.streaming import run, sessions
from corpusmill.streaming.dispatch import Dispatcher


def test_sizes_beyond_an_integer(spark, tmp_path):
    rows = [(2, "x" * 120_000), (3, "x"), (6, None), (403, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["refusal"] for r in catalog.QUERIES["upload_gate"](spark, str(tmp_path)).collect()}
    assert found == {2: "too_large", 3: None, 6: None, 403: "too_many_documents"}


def test_refusals_of_odd_documents_are_those_of_the_sql(spark, tmp_path):
    texts = [None, "", " \n\t", "\u2028\x85", "\u00a0", "x" * 121, "\u0e01" * 600, "y" * 2001, "\U0001f600" * 30]
    rows = [(key, text) for key in (None, *range(-16, 17), 33, 88) for text in texts]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found, wanted = (Counter(map(tuple, rows)) for rows in (catalog.QUERIES["parse_errors"](spark, str(tmp_path)).collect(), duck.sql(catalog.ORACLE_SQL["parse_errors"]).fetchall()))
    assert found == wanted and {code for _, code in found} == {None, "unsupported_file_type", "file_too_large", "parse_timeout", "no_extractable_text"}


def test_recall_of_vectors_without_lumps():
    chance = np.random.RandomState(1)
    vectors, asked = (vector_index._unit(chance.normal(size=(n, 64)).astype("f4")) for n in (8000, 100))
    links, entries = vector_index.links_of(vectors), vector_index.entries_of(vectors)
    wanted = np.argsort(-(asked @ vectors.T), axis=1)[:, :30]
    found = vector_index.walk(asked, vectors, links, entries, vector_index.beam_of(vectors, links, entries))[:, :30]
    assert np.mean([len(set(a) & set(b)) / 30 for a, b in zip(found.tolist(), wanted.tolist(), strict=True)]) >= 0.92
    # a place that a walk is without is never found
    assert (vector_index.walk(vectors[:50], vectors, links, entries, 96, np.arange(50)) != np.arange(50)[:, None]).all()
    few = vectors[:20]
    assert vector_index.beam_of(few, vector_index.links_of(few), vector_index.entries_of(few)) == vector_index.BEAM


def test_claims_do_not_grow_with_the_queue(spark, tmp_path):
    seen = []
    queue = Dispatcher(spark, str(tmp_path / "queue"), {kind: lambda jobs, _, kind=kind: seen.append((kind, jobs.count())) for kind in ("late", "soon")})
    number = F.col("id")
    queue.enqueue(spark.range(25_000).select(number.alias("job_id"), F.when(number % 5 == 0, "soon").otherwise("late").alias("kind"), F.when(number % 5 == 0, None).otherwise(number % 2).cast("int").alias("priority")))
    assert queue.run(1.0) == 3  # nulls come first, as in any order by priority
    assert seen == [("soon", 5_000), ("late", 10_000), ("late", 10_000)]
    assert {(r["status"], r["count"]) for r in queue.states().groupBy("status").count().collect()} == {("complete", 25_000)}


def test_items_and_pairs_of_papers_without_shuffles(spark):
    head = "<tr><th>รายการ</th><th>จำนวน</th></tr>"
    small, large = (f"<table>{head}" + "".join(f"<tr><td>item {k}</td><td>{k} กก</td></tr>" for k in range(n)) + "</table>" for n in (1, 2))
    rows = [(1, small + large + large), (2, "<table><tr><td>a</td></tr></table>"), (3, ""), (4, None), (5, f"<p>ผู้รับ: คลัง</p><table>{head}<tr><td> </td><td>1</td></tr></table>")]
    df = spark.createDataFrame(rows, "doc int, md string")
    items = papers.line_items(df, "doc", "md")
    assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc, r.place, r.description, r.qty, r.unit) for r in items.orderBy("doc", "place").collect()] == [(1, 1, "item 0", 0.0, "กก."), (1, 2, "item 1", 1.0, "กก.")]
    assert ("ผู้รับ", "คลัง") in {(r.key, r.value) for r in papers.pairs(df, "doc", "md").where("doc = 5").collect()}


def test_plain_tags_are_read_as_the_parser_reads_them():
    texts = ["<table><tr><td>a<td>b</tr>x<tr><th> <b>c</b>d<br>e</th></table>f", "<td>1<table>2<td>3</table><td>4</td>5", "<TABLE><TR><TD>a > b</TD></TR></TABLE>", "<table></table><tr><td>x", "a<table><br><td>y<table><td>z"]
    for text in texts:
        reader = parsers._Tables()
        reader.feed(text)
        reader.close()
        assert parsers._read_tables(text) == reader.tables, text


def test_an_index_for_one_search_holds_its_words_only(spark):
    corpus = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "The mat."), (3, None), (4, "a dog")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "Mat the"), (2, None)], "query_id long, text string")
    only = keyword_index.words_of(asked)
    assert sorted(only) == ["mat", "the"] and keyword_index.words_of(asked, 1) is None
    small, whole = keyword_index.index_words(corpus, only=only), keyword_index.index_words(corpus)
    assert {r["word"] for r in small.postings.collect()} == {"mat", "the"}
    found, wanted = (sorted(map(tuple, keyword_index.search_words(asked, index, 9).collect())) for index in (small, whole))
    assert found == wanted and len(found) == 2
    assert keyword_index.index_words(corpus, only=[]).postings.count() == 0


def test_words_are_hashed_together_as_one_by_one():
    texts = ["a a\tb\x1cc", None, "", "Üx  " + "y" * 300, "a"]
    words = ["a", "b\x1cc", "üx", "y" * 300, ""]
    assert vectors.word_hashes(words).tolist() == [vectors.word_hash(w) for w in words] and not len(vectors.word_hashes([]))
    want = np.zeros((5, 64))
    for row, some in zip(want, (["a", "a", "b\x1cc"], [], [], ["üx", "y" * 300], ["a"]), strict=True):
        for word in some:
            row[vectors.word_hash(word) % 64] += 1
        row /= np.linalg.norm(row) or 1
    assert (vectors.hash_vectors(texts, 64) == want).all()


def test_texts_are_normalized_as_by_regular_expressions(spark):
    signs = [" ", "\t", "\n", "\r", "-", "a", "B", "\x00", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\xa0", "\n\n\n"]
    chance = np.random.RandomState(5)
    rows = [("".join(chance.choice(signs, chance.randint(0, 12))),) for _ in range(3000)] + [(None,)]
    c = F.col("text")
    for pattern, by in ((r"\r\n?", "\n"), (r"-[ \t]*\n\s*(?=\p{Ll})", ""), (r"[\x00-\x08\x0B-\x1F\x7F]", ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(c, pattern, by)
    told = spark.createDataFrame(rows, "text string").select("text", c.alias("want"), text_functions.normalize("text").alias("found"))
    assert told.where("NOT (want <=> found)").count() == 0


def test_chunks_are_cut_and_embedded_without_a_shuffle_of_contents(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (2, "one two", "y"), (3, None, "x")], "doc_id long, text string, base_id string")
    chunks = answer.ingest(docs, keep=("base_id",))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {(r.chunk_id, r.base_id, len(r.embedding)) for r in chunks.collect()} == {("chk_1_0", "x", 64), ("chk_2_0", "y", 64)}
    plan = retrieval.rag_chunk(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Join" not in plan  # no vectors for chunks alone


def test_the_best_of_equal_scores_come_in_order_of_ids(spark):
    scores = np.array([[0.0, 2.0, 1.0, 2.0, 1.0], [0.0] * 5])
    assert [x.tolist() for x in search._best(scores, 3)] == [[0, 0, 0, 1, 1, 1], [1, 3, 2, 0, 1, 2]]
    assert [len(x) for x in search._best(scores, 9)] == [10, 10]
    corpus = spark.createDataFrame([(f"c{k}", [1.0, 0.0] if k % 2 else [0.0, 1.0, 0.0]) for k in range(9, -1, -1)] + [("n", None)], "chunk_id string, embedding array<float>")
    found = search.vector_topk(spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, embedding array<float>"), corpus, 6)
    assert [(r.query_id, r.chunk_id, r.score) for r in found.orderBy("query_id", "rank").collect()] == [(1, f"c{k}", s) for k, s in zip((1, 3, 5, 7, 9, 0), (1.0,) * 5 + (0.0,), strict=True)] + [(2, f"c{k}", 0.0) for k in range(6)]


def test_names_that_come_again_are_compared_once(spark, monkeypatch):
    free = [{"item": x} for x in ("Red bolt", "red-bolt", "blue nut", "red bolt")]
    assert reconcile._likest("RED BOLT -", free) == (1.0, 0) and reconcile._likest("zzz", free) == (0.0, 0) and reconcile._likest("x", []) == (0.0, 0)
    names = ["red bolt", "new anvil", "hot ring", "red ring", "RED BOLT -", ""]
    for a in names:
        want = max((reconcile.likeness(a, b), -k) for k, b in enumerate(names))
        assert reconcile._likest(a, [{"item": b} for b in names]) == (want[0], -want[1])
    reconcile._likeness.cache_clear()
    for _ in range(50):
        reconcile._likest("green gear", free)
    assert reconcile._likeness.cache_info().misses == 4


def test_texts_to_learn_from_are_chosen_without_the_texts(spark):
    rows = [(f"{lang} text number {k % 40} of many", lang) for lang in ("de", "en") for k in range(120)] + [(None, "de"), ("x", None)]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    ranked = []
    window = language.Window.partitionBy
    try:
        language.Window.partitionBy = lambda *keys: ranked.append(keys) or window(*keys)
        few = language.fit(labelled, most_texts=7)
    finally:
        language.Window.partitionBy = window
    assert ranked[0] == ("l", "part")  # a language's digests are cut in parts before they meet
    chosen = {lang: sorted({t for t, x in rows if x == lang and t}, key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())[:7] for lang in ("de", "en")}
    again = language.fit(spark.createDataFrame([(t, lang) for lang, some in chosen.items() for t in some], "text string, lang string"))
    assert few == again and few.names == ("de", "en")


def test_languages_are_learned_from_all_texts_and_runs(spark):
    # more texts of a language than 2,000 and more runs than 20,000, each run in one text; a text twice counts once
    runs = lambda k: chr(0x4E00 + k % 151) + chr(0x4E00 + k // 151) + chr(0x5000 + k % 7)
    of = lambda lang, start, n: [(" ".join(runs(start + 10 * k + i) for i in range(10)), lang) for k in range(n)]
    rows = [*of("one", 0, 2_100), *of("two", 21_000, 100), *of("two", 21_000, 100)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    counts = {lang: Counter() for lang in ("one", "two")}
    for text, lang in set(rows):
        counts[lang].update(language.runs_of(text))
    assert model.names == ("one", "two") and set(model.weights) == set(counts["one"]) | set(counts["two"]) and len(model.weights) > 20_000
    size = 0.5 * (len(model.weights) + 1)
    for place, lang in enumerate(model.names):
        total = sum(counts[lang].values()) + size
        assert all(abs(weights[place] - math.log((counts[lang][run] + 0.5) / total)) < 1e-12 for run, weights in model.weights.items())


def test_ranking_diversifies_and_keeps_to_the_budget(spark, monkeypatch):
    chunks = answer.ingest(spark.createDataFrame([(k, f"red green blue {'blue ' * (k % 4)}{'word' * (k % 3)} text {k}") for k in range(40)], "doc_id long, text string"))
    chunks = chunks.withColumn("token_count", F.when(F.col("doc_id") % 5 == 0, 7000).otherwise(F.col("doc_id").cast("int") * 40))  # some alone, and many together, are beyond the budget
    asked = spark.createDataFrame([(1, "red green blue"), (2, "blue text"), (3, "nothing alike")], "query_id long, text string")
    monkeypatch.setattr(retrieval, "_questions", lambda t: asked)
    monkeypatch.setattr(retrieval, "_ingested", lambda t: chunks)
    policy = answer.Policy(hybrid=False)
    held = {r.chunk_id: (r.token_count, np.array(r.embedding, float) / np.linalg.norm(r.embedding)) for r in chunks.collect()}
    found: dict = {}
    for r in answer.candidates(asked, chunks, policy).collect():
        found.setdefault(r.query_id, {})[r.chunk_id] = r.score
    rows = catalog.QUERIES["rag_rank"](spark, "unused").orderBy("query_id", "rank").collect()
    wanted = []
    for query, scores in sorted(found.items()):
        free, picks, taken, used = sorted(scores, key=lambda c: (-scores[c], c)), [], [], 0
        while free and len(picks) < 2 * policy.passages:
            near = lambda c: max(0.0, *(float(held[c][1] @ held[p][1]) for p in picks), 0.0)  # noqa: B023, E731
            picks.append(max(free, key=lambda c: round(policy.relevance * scores[c] - (1 - policy.relevance) * near(c), 12)) if picks else free[0])
            free.remove(picks[-1])
        for c in picks:
            if len(taken) < policy.passages and used + held[c][0] <= policy.budget:
                taken.append(c)
                used += held[c][0]
        assert len(taken) < len(scores)
        wanted += [(query, c, round(scores[c], 9), k) for k, c in enumerate(taken, 1)]
    assert [tuple(r) for r in rows] == wanted and {1, 2} <= set(found)


def _many_pages(content):
    return [(k, "y" * 50) for k in range(int(content), 0, -1)]


def test_pages_are_handed_on_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(parsers, "PAGES_HELD", 2_000)
    df = spark.createDataFrame([(1, b"30"), (2, b"x"), (3, b"0"), (4, b"2")], "doc long, content binary").coalesce(1)
    pages = parsers.ocr_pages(df, "doc", "content", _many_pages)
    assert [(r.doc, r.page) for r in pages.where("error IS NULL").collect()] == [(1, k) for k in range(1, 31)] + [(4, 1), (4, 2)]
    assert [r.doc for r in pages.where("error IS NOT NULL").collect()] == [2]


def test_many_keys_of_a_stream_are_taken_together(spark):
    day = 86400.0
    rows = [(u, 1e6 + day * (k * 0.7 + u / 9000), 10 * u + k, (u + k) % 5 == 0) for u in range(3000) for k in range(6)]
    events = spark.createDataFrame(rows, "user long, at double, id long, out boolean")
    turn = sessions.sliding_session(day)
    wanted = {}
    for user in range(3000):
        now, ends, stays = None, 0.0, None
        for _, at, number, out in rows[6 * user : 6 * user + 6]:
            now, ends, stays, wanted[number] = turn(now if ends > at else None, stays, at, out)
    found, progress = run.replay(events, "at", lambda s: sessions.keyed(s, "user", "at", "id", "out", turn, "verdict string, expires double, sessions int", "began double, expires double", "opened int", late=60.0))
    assert {r.id: (r.verdict, r.expires, r.sessions) for r in found.collect()} == wanted
    # a call and its frame for a group of users, so no timer for every user
    assert sum(o.customMetrics["numRegisteredTimers"] for p in progress for o in p.stateOperators) <= 6 * 1024


def test_papers_are_rid_of_tags_once(spark):
    signs = [" ", "\t", "\n", "\r", "\x0b", "\x85", "\u2028", "a", "ก", "&amp;", "&", "<", "<br>", "<BR/>", "<hr x=1/>", "</p>", "</P >", "</td>", "</tH\n>", "</tr>", "</h3>", "</h7>", "</div x>", "<td>", "<p class='&'>", "</LI>", "</l>", "/>", "&#10;", "<br"]
    chance = np.random.RandomState(3)
    texts = spark.createDataFrame([("".join(chance.choice(signs, chance.randint(0, 14))),) for _ in range(3000)] + [(None,)], "md string")
    c = F.regexp_replace("md", r"(?i)<(?:br|hr|/p|/li|/div|/td|/th|/tr|/h[1-6])(?:\s[^<>]*)?/?>", "\n")
    c = paper_functions._decoded(F.regexp_replace(c, "<[^<>]+>", " "))
    wanted = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    found = texts.select(paper_functions.plain_lines("md").alias("found"))
    assert texts.select(paper_functions.plain_lines("md").alias("found"), wanted.alias("wanted")).where("NOT (found <=> wanted)").isEmpty()
    # once for what goes to Python and once for the rest
    assert found._jdf.queryExecution().executedPlan().toString().count("<[^<>]+>") == 2


def test_windows_of_many_keys_are_taken_together(spark):
    rows = [(u, 1e6 + 20.0 * k + u / 1000, 6 * u + k, (u + k) % 4 == 3) for u in range(3000) for k in range(6)]
    turn, wanted = sessions.forgettable_window(2, 50.0), {}
    for user in range(3000):
        now, ends = None, 0.0
        for _, at, number, forget in rows[6 * user : 6 * user + 6]:
            now, ends, _, wanted[number] = turn(now if ends > at else None, None, at, forget)
    events = spark.createDataFrame(rows, "user long, at double, id long, forget boolean")
    found, progress = run.replay(events, "at", lambda s: sessions.keyed(s, "user", "at", "id", "forget", turn, "allowed boolean, remaining int", "began double, hits int", late=10.0, sweep=1.0))
    assert {r.id: (r.allowed, r.remaining) for r in found.collect()} == wanted
    # windows that end are cleared by their group's timer
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 3000
    assert sum(o.customMetrics["numRegisteredTimers"] for p in progress for o in p.stateOperators) <= 6 * 1024


def test_state_has_no_more_parts_than_its_rows_need(spark, tmp_path, monkeypatch):
    import duckdb

    rows = [(10 * u + k, 1.7e9 + 30_000.0 * k + u, u, "purchase" if (u + k) % 4 == 3 else "view") for u in range(200) for k in range(6)]
    events = spark.createDataFrame(rows, "event_id long, at double, user_id long, event_type string")
    events.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    told, replay, name = [], run.replay, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(run, "replay", lambda *a, **k: told.append(replay(*a, **k)) or told[-1])
    before = spark.conf.get(name)
    spark.conf.set(name, "32")
    try:
        found = catalog.QUERIES["st_rate_evict"](spark, str(tmp_path)).select("user_id", "event_id", "allowed", "remaining").collect()
        assert {o.numShufflePartitions for p in told[0][1] for o in p.stateOperators} == {8} and spark.conf.get(name) == "32"
        # as many as the rows need, within what the session allows
        assert [run._state_parts(spark, n) for n in (0, 10 * run.PART_ROWS + 1, 10**9)] == [8, 11, 32]
    finally:
        spark.conf.set(name, before)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert sorted(map(tuple, found)) == sorted(db.execute(catalog.ORACLE_SQL["st_rate_evict"]).fetchall())
