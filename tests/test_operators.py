"""Ranking, chunking, reconciliation, papers and answers against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import papers as paper_fn
from corpusmill.functions import vectors
from corpusmill.operators import chunking, fusion, papers, reconcile, routing, search, usage
from corpusmill.plans import answer
from corpusmill.streaming import jobs, limits


def test_pieces_keep_every_sentence_and_overlap():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(300))
    parts = chunking.pieces(text, chunking.Sizes())
    assert len(parts) > 3 and all(chunking.tokens_of(p) <= 600 for p in parts)
    for a, b in zip(parts, parts[1:], strict=False):
        assert b.split(". ")[0] in a  # each begins with the end of the one before
    assert chunking.pieces("short", chunking.Sizes()) == ["short"]


def test_headings_set_the_context():
    blocks = [{"kind": "heading", "level": 1, "text": "A"}, {"kind": "paragraph", "text": "one", "page": 3}, {"kind": "paragraph", "text": "two"}, {"kind": "heading", "level": 2, "text": "B"}, {"kind": "record", "text": "k: v", "key": "7"}, {"kind": "heading", "level": 2, "text": "C"}, {"kind": "paragraph", "text": " "}]
    assert chunking.chunk_blocks("T", blocks, chunking.Sizes()) == [
        (0, "[Document: T > Section: A]\none\n\ntwo", 11, ["A"], 3, None),
        (1, "[Document: T > Section: A > B > Record: 7]\nk: v", 15, ["A", "B"], None, "7"),
    ]


def test_vector_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    corpus = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(500)] + [(500, [0.0] * 8), (501, [1.0])]
    asked = [(f"q{i}", [float(x) for x in rng.normal(size=8)]) for i in range(5)]
    found = search.vector_topk(spark.createDataFrame(asked, "query_id string, embedding array<float>"), spark.createDataFrame(corpus, "chunk_id long, embedding array<float>").repartition(3), 7, digits=9).collect()
    for name, q in asked:
        def cos(v):
            if len(v) != 8 or not np.linalg.norm(v):
                return 0.0
            v, w = np.asarray(v, "f4").astype(float), np.asarray(q, "f4").astype(float)
            return round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9)

        want = sorted(corpus, key=lambda c: (-cos(c[1]), c[0]))[:7]
        assert [r.chunk_id for r in sorted((r for r in found if r.query_id == name), key=lambda r: r.rank)] == [c[0] for c in want]


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine("a", "b")).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_keyword_search_needs_all_words(spark):
    corpus = spark.createDataFrame([(1, "red blue red"), (2, "blue and some words then red"), (3, "red only"), (4, None)], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "Red, BLUE"), (2, " "), (3, "missing")], "query_id int, text string")
    rows = search.keyword_topk(asked, corpus, 10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in rows] == [(1, 1), (1, 2)] and rows[0].score == 0.2


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([([5, 9, 4, 1, 1],)], "n array<bigint>").select(F.transform("n", lambda n: F.struct(n.alias("tokens"))).alias("x"))
    taken = lambda budget, most: [t.tokens for t in df.select(fusion.within_budget(F.col("x"), budget, most)).first()[0]]
    assert taken(10, 9) == [5, 4, 1] and taken(10, 2) == [5, 4] and taken(0, 3) == []


def test_diversify_is_greedy(spark):
    rng = random.Random(1)
    rows = [(q, c, round(rng.random(), 3), [rng.gauss(0, 1) for _ in range(4)]) for q in range(3) for c in range(20)]
    got = fusion.diversify(spark.createDataFrame(rows, "query_id int, chunk_id int, score double, embedding array<double>"), 0.6, 9).collect()
    for q in range(3):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        picks = [mine.pop(0)]
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        while len(picks) < 9:
            best = max(mine, key=lambda r: 0.6 * r[2] - 0.4 * max(0.0, *(float(unit(r[3]) @ unit(p[3])) for p in picks)))
            picks.append(best)
            mine.remove(best)
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pick)] == [p[1] for p in picks]


def test_reconcile_by_name(spark):
    ordered = spark.createDataFrame([("d", 1, "steel bar 12 mm", 40.0), ("d", 2, "cement bag", 10.0), ("d", 3, "paint white", 5.0), ("d", 4, "roof tile", 7.0)], "doc string, place int, item string, qty double")
    got = spark.createDataFrame([("d", 1, "Steel-bar 12mm", 38.0), ("d", 2, "cement bags", 12.0), ("d", 3, "white paint", None), ("d", 4, "garden hose", 1.0)], "doc string, place int, item string, net double")
    rows = reconcile.by_name(ordered, got, "doc").collect()
    assert [(r.item, r.matched, r.status) for r in rows] == [("steel bar 12 mm", "Steel-bar 12mm", "under"), ("cement bag", "cement bags", "over"), ("paint white", "white paint", "qty_unreadable"), ("roof tile", None, "missing"), (None, "garden hose", "unexpected")]
    assert not reconcile.all_ok(spark.createDataFrame([("d", "ok"), ("d", "over")], "doc string, status string"), "doc").first().all_ok


def test_paper_items(spark):
    md = "<table><tr><td>ลำดับ</td><td>รายการ</td><td>จำนวน</td><td>หน่วย</td><td>หมายเหตุ</td></tr><tr><td>1</td><td>ปูน</td><td>4.000</td><td>ถุง</td><td>ชำรุด 2</td></tr><tr><td>3</td><td>ทราย</td><td>1,200 กก</td><td>-</td><td>-</td></tr></table>"
    items = papers.line_items(spark.createDataFrame([(1, md)], "doc int, md string"), "doc", "md").orderBy("place").collect()
    assert [(i.idx, i.description, i.qty, i.qty_raw, i.unit, i.note) for i in items] == [(1, "ปูน", None, "4.000", "ถุง", "ชำรุด 2"), (3, "ทราย", 1200.0, None, "กก.", None)]
    heads = spark.createDataFrame([(1, "PO-1", "1/2/2568", "delivery_note"), (2, None, "1/2/2400", "text")], "doc int, doc_no string, date string, doc_type string")
    checked = {r.doc: r for r in papers.structural(papers.line_items(spark.createDataFrame([(1, md)], "doc int, md string"), "doc", "md"), heads, "doc", 2026).collect()}
    assert checked[1].reasons == ["rows_sequential", "all_rows_have_qty", "no_ambiguous_qty"] and "has_items" in checked[2].reasons
    e = spark.range(1).select(paper_fn.exception(F.lit("แตก 3 แผ่น"), F.lit(10.0)).alias("e")).first().e
    assert (e.kind, e.qty, e.net_qty) == ("แตก", 3.0, 7.0)


def test_routing_follows_a_chain(spark):
    models = spark.createDataFrame([("a", 1, "small", 1, 100, True, True, False), ("b", 1, "large", 1, 1000, True, False, False), ("c", 2, "medium", 1, 1000, False, True, False)], "model string, provider int, tier string, priority int, max_context int, enabled boolean, streams boolean, open boolean")
    asked = spark.createDataFrame([(1, "custom", None, None, ["c", "b", "a"], 50, False), (2, "auto", "fast", None, [], 500, False), (3, "auto", "fast", None, [], 50, True)], "request_id int, policy string, reasoning string, provider int, chain array<string>, context_tokens int, streaming boolean")
    rows = routing.plan_models(asked, models).orderBy("request_id", "place").collect()
    assert [(r.request_id, r.model) for r in rows] == [(1, "b"), (1, "a"), (2, "b"), (3, "a")]


def test_answers_cite_and_refuse(spark):
    docs = spark.createDataFrame([(1, "The shop opens at nine in the morning on working days."), (2, "Cats sleep most of the day and hunt at night.")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "When does the shop open in the morning"), (2, " "), (3, "zzz qqq")], "query_id long, text string")
    rows = {r.query_id: r for r in answer.answer(asked, answer.ingest(docs), answer.Policy(least_relevance=0.4)).collect()}
    assert rows[1].grounded and "nine in the morning" in rows[1].answer and [s["index"] for s in rows[1].sources] == [1]
    assert not rows[2].ok and rows[2].reason == "empty" and rows[2].answer is None
    assert rows[3].answer == answer.Policy().fallback and not rows[3].grounded


def _run(step, events):
    state, out = None, []
    for at, extra in events:
        state, verdict = step(state, at, extra)
        out.append(verdict)
    return out


def test_fixed_and_sliding_windows():
    hits = [(0.0, 0), (1.0, 0), (2.0, 0), (9.0, 0), (10.5, 0)]
    assert [v[0] for v in _run(limits.fixed_window(2, 10.0), hits)] == [True, True, False, False, True]
    assert [v[1] for v in _run(limits.fixed_window(2, 10.0), hits)] == [1, 0, 0, 0, 1]
    assert [v[0] for v in _run(limits.sliding_window(2, 10.0), hits)] == [True, True, False, False, True]
    assert [v[0] for v in _run(limits.throttle(5.0), hits)] == [True, False, False, True, False]
    assert [v[0] for v in _run(limits.cached(5.0), hits)] == [False, True, True, False, True]


def test_circuit():
    calls = [(0.0, True), (1.0, True), (2.0, False), (3.0, False), (33.0, True), (40.0, False), (64.0, False), (65.0, True)]
    assert _run(limits.circuit(2, 60.0, 30.0), calls) == [("closed", True), ("closed", True), ("open", False), ("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]


def test_jobs():
    step = jobs.lifecycle(most_tries=2, stale=100.0)
    events = [(0.0, "claim"), (1.0, "transient"), (5.0, "claim"), (40.0, "claim"), (41.0, "transient"), (900.0, "claim")]
    assert [v[:2] for v in _run(step, events)] == [("running", 1), ("pending", 1), ("pending", 1), ("running", 2), ("dead", 2), ("dead", 2)]
    assert [v[0] for v in _run(step, [(0.0, "claim"), (200.0, "complete")])] == ["running", "pending"]
    assert [v[0] for v in _run(step, [(0.0, "claim"), (2.0, "permanent")])] == ["running", "dead"]


def test_streamed_state_equals_the_step(spark):
    from corpusmill.queries import streams

    sf = "/root/testdata/sf0.001"
    got = {r.event_id: (r.allowed, r.remaining) for r in streams.R.queries["st_rate_limit"](spark, sf).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    want, states = {}, {}
    step = limits.fixed_window(3, 86400.0)
    for e in events:
        states[e.user_id], verdict = step(states.get(e.user_id), e.ts.timestamp(), 0)
        want[e.event_id] = verdict[:2]
    assert got == want


def test_words_of_vectors_lie_between_white_space():
    vector = vectors.hash_vector("Refunds, refunds　refunds\x1cx", 4096, {})
    want = np.zeros(4096)
    for word in ("refunds,", "refunds", "refunds\x1cx"):
        want[vectors.word_hash(word) % 4096] += 1
    assert np.allclose(vector, want / np.sqrt(3))


def test_paragraphs_gather_until_the_target():
    words = lambda n: " ".join(["word"] * n)
    blocks = [{"kind": "paragraph", "level": None, "text": words(n), "page": p} for p, n in enumerate((3, 4, 2, 9, 1), 1)]
    found = chunking.chunk_blocks("T", blocks, chunking.Sizes(target=6, overlap=1, most=100))
    assert [(page, content.count("\n\n")) for _, content, _, _, page, _ in found] == [(1, 1), (3, 1), (5, 0)]


def test_places_over_all_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *range(40)])) for i in range(500)]
    got = fusion.placed(spark.createDataFrame(rows, "id int, size int").repartition(5), ["size", "id"], "place").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted((r.place, r.id) for r in got) == [(k + 1, r[0]) for k, r in enumerate(want)]


def test_references_are_decoded_in_lines(spark):
    df = spark.createDataFrame([("<DIV>a &eacute; &#3585;</DIV>b &lt;i&gt;<br/>&amp;amp; c",), (None,), ("<h2 class='x'>t</h2>u",)], "x string")
    assert [r[0] for r in df.select(paper_fn.plain_lines("x")).collect()] == [["a é ก", "b <i>", "&amp; c"], None, ["t", "u"]]


def test_injected_embedder_and_chat(spark):
    def embedder(texts):
        return [(i, [float(len(t) % 7), 1.0]) for i, t in reversed(list(enumerate(texts)))]

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "doc_id long, text string")
    chunks = answer.ingest(docs, width=2, embedder=embedder)
    assert {r.chunk_id: list(r.embedding) for r in chunks.collect()} == {r.chunk_id: [float(len(r.content) % 7), 1.0] for r in chunks.collect()}
    asked = spark.createDataFrame([(1, "alpha beta"), (2, " ")], "query_id long, text string")
    said = {r.query_id: r.answer for r in answer.answer(asked, chunks, answer.Policy(width=2), embedder, lambda model, prompt: f"{model} says {prompt.split()[-1]} [1]", ("m",)).collect()}
    assert said == {1: "m says beta [1]", 2: None}
    blocks = spark.createDataFrame([(1, [("heading", 1, "Top", None, None), ("record", None, "k: v", None, "9")])], "doc_id long, blocks array<struct<kind:string,level:int,text:string,page:int,key:string>>")
    assert [(r.heading_path, r.record_key) for r in answer.ingest(blocks).collect()] == [(["Top"], "9")]


def test_percentiles_are_exact_values_over_many_ranges(spark):

    random.seed(5)
    rows = [("hot", float(random.randrange(40) if random.random() < 0.5 else random.random() * 1e6)) for _ in range(6000)]
    rows += [(f"g{i % 700}", float(i * 37 % 101)) for i in range(2100)] + [(None, 3.0), (None, 1.0), ("nulls", None), ("mixed", None), ("mixed", 5.0), ("nan", math.nan), ("nan", 1.0)]
    found = {r.value: r for r in usage.percentiles(spark.createDataFrame(rows, "value string, n double").repartition(6), ["value"], "n").collect()}
    groups: dict = {}
    for key, x in rows:
        groups.setdefault(key, []).append(x)
    assert set(found) == set(groups) and len(found) == 705
    for key, xs in groups.items():
        held = sorted((x for x in xs if x is not None), key=lambda x: (math.isnan(x), x))
        for share in (50, 95, 99):
            wanted = held[max(1, -(-len(held) * share // 100)) - 1] if held else None
            got = found[key][f"p{share}"]
            assert got == wanted or (math.isnan(got) and math.isnan(wanted)), (key, share)
    assert usage.percentiles(spark.createDataFrame([], "value string, n double"), ["value"], "n").count() == 0
