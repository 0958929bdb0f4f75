"""Near copies, mixing, toxicity, pages, chats and the pipeline, against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import chat, html_extract, minhash, mixing, queries, shingles, toxicity
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.001"


def _plain_components(rows, percent=85):
    def words(text):
        return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]

    sets = []
    for i, text in rows:
        w = words(text)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        lowest[find(k)] = min(lowest.get(find(k), i), i)
    return sorted((i, len(s), lowest[find(k)]) for k, (i, s) in enumerate(sets))


def test_sketch_agreement_is_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for n, shared in ((3000, 2000), (60, 40), (5, 5), (1, 0)):
        a, b = pool[:n], np.concatenate([pool[:shared], pool[-(n - shared) :]]) if n > shared else pool[:n]
        x, y = (shingles.fast_similarity_sketch(np.unique(s), 1024) for s in (a, b))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - want) < 0.07
        assert (x != np.iinfo(np.uint64).max).all()


def test_more_rounds_change_nothing():
    elements = np.arange(1, 50, dtype=np.uint64)
    sketch = shingles.fast_similarity_sketch(elements, 64)
    assert (sketch >> np.uint64(40)).max() < 128
    assert (shingles.fast_similarity_sketch(elements[::-1].copy(), 64) == sketch).all()


def test_near_copies_on_awkward_rows(spark):
    docs = documents(spark)
    rows = minhash.near_components(docs).collect()
    want = _plain_components([(r.doc_id if r.doc_id is not None else 10**9, r.text) for r in docs.collect()])
    got = sorted((r.doc_id if r.doc_id is not None else 10**9, r.n_shingles, r.component_id if r.component_id is not None else 10**9) for r in rows)
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert minhash.near_components(empty(spark)).count() == 0
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 9]  # one row of each group, repeated rows included


def test_chains_of_near_copies_join_through_their_middle(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, now = [], words[:]
    for i in range(40):  # each differs a little from the one before, the ends much from each other
        rows.append((i, " ".join(now)))
        for _ in range(2):
            now[rng.randrange(400)] = f"x{i}_{rng.random()}"
    rng.shuffle(rows)
    monkeypatch.setattr(minhash, "BLOCK", 7)  # buckets larger than a block
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(docs).collect())
    assert got == _plain_components(rows)


def test_op9_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op9_minhash_dedup(spark, SF).collect())
    assert got == _plain_components([(d.doc_id, d.text) for d in docs])


@pytest.mark.parametrize("percent", [85, 80])
def test_op9_equals_an_exact_join_of_a_larger_table(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(docs, percent=percent).collect())
    assert got == _plain_components([(d.doc_id, d.text) for d in docs.collect()], percent)


def test_bands_follow_the_threshold(spark):
    assert minhash.layout(85) == (36, 7) and minhash.layout(80) == (46, 6)
    for percent in (50, 80, 85, 95, 100):
        bands, rows = minhash.layout(percent)
        assert bands * rows <= minhash.MOST_COORDINATES and (1 - (min(percent, 99) / 100) ** rows) ** bands <= minhash.MISSED
    with pytest.raises(ValueError):
        minhash.layout(1)
    rows = [(i, " ".join([*(f"w{i // 2}_{k}" for k in range(200)), *(f"e{i}_{k}" for k in range(i % 2 * i // 2))])) for i in range(120)]  # pairs from alike to 200 of 259 words
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in minhash.keep_one_of_each(docs).collect())
    assert kept == sorted({c for _, _, c in _plain_components(rows, 80)}) and kept != sorted({c for _, _, c in _plain_components(rows)})


def test_targets():
    assert mixing.targets_of([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets_of([0, 10], [3, 1]) == [0, pytest.approx(15.0)]
    assert mixing.targets_of([], []) == []
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
        weights = [mixing.weights_in_turn(i) for i in range(len(sizes))]
        found = mixing.targets_of(sizes, weights)
        assert sum(found) == pytest.approx(1.5 * sum(sizes)) and all(f <= 2 * s + 1e-6 for f, s in zip(found, sizes, strict=True))
        free = [f / w for f, s, w in zip(found, sizes, weights, strict=True) if f < 2 * s - 1e-6]
        assert not free or max(free) == pytest.approx(min(free))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 500):
        sizes, chances = rng.integers(0, 900, n).astype(float), rng.random(n)
        pi = mixing.fly(chances, sizes, np.random.default_rng(1))
        assert ((pi > 0) & (pi < 1)).sum() <= 2 and ((pi >= 0) & (pi <= 1)).all()
        assert pi.sum() == pytest.approx(chances.sum()) and pi @ sizes == pytest.approx(chances @ sizes, rel=1e-6, abs=1e-3)
        assert set(mixing.land(pi, sizes)) <= {0.0, 1.0}


def test_flight_is_unbiased():
    sizes, chances = np.array([5.0, 8, 8, 13, 21, 1]), np.array([0.2, 0.5, 0.9, 0.4, 0.7, 0.3])
    runs = np.mean([mixing.fly(chances, sizes, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(runs - chances).max() < 0.03


def test_mix_rows(spark, monkeypatch):
    docs = documents(spark)
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_mix_in_blocks_reaches_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 25)
    plan = queries.op6_mixing(spark, "/root/testdata/sf0.01")
    for r in plan.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("taken"), F.max("copies").alias("most"), F.count("*").alias("n")).collect():
        assert abs(r.taken - r.t) <= max(50, 0.03 * r.t) and r.most <= 2
    assert plan.count() == 1000


def test_folding():
    assert toxicity.fold("ЅTUP1D") == toxicity.fold("stupid") and toxicity.fold("ｓｔｕｐｉｄ") == toxicity.fold("stupid")
    model = toxicity.Model(words={toxicity.fold("trash"): 5.0, toxicity.fold("idiot"): 4.0}, beginnings={toxicity.fold("moron"): 3.0})
    m = toxicity.Matcher(model)
    weigh = lambda t: m.weight(toxicity.fold(t))
    assert weigh("You 1d10t!") == 4.0 and weigh("what tr@sh, you id​iot") == 9.0
    assert weigh("the trash can") == 0.0 and weigh("trashy idiotic") == 0.0 and weigh("moronic oxymoron") == 3.0
    assert toxicity.Matcher(toxicity.Model()).score("") == toxicity.Matcher(toxicity.Model()).score("any")


def test_toxicity_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and len(none) == docs.count()
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    kept = toxicity.keep_clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_toxicity_term_survives_a_clean_row(spark):
    counts = [("", 3000, 300), ("=foulwort", 1, 16), ("=everyday", 1500, 150), ("=rare", 1, 2)]
    found = dict(toxicity._telling(spark.createDataFrame(counts, "term string, clean long, toxic long"), 10))
    assert set(found) == {"=foulwort"} and found["=foulwort"] > 1


@pytest.mark.parametrize("of_clean", [2, 5])
def test_toxicity_finds_every_language_at_any_training_size(spark, of_clean):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    some = labels.where((F.col("toxic") == 1) | (F.crc32(F.concat(F.lit("y"), F.col("doc_id")).cast("binary")) % 5 < of_clean))
    toxic = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").where(toxicity.held_out())
    scored = toxicity.score_column(toxic, toxicity.fit(docs, some)).where("lang <> 'en'").collect()
    assert sum(r.score >= 0.5 for r in scored) / len(scored) > 0.9


def test_op8_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r.predicted for r in scored if r.toxic == 1]
    false = [r.predicted for r in scored if r.toxic == 0]
    assert sum(hit) / len(hit) > 0.8 and sum(false) / len(false) < 0.02
    same = toxicity.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), 10**6)
    assert same.count() == spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()).count()


PAGE = """<html><body><header><h1>Site</h1></header><div id=menu><a href=#>x</a></div><div class="cookie-notice">We use cookies, ok, fine.</div><div class=wrap><div class="content">
<h2>Title</h2><p>Hello, this is the <b>main</b>\n text of it, with commas, and so on.<p>Second &amp; third &eacute;.<ul><li>item one<li>item two</ul><div class="share-buttons">Share me</div></div>
<div class=sidebar><p>Side text, many, commas, in, here, yes.</p></div></div><div id="comments"><p>Reader says, hi, there, long comment.</p></div><form><p>form, text</p></form><footer>foot</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Title Hello, this is the main text of it, with commas, and so on. Second & third é. item one item two"),
        (None, ""),
        ("", ""),
        ("  ", ""),
        ("<p>only", "only"),
        ("plain text", "plain text"),
        ("<nav>menu</nav><script>var x = '<p>no</p>'</script>", ""),
        ("<article><p>One.<p>Two</article><aside>no</aside>", "One. Two"),
        ("<div style='display: none'>no</div><main><section><p>A, b.</p></section><section><p>C.</p></section></main>", "A, b. C."),
        ("<p>a <!-- <p>no --> b</p", "a b"),
        ("<p title='x > y'>quoted</p>", "quoted"),
        ("<div class='page has-sidebar'><article><p>Kept, all.</p></article><div class='sidebar'><p>no</p></div></div>", "Kept, all."),
        ("<article><p>Text, here.</p><section id='comments'><article><p>no, no, no</p></article></section></article><article class='comment'><p>no</p></article>", "Text, here."),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='elementor-widget-container'><article><p>Kept, all.</p></article></div>", "Kept, all."),
        ("<div class='content has-comments'><article><p>Kept, all.</p></article></div>", "Kept, all."),
        ("<div class='hidden-print'><article><p>Kept, all.</p></article></div>", "Kept, all."),
        ("<div class='promo'><main><p>Kept, all.</p></main></div>", "Kept, all."),
        ("<article title='The hidden cost'><p>Kept, all.</p><p title=\"a class=comments b\">And this.</p></article>", "Kept, all. And this."),
        ("<article><p>Kept, all.</p><p data-x='1' hidden>no</p></article>", "Kept, all."),
        ("<div hidden><article><p>no</p></article></div><p>Kept.</p>", "Kept."),
        ("<main><p>Kept, all.</p><div id='comments'><article><p>no</p></article></div></main>", "Kept, all."),
        ("<article><p>Kept, all.</p></article><div class='related'><article><p>no</p></article></div>", "Kept, all."),
        ("<p>Hi.</p><div class='entry widgets'><p>" + "Long text, kept. " * 20 + "</p><div id='comments'><p>no</p></div></div>", "Long text, kept. " * 20),
        ("<div class='widget'><p>" + "Long text. " * 20 + "</p></div><article><p>" + "The article, whole. " * 20 + "</p></article>", "The article, whole. " * 20),
    ],
)
def test_pages_whose_boxes_have_unwanted_names(page, text):
    assert html_extract.main_text(page).removeprefix("Hi. ") == text.strip()


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "<p>" + "long, text. " * 50_000, None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract_pages(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and max(r.n_chars for r in rows) == 599_999
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_op5_is_the_article(spark):
    import html
    import re

    pages = {p.page_id: p.html for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op5_html_extraction(spark, SF).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inside))).split())


MESSAGES = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>, turns string"


def test_chat_parts(spark):
    part = lambda t, x=None, ref=None, n=None: (t, x, ref, n)
    rows = [
        (1, 1, "assistant", [part("text", "I see <|im_end|> \\ <\\| <")], "x"),
        (1, 0, "user", [part("text", "Look: "), part("image", None, "a.png", 64), part("document", None, "b.pdf", 3), part("text", " and"), part("audio", None, "c.wav"), part("hologram", "?")], "x"),
        (1, 2, "assistant", None, None),
        (None, None, None, [], None),
        (2, 0, "user\nodd", [part("text", None)], None),
    ]
    made = chat.format_conversations(spark.createDataFrame(rows, MESSAGES))
    by_id = {r.conv_id: r for r in made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = by_id[1]
    assert [tuple(t) for t in one.turns] == [("user", "Look: <|image|><|document|> and<|audio|>"), ("assistant", rows[0][3][0][1]), ("assistant", "")]
    assert one.loss == rows[0][3][0][1] and len(one.loss_spans) == 2
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(1, "image", "a.png", 64), (1, "document", "b.pdf", 768), (1, "audio", "c.wav", 1)]
    assert [tuple(t) for t in by_id[None].turns] == [("", "")] and [tuple(t) for t in by_id[2].turns] == [("user\nodd", "")]
    assert chat.format_conversations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_chat_escaping_is_reversible(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["<", "|", "\\", "n", "\n", "<|im_end|>", "<|im_start|>", "a", "😀"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("b"), chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r")).collect()
    assert all(r.a == r.t == r.b and "<|" not in r.e and "<|" not in r.r and "\n" not in r.r for r in out)


def test_pipeline_stages(spark):
    sf = SF
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "secrets", "mixing", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == first
        rows, old = docs.count(), before.count()
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            clean = {r.doc_id for r in before.collect() if toxicity.Matcher(model).score(r.text or "") < 0.5}
            assert {r.doc_id for r in docs.collect()} == clean
        elif name == "near_copies":
            assert {r.doc_id for r in docs.collect()} == {i for i, _, c in _plain_components([(r.doc_id, r.text) for r in before.collect()], 80) if i == c}
        elif name == "secrets":
            assert rows == old
        else:
            plan = mixing.mix_plan(before)
            assert rows == plan.agg(F.sum("copies")).first()[0]
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert encoded.count() == docs.count()


def test_a_name_is_no_part_of_a_paragraph_s_class():
    page = "<article><p>Kept, all.</p><p class='notice-text'>And this.</p><p class='promoted-by-all'>This too.</p><p class='notice'>no</p><div class='share-buttons'>no</div></article>"
    assert html_extract.main_text(page) == "Kept, all. And this. This too."


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    n = 60_000
    assert html_extract.main_text("<div>" * n + "<p>Deep, but here.</p>" + "</div>" * n) == "Deep, but here."
    assert html_extract.main_text("<p>" + "<span>" * n + "Deep, but here." + "</span>" * n) == "Deep, but here."
    assert time.perf_counter() - began < 30


def test_op6_sizes_and_targets_by_bisection(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    words = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    sources = sorted({d.source for d in docs}, key=lambda s: (s is None, s or ""))
    totals = {s: sum(words[d.doc_id] for d in docs if d.source == s) for s in sources}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 4.0 * sum(totals.values())  # words a unit of weight, such that the targets sum to 150 %
    for _ in range(200):
        each = (low + high) / 2
        low, high = (each, high) if sum(min(2 * totals[s], each * weights[s]) for s in sources) < 1.5 * sum(totals.values()) else (low, each)
    rows = queries.op6_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    own = {d.doc_id: d.source for d in docs}
    for r in rows:
        source = own[r.doc_id]
        assert (r.size, r.source_size) == (words[r.doc_id], totals[source]) and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(min(2 * totals[source], low * weights[source]), rel=1e-6)
    for s in sources:
        assert sum(r.taken for r in rows if own[r.doc_id] == s) == pytest.approx(min(2 * totals[s], low * weights[s]), rel=0.03, abs=50)


def test_op8_against_a_plain_matcher(spark):
    import math
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    spared = [toxicity.fold(p) for p in model.exceptions]
    lengths = sorted({len(t) for t in [*model.words, *model.beginnings]})

    def plain(text):
        folded = toxicity.fold(text)
        inside = lambda at: at < len(folded) and folded[at].isalnum()
        total = 0.0
        for at in range(len(folded)):
            if at and inside(at - 1):
                continue
            found = [model.beginnings[folded[at : at + n]] for n in lengths if folded[at : at + n] in model.beginnings]
            found += [model.words[folded[at : at + n]] for n in lengths if folded[at : at + n] in model.words and not inside(at + n)]
            phrases = [(k, k + len(p)) for p in spared for k in range(max(0, at - len(p)), at + 1) if folded.startswith(p, k) and not (k and inside(k - 1)) and not inside(k + len(p))]
            if found and not any(a <= at < b for a, b in phrases):
                total += max(found)
        weight = math.log1p(total)
        z = model.curve[0] + model.curve[1] * weight + (model.curve[2] * weight / math.log(3 + text.count(" ")) if weight else 0.0)
        return 1 / (1 + math.exp(-z))

    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert r.score == pytest.approx(plain(d.text or ""), rel=1e-9) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize(
    "around, kept",
    [
        ("<h1>A heading</h1>{}", "A heading {}"),
        ("{}<table><tr><td>one cell</td><td>of a table</td></tr></table>", "{} one cell of a table"),
        ("{}<p>A last word without a stop</p>", "{} A last word without a stop"),
        ("{}bare text beside it", "{} bare text beside it"),
        ("{}<ul><li>first point</li><li>second point</li></ul>", "{} first point second point"),
        ("{}<h2>Further pages</h2><ul><li><a href=x>one page</a></li><li><a href=y>another page</a></li></ul>", "{}"),
        ("{}<p>© 2024 Some Press. All rights reserved.</p>", "{}"),
    ],
)
def test_what_stands_beside_the_container(around, kept):
    words = "It was said, and written down, that the container holds most of the text, which is long enough to win. " * 4
    page = "<body>" + around.format(f"<div><p>{words}</p><p>{words}</p></div>") + "</body>"
    assert html_extract.main_text(page) == kept.format(f"{words.strip()} {words.strip()}")


def test_names_inside_of_an_article():
    words = "It was said, and written down, that an article keeps what is its own. " * 4
    parts = ['<section id="search-algorithms">Trees are searched.</section>', '<div class="related-work">Others did this.</div>', '<h2 class="share">A share of the whole</h2>', "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>"]
    gone = ['<div class="share-buttons">Share this</div>', '<div class="ad">Buy now</div>', '<ul class="social links"><li>Follow us</li></ul>', '<div class="comments-list">First!</div>']
    page = f"<body><article><p>{words}</p>{''.join(parts)}{''.join(gone)}</article></body>"
    assert html_extract.main_text(page) == f"{words.strip()} Trees are searched. Others did this. A share of the whole x=1"
    two = f"<body><article><p>First. {words}</p></article><nav>menu</nav><article><p>Second. {words}{words}</p></article><section class=comments><article><p>A reader says, at length, {words}</p></article></section></body>"
    assert html_extract.main_text(two) == f"First. {words.strip()} Second. {words}{words.strip()}"


def test_pages_of_many_open_tags_take_linear_time():
    began = time.perf_counter()
    n = 20_000
    assert html_extract.main_text("<b>" * n + "<p>x y.</p>" * n).startswith("x y. x y.")
    assert html_extract.main_text("<div>" * n + "<p>a" * n).startswith("a a")
    assert html_extract.main_text("<div><p>a, b" * n).startswith("a, b a, b")
    assert time.perf_counter() - began < 10
