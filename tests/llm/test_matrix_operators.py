"""Quality, filter audit and clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations, permutations
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import clustering, filter_audit, quality
from corpusmill.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, source string, n long"


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_clustering"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(wanted.select(*columns).fetchall())


# --- quality


def test_scores_of_held_out_rows_are_right(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in QUERIES["op11_quality"](spark, SF).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    truth = [(r["quality"], found[r["doc_id"]]) for r in labels.collect()]
    mine = [(q, r["predicted"]) for q, r in truth if r["held_out"]]
    assert {q for q, _ in mine} == {0, 1}
    assert sum(q == p for q, p in mine) >= 0.97 * len(mine)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, rounds=3) for x in (labels, turned))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.vectors == b.vectors).all()


def test_pairs_are_summed_by_the_identity():
    chance = np.random.RandomState(3)
    width = quality.entries(("n_chars",))
    machine = quality.Machine(0.1, chance.normal(0, 0.1, width), chance.normal(0, 0.1, (width, quality.RANK)), ("n_chars",))
    at, value = quality.Features(("n_chars",)).vector("Some words, some more words!! and | some", [40.0])
    z = machine.bias + sum(machine.weights[i] * x for i, x in zip(at, value, strict=True))
    z += sum(float(machine.vectors[i] @ machine.vectors[j]) * x * y for (i, x), (j, y) in combinations(list(zip(at, value, strict=True)), 2))
    assert machine.score(at, value) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    assert len(set(at.tolist())) == len(at)


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0, "x", 1), (1, 0, 0, "x", 1), (3, 1, 0, None, 2), (4, 0, 0, "y", 3), (5, None, None, None, None), (None, 0, 0, "z", 4), (7, 0, 1, "z", 4), (77, 0, 1, "z", 4)], LABELS)
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in by_id.values()) and by_id[1] == by_id[2]  # equal texts, equal scores
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert quality.score_documents(empty(spark), labels).count() == 0
    unlabelled = quality.score_documents(docs, labels.where("false")).collect()
    assert {round(r["score"], 1) for r in unlabelled} == {0.5}
    only_bad = quality.score_documents(docs, labels.where("quality = 0")).collect()
    assert all(r["score"] < 0.5 for r in only_bad)
    with pytest.raises(ValueError):
        quality.fit(docs, labels, metadata=("source",))
    with pytest.raises(ValueError):
        quality.score_rows(docs, quality.fit(docs, labels), "score")


# --- filter audit


def _audited(docs, labels):
    """Every order followed document by document."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least: dict[str, int] = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = [w.decode() for w in text.encode().split()]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        rows.append((source or "", i, fails))
    out = {}
    for part in {p for p, *_ in rows}:
        mine = [(i, f) for p, i, f in rows if p == part]
        removals: Counter = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                before = [x for x in mine if any(x[1][e] for e in order[: step - 1])]
                left = [x for x in left if not x[1][name]]
                removals[name] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f[name] for _, f in before), sum(f[name] and sum(f.values()) == 1 for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), found in out.items():
            if p == part:
                found.append(removals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _audit(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, source string, mask string, n long")
    told = spark.createDataFrame([(*x, "s", 1) for x in labels], LABELS)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(frame, told).collect()}


def test_audit_equals_orders_followed_one_by_one(spark):
    chance = random.Random(5)
    long = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", " \n\x0b ", "one two", "one two", long, long.upper(), long + " #", "a b " * 150, "Ä" * 40 + " Z", "x\u0085y " * 3, "\x1c", long + " and " + long, "#", "emoji \U0001f600 " * 90]
    docs = [(chance.choice([None, *range(30)]), chance.choice(texts), chance.choice([None, "", "a", "b", "ü"])) for _ in range(300)]
    docs += [(100 + k, "copied #", "hot") for k in range(40)] + [(50, "copied #", "cold")] * 2
    labels = [(chance.choice([None, *range(40), *range(100, 140)]), chance.choice([None, 0, 1]), chance.choice([None, 0, 1])) for _ in range(120)]
    found, wanted = _audit(spark, docs, labels), _audited(docs, labels)
    assert len(found) == 600 * 6 and found == wanted


def test_audit_of_odd_rows(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark).collect()]
    found, wanted = _audit(spark, rows, []), _audited(rows, [])
    assert found == wanted
    assert filter_audit.audit(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_matrices_are_whole_numbers_of_600_steps():
    for name, m in filter_audit.matrices().items():
        assert m.shape == (32, 600) and m.dtype == np.int64 and (m[0] == (name == "kept")).all(), name


# --- clustering


def _clustered(vectors, centroids, rounds):
    """Plain whole numbers, every distance computed."""
    rows = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    held = [v for _, v in order[:centroids]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), k) for k, c in enumerate(held))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in rows:
            groups[near(v)[1]].append(v)
        held = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else c for k, c in enumerate(held)]
    last = [(i, *near(v)) for i, v in rows]
    total = Counter()
    for _, d, k in last:
        total[k] += d
    fits = lambda n: n if n < 2**63 else None
    inertia = None if any(fits(d) is None for _, d, _ in last) else fits(sum(total.values()))
    lost = {k for _, d, k in last if fits(d) is None}
    return [(i, k, fits(d), None if k in lost else fits(total[k]), inertia, hashlib.sha256(",".join(map(str, held[k])).encode()).hexdigest()) for i, d, k in last]


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def _compare(spark, vectors, centroids=5, rounds=3, kind="float"):
    frame = spark.createDataFrame([(i, v, 1, "c") for i, v in vectors], f"vec_id long, embedding array<{kind}>, cluster int, distance string").repartition(3)
    found = clustering.cluster_vectors(frame, centroids=centroids, rounds=rounds).collect()
    exact = [(r["vec_id"], r["embedding"]) for r in frame.collect()]  # floats as stored
    assert sorted(map(tuple, found), key=_key) == sorted(_clustered(exact, centroids, rounds), key=_key)
    return found


def test_clusters_equal_those_of_plain_numbers(spark):
    chance = random.Random(1)
    vectors = [(i, [chance.gauss(0, 0.2) for _ in range(64)]) for i in range(400)]
    _compare(spark, vectors, centroids=40, rounds=5)


def test_ties_repeats_and_what_is_not_kept(spark):
    chance = random.Random(2)
    flat = [[float(chance.choice([0, 1])) / 256 if k < 3 else 0.0 for k in range(64)] for _ in range(60)]  # many equal distances
    vectors = [(i // 2, v) for i, v in enumerate(flat)]
    vectors += [(None, flat[0]), (None, flat[1]), (200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [None] + [0.0] * 63), (205, [math.nan] + [0.0] * 63), (206, [math.inf] + [0.0] * 63), (207, [-0.0] * 64)]
    found = _compare(spark, vectors, centroids=12)
    assert not {r["vec_id"] for r in found} & set(range(200, 207)) and 207 in {r["vec_id"] for r in found}
    _compare(spark, [(7, [0.5] * 64)] * 9, centroids=40)  # one vector many times: fewer places than centroids
    _compare(spark, [(1, [0.25] * 64)], centroids=40)


def test_distances_closer_than_float32_can_tell(spark):
    chance = random.Random(4)
    base = [chance.uniform(-400_000, 400_000) for _ in range(64)]
    vectors = [(i, [x + chance.choice([0, 1, 2]) / 256 for x in base]) for i in range(80)]
    _compare(spark, vectors, centroids=9, kind="double")
    many = np.floor(np.array([v for _, v in vectors]) * 256)
    held = clustering.Centroids([tuple(int(x) for x in row) for row in many[:9]])
    assert (held._overlapping(many).sum(axis=1) > 1).all()  # so the screening alone could not have told


def test_components_beyond_plain_numbers(spark):
    chance = random.Random(6)
    small = [(i, [chance.gauss(0, 3) for _ in range(64)]) for i in range(30)]
    large = [(100 + i, [chance.choice([1e7, -3e9, 2e37, 0.5]) * chance.random() for _ in range(64)]) for i in range(12)]
    found = _compare(spark, small + large, centroids=6, rounds=2)
    assert any(r["distance"] is None for r in found) and any(r["distance"] is not None for r in found)


def test_no_vectors_no_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster_vectors(frame).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.cluster_vectors(frame).count() == 0
    assert clustering.cluster_vectors(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0
