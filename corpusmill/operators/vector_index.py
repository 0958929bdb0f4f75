"""A graph index of vectors: approximate search with exact scores.

The corpus is dealt to shards of bounded size.  A task turns a shard into one row:
its vectors and a graph in which every vector links to near ones in different
directions, to those that link to it, and a spread of entries from which walks
begin.  A block of questions walks all of a shard's graph at once, keeping the best
so far; what it ends with is scored anew in double precision.  How many a walk keeps is
measured while the shard is built, so that recall holds where vectors have no lumps
to follow.  Tasks and memory follow the shard, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.fusion import ranked
from corpusmill.sources import tables

#: Vectors of a shard, links of a vector each way, candidates looked at for them, fewest vectors kept on a walk.
SHARD, LINKS, CANDIDATES, BEAM = 16_384, 16, 48, 96
#: Questions that walk together, and rows of a matrix product while a graph is built.
QUESTIONS, ROWS = 256, 1024
#: Vectors that a question opens at a time.
OPENED = 8
#: Vectors of a shard that are asked for while it is built, their nearest that are looked for, the share of these to be found.
PROBES, NEAREST, ENOUGH = 256, 30, 0.95


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def links_of(vectors: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> np.ndarray:
    """A row of links for every unit vector, -1 where there are fewer.

    Of a vector's nearest ``candidates``, one becomes a link if it is nearer to the
    vector than to every link chosen before it, so links point in different
    directions; what is left fills up.  Then every link is made to lead back too.
    """
    n = len(vectors)
    near = min(candidates, n - 1)
    chosen = np.full((n, 2 * links), -1, np.int32)
    if near < 1:
        return chosen
    for start in range(0, n, ROWS):
        rows = np.arange(start, min(n, start + ROWS))
        scores = vectors[rows] @ vectors.T
        scores[np.arange(len(rows)), rows] = -np.inf
        found = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        found = np.take_along_axis(found, np.argsort(-np.take_along_axis(scores, found, 1), axis=1, kind="stable"), 1)
        to_self = np.take_along_axis(scores, found, 1)
        picked = np.zeros((len(rows), near), bool)
        nearest_link = np.full((len(rows), near), -np.inf, vectors.dtype)  # of each candidate, to the links so far
        for k in range(near):
            fits = (to_self[:, k] > nearest_link[:, k]) & (picked.sum(axis=1) < links)
            picked[:, k] = fits
            likeness = np.einsum("rcd,rd->rc", vectors[found], vectors[found[:, k]])
            nearest_link = np.where(fits[:, None], np.maximum(nearest_link, likeness), nearest_link)
        order = np.argsort(~picked, axis=1, kind="stable")[:, :links]  # links by direction first, then the nearest
        chosen[rows, : order.shape[1]] = np.take_along_axis(found, order, 1)
    return _both_ways(chosen, links)


def _both_ways(chosen: np.ndarray, links: int) -> np.ndarray:
    """Links that lead back are added, as many as there is room for, those of the first choices first."""
    n = len(chosen)
    source, rank = np.nonzero(chosen[:, :links] >= 0)
    target = chosen[source, rank]
    order = np.lexsort((rank, target))
    source, target = source[order], target[order]
    begins = np.searchsorted(target, np.arange(n + 1))
    for v in range(n):
        back = source[begins[v] : begins[v + 1]]
        back = back[~np.isin(back, chosen[v])][:links]
        chosen[v, links : links + len(back)] = back
    return chosen


def entries_of(vectors: np.ndarray) -> np.ndarray:
    """Places where walks begin, about twice the square root of all: some evenly spread, and then
    again and again the vector that is farthest from all chosen, so that no lump of vectors is without one."""
    n = len(vectors)
    several = int(np.ceil(np.sqrt(n)))
    chosen = list(dict.fromkeys(np.linspace(0, n - 1, num=several, dtype=int).tolist()))
    nearest = (vectors @ vectors[chosen].T).max(axis=1)
    for _ in range(min(several, n - len(chosen))):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return np.unique(np.array(chosen, np.int32))


def walk(questions: np.ndarray, vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, beam: int = BEAM, without: np.ndarray | None = None) -> np.ndarray:
    """Places of the ``beam`` best vectors found for every question, best first; -1 where there are fewer.

    All questions walk together: each opens its best vectors not opened yet, a few at a
    time, and the vectors that they link to compete for the places kept.  A walk ends
    when all that it keeps have been opened.  ``without`` is a place for each question
    that its walk passes over, as if the shard did not have it.
    """
    q, n = len(questions), len(vectors)
    beam = min(beam, n)
    width = min(OPENED, beam)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the place of absent links
    seen[:, entries] = True
    scores = questions @ vectors[entries].T
    if without is not None:
        seen[np.arange(q), without] = True
        scores[entries == without[:, None]] = -np.inf
    kept = np.argsort(-scores, axis=1, kind="stable")[:, :beam]
    places = np.full((q, beam), n, np.int64)
    held = np.full((q, beam), -np.inf, vectors.dtype)
    places[:, : kept.shape[1]] = entries[kept]
    held[:, : kept.shape[1]] = np.take_along_axis(scores, kept, 1)
    opened = ~np.isfinite(held)
    going = np.arange(q)
    while len(going):
        ready = np.where(opened[going], -np.inf, held[going])
        best = np.argpartition(-ready, width - 1, axis=1)[:, :width]
        worth = np.take_along_axis(ready, best, 1) > -np.inf
        alive = worth.any(axis=1)
        going, best, worth = going[alive], best[alive], worth[alive]
        if not len(going):
            break
        opened[going[:, None], best] = True
        out = np.where(worth[:, :, None], links[np.minimum(places[going[:, None], best], n - 1)], -1).reshape(len(going), -1).astype(np.int64)
        out[out < 0] = n
        out.sort(axis=1)
        fresh = ~seen[going[:, None], out]
        fresh[:, 1:] &= out[:, 1:] != out[:, :-1]  # several may link to one
        seen[going[:, None], out] = True
        row, column = np.nonzero(fresh)
        found = np.full(out.shape, -np.inf, vectors.dtype)
        found[row, column] = np.einsum("ij,ij->i", vectors[out[row, column]], questions[going[row]])
        all_places, all_scores = np.concatenate([places[going], np.where(fresh, out, n)], 1), np.concatenate([held[going], found], 1)
        all_opened = np.concatenate([opened[going], ~fresh], 1)
        top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        places[going], held[going], opened[going] = (np.take_along_axis(x, top, 1) for x in (all_places, all_scores, all_opened))
    order = np.argsort(-held, axis=1, kind="stable")
    places, held = np.take_along_axis(places, order, 1), np.take_along_axis(held, order, 1)
    return np.where(np.isfinite(held), places, -1)


def beam_of(vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, least: int = BEAM) -> int:
    """How many vectors a walk must keep: ``least``, doubled until probes find ``ENOUGH`` of their nearest.

    Probes are at most ``PROBES`` of the vectors, evenly spread; each walks the graph
    without itself, as a question from elsewhere does, and is compared with all vectors.
    """
    n = len(vectors)
    nearest = min(NEAREST, n - 1)
    beam = least
    if nearest < 1 or beam >= n:
        return beam
    probes = np.unique(np.linspace(0, n - 1, num=min(PROBES, n), dtype=int))
    scores = vectors[probes] @ vectors.T
    scores[np.arange(len(probes)), probes] = -np.inf
    last = -np.partition(-scores, nearest - 1, axis=1)[:, nearest - 1]
    while beam < n:
        places = walk(vectors[probes], vectors, links, entries, beam, probes)[:, :nearest]
        found = np.take_along_axis(scores, np.maximum(places, 0), 1)
        if ((places >= 0) & (found >= last[:, None] - 1e-6)).mean() >= ENOUGH:  # of equals any counts
            break
        beam *= 2
    return min(beam, n)


def index_vectors(corpus: DataFrame, shard: int = SHARD, links: int = LINKS, candidates: int = CANDIDATES) -> DataFrame:
    """shard, width, ids, vectors, links, entries, beam: the index of ``corpus`` (chunk_id, embedding), written once to the shared folder.

    Every row is indexed.  Vectors of one width are dealt over shards of about
    ``shard`` by a hash of their id; null and empty vectors have the width 0 and no
    graph.  One task holds one shard.
    """
    counts = {r["width"]: r["n"] for r in _wide(corpus).groupBy("width").agg(F.count("*").alias("n")).collect()}  # a row a width
    kind = corpus.schema["chunk_id"].dataType.simpleString()
    shards = F.lit(1)
    for width, n in counts.items():
        shards = F.when(F.col("width") == width, F.lit(-(-n // shard))).otherwise(shards)
    dealt = _wide(corpus).withColumn("shard", F.pmod(F.xxhash64("chunk_id", F.lit(3)), shards))

    def build(group: pa.Table) -> pa.Table:
        width = group.column("width")[0].as_py()
        group = group.sort_by("chunk_id")
        vectors = np.array(group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), "<f4").reshape(group.num_rows, width) if width else np.zeros((group.num_rows, 0), "<f4")
        unit = _unit(vectors)
        graph, entries = (links_of(unit, links, candidates), entries_of(unit)) if width else (np.empty(0), np.empty(0))
        beam = beam_of(unit, graph, entries) if width else BEAM
        ids = pa.array([group.column("chunk_id").to_pylist()], pa.list_(group.schema.field("chunk_id").type))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "width": pa.array([width], pa.int32()), "ids": ids, "vectors": pa.array([vectors.tobytes()], pa.binary()), "links": pa.array([graph.astype("<i4").tobytes()], pa.binary()), "entries": pa.array([entries.astype("<i4").tobytes()], pa.binary()), "beam": pa.array([beam], pa.int32())})

    built = dealt.groupBy("shard", "width").applyInArrow(build, f"shard long, width int, ids array<{kind}>, vectors binary, links binary, entries binary, beam int")
    return tables.written(built)


def _wide(corpus: DataFrame) -> DataFrame:
    return corpus.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).alias("width"))


def search_index(queries: DataFrame, index: DataFrame, most: int, digits: int | None = None, beam: int = 0) -> DataFrame:
    """query_id, chunk_id, score, rank of the ``most`` nearest chunks that walks of the index find.

    ``queries`` has query_id and embedding.  Scores are exact cosines of the vectors as
    floats; a question without direction, or of a width that the index has not, finds
    nothing.  Blocks of questions meet the shards of their width in an equi join, and
    a pair of them hands on its best ``most`` per question.  A shard is walked with the
    beam it was built with; a larger ``beam`` looks longer and misses less.
    """
    qk = queries.schema["query_id"].dataType.simpleString()
    ck = index.schema["ids"].dataType.elementType.simpleString()
    wide = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") > 0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUESTIONS):
                batch = whole.slice(at, QUESTIONS)
                by_width: dict[int, list[int]] = {}
                vectors = batch.column(1).to_pylist()
                for i, v in enumerate(vectors):
                    by_width.setdefault(len(v), []).append(i)
                for width, some in by_width.items():
                    matrix = np.array([vectors[i] for i in some], "<f4")
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([batch.column(0).take(pa.array(some)).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([matrix.tobytes()], pa.binary())], names=["width", "q_ids", "q"])

    asked = wide.mapInArrow(gather, f"width int, q_ids array<{qk}>, q binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a shard and a block of questions at a time
                width, q_ids, q, ids, vectors, links, entries, own = (batch.column(c)[k].as_py() for c in range(8))
                held, asked_for = np.frombuffer(vectors, "<f4").reshape(-1, width), np.frombuffer(q, "<f4").reshape(-1, width)
                places = walk(_unit(asked_for), _unit(held), np.frombuffer(links, "<i4").reshape(len(held), -1), np.frombuffer(entries, "<i4"), max(beam, own, most))
                row, column = np.nonzero(places >= 0)
                place = places[row, column]
                scores = np.einsum("ij,ij->i", _unit(asked_for.astype("f8"))[row], _unit(held.astype("f8"))[place])
                scores = np.round(scores, digits) if digits is not None else scores
                walked = np.linalg.norm(asked_for, axis=1)[row] > 0
                order = np.lexsort((place, -scores, row))  # ids lie in order of place
                order = order[walked[order]]
                first = np.searchsorted(row[order], row[order])
                order = order[np.arange(len(order)) - first < most]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids).take(pa.array(row[order])), pa.array(ids).take(pa.array(place[order])), pa.array(scores[order])], names=["query_id", "chunk_id", "score"])

    pairs = asked.join(index, "width").select("width", "q_ids", "q", "ids", "vectors", "links", "entries", "beam")
    return ranked(pairs.mapInArrow(search, f"query_id {qk}, chunk_id {ck}, score double"), most=most)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found: how many of the exact hits the index found too."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("_hit").alias("found"))
