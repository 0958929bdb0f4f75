"""Centroid clustering of vectors with exact integer results.

Components become integers, so that distances and means have one right answer.  A
round screens every vector with a float32 matrix product: for 64 products the
rounding error of a dot product is at most gamma * |x| * |c| whatever the order of
summation, so each distance lies in a known interval.  Centroids whose interval
overlaps the lowest one are settled with exact integers; of equal ones the lowest
number wins.  Only sums and counts of the centroids leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import batches_of, fresh_folder, require

#: The values of the query: components, centroids, rounds, scale and seed.
WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Integers up to this size have squared distances (of WIDTH components) that a long holds.
PLAIN = 2**27
#: Pairs of vector and centroid whose distance is computed at once.
PAIRS = 8192
#: Rows of a matrix product.
ROWS = 4096
_LIMB = 40


def _integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors to keep, and floor(scale * component) of those, as whole doubles."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, width) * scale)  # nulls become nan
    good = np.isfinite(found).all(axis=1)
    return at[good], found[good]


def _packed(vectors: np.ndarray) -> pa.Array:
    """Each vector in 4 bytes a component if it is plain, else in 8."""
    plain = np.abs(vectors).max(axis=1, initial=0) <= PLAIN
    if plain.all():
        size = 4 * vectors.shape[1]
        offsets = np.arange(len(vectors) + 1, dtype="<i4") * size
        return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(vectors.astype("<i4").tobytes())])
    return pa.array([v.astype("<i4").tobytes() if p else v.astype("<f8").tobytes() for v, p in zip(vectors, plain, strict=True)], pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    if column.null_count == 0 and pc.all(pc.equal(pc.binary_length(column), 4 * width)).as_py():
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype("f8")
    return np.array([np.frombuffer(b, "<i4" if len(b) == 4 * width else "<f8") for b in column.to_pylist()], "f8").reshape(-1, width)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """id and packed integer components of the vectors with ``width`` components, none null or not finite.

    Null vectors, those of another length and those whose scaled component is not
    finite go; ids may be null or repeat, each row counts.
    """
    require(vectors, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, ROWS):
            at, found = _integers(batch.column(1), width, scale)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _packed(found)], names=[id_col, "packed"])

    return vectors.select(id_col, vector_col).mapInArrow(run, T.StructType([vectors.schema[id_col], T.StructField("packed", T.BinaryType())]))


class Centroids:
    """Centroids as exact integers, with what the screening needs of them."""

    def __init__(self, rows: list[tuple[int, ...]]):
        self.exact = rows
        self.width = len(rows[0])
        self.plain = np.array([max(map(abs, r)) <= PLAIN for r in rows])
        self.int64 = np.array([r if p else (0,) * self.width for r, p in zip(rows, self.plain, strict=True)], np.int64)
        self.doubles = np.array([[float(v) for v in r] for r in rows])

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of every row; of equally near ones the lowest."""
        cluster = np.zeros(len(vectors), np.int64)
        row, centroid = np.nonzero(self._overlapping(vectors))
        once = np.bincount(row, minlength=len(vectors)) == 1
        sure = once[row]
        cluster[row[sure]] = centroid[sure]
        best: dict[int, tuple[int, int]] = {}
        row, centroid = row[~sure], centroid[~sure]
        for r, c, d in zip(row.tolist(), centroid.tolist(), self.distances(vectors, row, centroid), strict=True):
            if r not in best or (d, c) < best[r]:
                best[r] = (d, c)
        for r, (_, c) in best.items():
            cluster[r] = c
        return cluster

    def _overlapping(self, vectors: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest of each row: their interval meets the one with the lowest upper end.

        Rows and centroids are scaled by a power of two, which rounds nothing, so that
        float32 holds their products; what it cannot hold for smallness enters the bound.
        """
        largest = max(np.abs(vectors).max(initial=1.0), np.abs(self.doubles).max(initial=1.0))
        scale = 2.0 ** min(0, 30 - int(np.ceil(np.log2(largest))))
        x, c = vectors * scale, self.doubles * scale
        k = self.width + 6  # products, sums, and the rounding of both sides to float32
        unit = 2.0**-24
        gamma = k * unit / (1 - k * unit)
        size_x, size_c = np.sqrt((x * x).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        dots = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        middle = size_c * size_c - 2 * dots  # the distance but for |x|^2, which all centroids share
        error = 2.0 * gamma * np.outer(size_x, size_c) * 1.001 + (size_c * size_c + 2 * np.abs(dots)) * 2.0**-44 + self.width * 2.0**-100
        return middle - error <= (middle + error).min(axis=1, keepdims=True)

    def distances(self, vectors: np.ndarray, row: np.ndarray, centroid: np.ndarray) -> list[int]:
        """Exact squared distances of pairs of a row and a centroid."""
        out: list[int] = []
        plain = np.abs(vectors).max(axis=1, initial=0) <= PLAIN
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], centroid[at : at + PAIRS]
            if plain[r].all() and self.plain[c].all():
                apart = vectors[r].astype(np.int64) - self.int64[c]
                out += np.einsum("ij,ij->i", apart, apart).tolist()
            else:
                out += [sum((int(a) - b) ** 2 for a, b in zip(vectors[i], self.exact[j], strict=True)) for i, j in zip(r.tolist(), c.tolist(), strict=True)]
        return out


def _sums(cluster: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """cluster, place, total: the count (place -1) and the exact component sums of each cluster that has rows."""
    for c in np.unique(cluster).tolist():
        mine = vectors[cluster == c]
        yield c, -1, len(mine)
        if np.abs(mine).max(initial=0) <= PLAIN:
            yield from ((c, k, s) for k, s in enumerate(mine.astype(np.int64).sum(axis=0).tolist()))
        else:
            yield from ((c, k, sum(map(int, mine[:, k]))) for k in range(mine.shape[1]))


def _first_centroids(kept: DataFrame, id_col: str, centroids: int, seed: str, width: int) -> list[tuple[int, ...]]:
    """The vectors whose id, after the seed, hashes lowest; null ids hash as an empty text, of equal ids the smaller packed form comes first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = kept.select(hashed.alias("hashed"), "packed").orderBy("hashed", "packed").limit(centroids).collect()  # as many as there are centroids
    return [tuple(int(v) for v in np.frombuffer(r["packed"], "<i4" if len(r["packed"]) == 4 * width else "<f8")) for r in chosen]


def _moved(kept: DataFrame, id_col: str, held: list[tuple[int, ...]], width: int) -> list[tuple[int, ...]]:
    """The centroids after one round: exact floors of the means; empty ones stay."""
    told = kept.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(told.value)
        totals: dict[tuple[int, int], int] = {}
        for batch in batches_of(batches, ROWS):
            vectors = _unpacked(batch.column(0), width)
            for c, k, total in _sums(centroids.nearest(vectors), vectors):
                totals[c, k] = totals.get((c, k), 0) + total
        if totals:
            rows = [(c, k, limb, part) for (c, k), total in totals.items() for limb, part in enumerate(_limbs(total))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cluster", "place", "limb", "amount"])

    parts = kept.select("packed").mapInArrow(run, "cluster int, place int, limb int, amount long")
    found = parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()  # a few numbers a component of a centroid
    sums: dict[tuple[int, int], int] = {}
    for r in found:
        sums[r["cluster"], r["place"]] = sums.get((r["cluster"], r["place"]), 0) + (int(r["amount"]) << (_LIMB * r["limb"]))
    return [tuple(sums.get((c, k), 0) // sums[c, -1] for k in range(width)) if (c, -1) in sums else old for c, old in enumerate(held)]


def _limbs(total: int) -> list[int]:
    """A whole number as the sum of parts times powers of 2**40, each of which a long holds."""
    out = []
    while not -(2**62) < total < 2**62:
        out.append(total & (2**_LIMB - 1))
        total >>= _LIMB
    return [*out, total]


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept.

    The first centroids are the vectors whose seeded id hashes lowest (fewer if there
    are fewer vectors); each round assigns every vector to the nearest and moves each
    centroid to the floor of its mean.  Ties go to the lowest number, equal centroids
    stay as they are, empty ones too.  Rows of one id each count.  Without vectors to
    keep there are no rows.  A distance, or a sum of them, beyond a long is null; the
    cluster is right all the same.

    The vectors are written once to the shared folder as packed integers and read from
    there; a round hands on sums only, so tasks and memory do not depend on how the
    vectors lie, and one cluster may hold all of them.
    """
    spark = vectors.sparkSession
    folder = fresh_folder(spark, "clustering")
    kept_vectors(vectors, id_col, vector_col, width, scale).write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    held = _first_centroids(kept, id_col, centroids, seed, width)
    out = T.StructType([vectors.schema[id_col], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    ends = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not held:
        return spark.createDataFrame([], T.StructType([*out.fields, *ends.fields[1:]]))
    for _ in range(rounds):
        held = _moved(kept, id_col, held, width)
    told = spark.sparkContext.broadcast(held)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Centroids(told.value)
        for batch in batches_of(batches, ROWS):
            rows = _unpacked(batch.column(1), width)
            cluster = found.nearest(rows)
            distance = [d if d < 2**63 else None for d in found.distances(rows, np.arange(len(rows)), cluster)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=out.names)

    kept.mapInArrow(assign, out).write.parquet(f"{folder}/assigned")
    assigned = spark.read.schema(out).parquet(f"{folder}/assigned")
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()  # a row a centroid
    known = {r["cluster"]: None if r["unknown"] else int(r["total"]) for r in each}
    whole = None if None in known.values() else sum(known.values())
    fits = lambda n: n if n is not None and n < 2**63 else None
    rows = [(c, fits(n), fits(whole), hashlib.sha256(",".join(map(str, held[c])).encode()).hexdigest()) for c, n in known.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, ends)), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(table: str = "embeddings", width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same in DuckDB's SQL, every distance to every centroid computed."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS xs FROM {table} WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), xs) - 1 AS k, xs FROM v QUALIFY k < {centroids})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT rid, vec_id, v.xs, k, list_sum([(v.xs[i] - c.xs[i]) * (v.xs[i] - c.xs[i]) FOR i IN range(1, {width + 1})])::BIGINT AS d FROM v, c{n} c)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(xs) AS xs, min(d) AS d, arg_min(k, (d, k)) AS k FROM d{n} GROUP BY rid)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(xs) AS x, unnest(range(1, {width + 1})) AS i FROM a{n}) GROUP BY k, i)")
            steps.append(f"e{n} AS (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS xs FROM m{n} GROUP BY k)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(e.xs, c.xs) AS xs FROM c{n} c LEFT JOIN e{n} e ON c.k = e.k)")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.xs, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"
    )
