"""Calls to embedders and models from Spark tasks, through injected clients.

A client is a picklable callable.  Calls are batched, answers are put back in the
order of their questions, and what fails for good becomes a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.vectors import hash_vectors
from corpusmill.operators.fusion import placed
from corpusmill.sources import tables

#: Texts in a call, tries of a model before the next.
BATCH, TRIES = 64, 2


def hashing_client(texts: list[str]) -> list[tuple[int, list[float]]]:
    """The offline embedder as a service: answers carry their index and come in any order."""
    return list(enumerate(hash_vectors(texts, 64).tolist()))[::-1]


def narrow_client(texts: list[str]) -> list[tuple[int, list[float]]]:
    """Another offline embedder, of half the width."""
    return list(enumerate(hash_vectors(texts, 32).tolist()))


def _answered(texts: list[str], client: Callable[[list[str]], list[tuple[int, list[float]]]], width: int) -> pa.Array:
    """The client's vectors in the order of the texts."""
    found = sorted(client(texts))
    if [i for i, _ in found] != list(range(len(texts))) or any(len(v) != width for _, v in found):
        raise ValueError("the embedder's answer does not fit the texts")
    return pa.array([v for _, v in found], pa.list_(pa.float32()))


def embed(df: DataFrame, id_col: str, text_col: str, client: Callable[[list[str]], list[tuple[int, list[float]]]] = hashing_client, width: int = 64) -> DataFrame:
    """id, embedding of every row; a client that answers with another number or width fails the task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([batch.column(0), _answered([t or "" for t in batch.column(1).to_pylist()], client, width)], names=[id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


def embed_new(chunks: DataFrame, client: Callable[[list[str]], list[tuple[int, list[float]]]], width: int, cache: DataFrame | None = None, keys: tuple[str, ...] = ("content_hash",), batch: int = BATCH) -> DataFrame:
    """keys, embedding, tokens, reused, batch: a vector for every distinct content of ``chunks``, asked for only if ``cache`` has none.

    ``chunks`` has the keys, content and token_count; ``cache`` the keys and embedding,
    of which one without a null or of another width counts as absent.  Keys besides the
    hash, such as a base and its model, part what may not share vectors.  What is new is
    numbered over the whole corpus in the order of its keys, so that every call but the
    last has ``batch`` texts however the rows lie; ``batch`` is null for what is reused.
    A content's tokens are to be paid for where it is not reused.  No client is called
    if nothing is new.
    """
    names = list(keys)
    once = chunks.groupBy(*names).agg(F.min("content").alias("content"), F.min("token_count").cast("long").alias("tokens"))
    known = F.lit(None).cast("array<float>")
    if cache is not None:
        held = cache.where((F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull())).groupBy(*names).agg(F.min(F.col("embedding").cast("array<float>")).alias("_known"))
        once, known = once.join(held, names, "left"), F.col("_known")
    once = tables.written(once.select(*names, "content", "tokens", known.alias("embedding")))
    told = once.where("embedding IS NOT NULL").select(*names, "embedding", "tokens", F.lit(True).alias("reused"), F.lit(None).cast("long").alias("batch"))
    fresh = placed(once.where("embedding IS NULL").drop("embedding"), names, "place").withColumn("batch", F.floor((F.col("place") - 1) / F.lit(batch)))

    def call_one(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        vectors = _answered([t or "" for t in group.column("content").to_pylist()], client, width)
        return pa.table({**{n: group.column(n) for n in (*names, "tokens", "batch")}, "embedding": vectors})

    kinds = ", ".join(f"{n} {once.schema[n].dataType.simpleString()}" for n in names)
    answered = fresh.groupBy("batch").applyInArrow(call_one, f"{kinds}, tokens long, batch long, embedding array<float>")
    return told.unionByName(answered.withColumn("reused", F.lit(False)))


def echo_client(model: str, prompt: str) -> str:
    """The offline model; models whose name ends in ``!`` are out of order."""
    if model.endswith("!"):
        raise ConnectionError(f"{model} does not answer")
    return f"{model}: {prompt[:40]}"


def call(requests: DataFrame, id_col: str, client: Callable[[str, str], str] = echo_client, tries: int = TRIES) -> DataFrame:
    """id, model, answer, attempts, error: each request (models, prompt) goes to its models in turn.

    A model that fails with ConnectionError or TimeoutError is tried ``tries`` times and
    then the next one; a ValueError is the request's own fault and ends it.
    """
    kind = requests.schema[id_col].dataType.simpleString()

    def one(models: list[str], prompt: str) -> tuple[str | None, str | None, int, str | None]:
        attempts, error = 0, "no model"
        for model in models:
            for _ in range(tries):
                attempts += 1
                try:
                    return model, client(model, prompt), attempts, None
                except (ConnectionError, TimeoutError) as failed:
                    error = str(failed)
                except ValueError as refused:
                    return model, None, attempts, str(refused)
        return None, None, attempts, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m or [], p or "") for m, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, "model", "answer", "attempts", "error"])

    return requests.select(id_col, "models", "prompt").mapInArrow(run, f"{id_col} {kind}, model string, answer string, attempts int, error string")
