"""Pages by address: redirects followed in rounds, each address guarded before it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.sources import tables

# fixed values: redirects followed, bytes of a page
REDIRECTS, MOST_BYTES = 5, 10 * 1024 * 1024

#: Address -> status, headers (lower-case names) and the body's pieces.
Client = Callable[[str], tuple[int, dict[str, str], Iterable[bytes]]]
#: Requests (request, url) -> request, url, status, location, content_type, body, problem; a lost one has no row.
Ask = Callable[[DataFrame], DataFrame]


def by_client(client: Client, most_bytes: int = MOST_BYTES) -> Ask:
    """Asks a client in the tasks; a body is read no further than one piece past ``most_bytes``."""

    def get(url: str) -> tuple[int | None, str | None, str | None, bytes | None, str | None]:
        try:
            status, headers, pieces = client(url)
            kind = headers.get("content-type")
            declared = headers.get("content-length", "")
            if 200 <= status < 300 and declared.isdigit() and int(declared) > most_bytes:
                return status, None, kind, None, "too large"
            body = bytearray()
            for piece in pieces if 200 <= status < 300 else ():
                body += piece
                if len(body) > most_bytes:
                    return status, None, kind, None, "too large"
            return status, headers.get("location"), kind, bytes(body), None
        except (OSError, TimeoutError) as failed:
            return None, None, None, None, f"unreachable: {failed}"

    def ask(requests: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, url in enumerate(batch.column(1).to_pylist()):  # a page a batch: bodies are large
                    status, location, kind, body, problem = get(url)
                    row = [batch.column(0).slice(i, 1), pa.array([url]), pa.array([status], pa.int32()), *(pa.array([x], pa.string()) for x in (location, kind)), pa.array([body], pa.binary()), pa.array([problem], pa.string())]
                    yield pa.RecordBatch.from_arrays(row, names=["request", "url", "status", "location", "content_type", "body", "problem"])

        return requests.mapInArrow(run, f"request {requests.schema['request'].dataType.simpleString()}, url string, status int, location string, content_type string, body binary, problem string")

    return ask


def from_archive(archive: DataFrame, most_bytes: int = MOST_BYTES) -> Ask:
    """Asks a table of recorded answers (url, status, location, content_type, body), one an address, by an equi join."""

    def ask(requests: DataFrame) -> DataFrame:
        large = F.coalesce(F.octet_length("body") > most_bytes, F.lit(False)) & F.col("status").between(200, 299)
        held = archive.select("url", "status", "location", "content_type", F.when(~large, F.col("body")).alias("body"), F.when(large, "too large").alias("problem"))
        return requests.join(held, "url").select("request", "url", "status", "location", "content_type", "body", "problem")

    return ask


def _resolved(base: pd.Series, location: pd.Series) -> pd.Series:
    def one(b: str, to: str) -> str | None:
        try:
            return urljoin(b, to)
        except ValueError:
            return None

    return pd.Series([one(b, to) if isinstance(to, str) else None for b, to in zip(base, location, strict=True)], dtype=object)


def fetch(pages: DataFrame, ask: Ask, id_col: str = "page_id", url_col: str = "url", redirects: int = REDIRECTS) -> DataFrame:
    """id, url, final_url, hops, content_type, body, error: each address fetched, or why it was not.

    In each of ``redirects`` + 1 rounds the addresses still open are asked for once, the
    answers written (a lost task asks again, a read does not), redirects resolved
    against the address they came from and guarded from scratch; fewer rounds run when
    none is left.  Errors: refused: and the guard's reason, unreachable, status and
    its number, no location, too large, redirects.  A null or malformed address is
    refused.  Repeated rows are fetched one by one and all returned; an empty table gives
    an empty one.  The body of a refused page is null.
    """
    resolved = F.pandas_udf(_resolved, "string")
    start = tables.written(pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("asked"), F.uuid().alias("row")).alias("request"), F.col(url_col).alias("url")))

    def guarded(rows: DataFrame) -> DataFrame:
        return rows.withColumn("error", F.when(F.col("url").isNull(), "refused: scheme").otherwise(F.concat(F.lit("refused: "), fn.refused_url("url"))))

    def done(rows: DataFrame, hops: int) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        kind, body = ("content_type", "body") if "body" in rows.columns else (none("string"), none("binary"))
        return rows.select("request", "url", F.lit(hops).alias("hops"), F.col(kind).alias("content_type") if isinstance(kind, str) else kind.alias("content_type"), F.col(body).alias("body") if isinstance(body, str) else body.alias("body"), "error")

    checked = guarded(start)
    finished = [done(checked.where("error IS NOT NULL"), 0)]
    pending = checked.where("error IS NULL").drop("error")
    for hop in range(redirects + 1):
        told = tables.written(pending.join(ask(pending).drop("url"), "request", "left"))
        moved = F.col("status").between(300, 399)
        ended = told.where(~F.coalesce(moved, F.lit(False)) | F.col("problem").isNotNull())
        error = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("status").isNull(), "unreachable").when(~F.col("status").between(200, 299), F.concat(F.lit("status "), "status"))
        ended = ended.withColumn("error", error).withColumn("body", F.when(F.col("error").isNull(), F.coalesce("body", F.lit(b""))))
        finished.append(done(ended, hop))
        onward = told.where(moved & F.col("problem").isNull())
        lost = F.col("location").isNull()
        finished.append(done(onward.where(lost).select("request", "url").withColumn("error", F.lit("no location")), hop))
        following = guarded(onward.where(~lost).select("request", resolved("url", "location").alias("url")))
        following = tables.written(following)
        finished.append(done(following.where("error IS NOT NULL"), hop + 1))
        pending = following.where("error IS NULL").drop("error")
        if pending.isEmpty():
            break
    else:
        finished.append(done(pending.withColumn("error", F.lit("redirects")), redirects + 1))
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("request.id").alias(id_col), F.col("request.asked").alias(url_col), F.when(F.col("error").isNull(), F.col("url")).alias("final_url"), "hops", "content_type", "body", "error")
