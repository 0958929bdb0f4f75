"""Objects by key in a shared folder: put, get, delete, and delete by prefix, each for whole tables of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.commits import Commits, either


def object_key(tenant: Column, base: Column, document: Column, version: Column, part: str = "original") -> Column:
    """Where a document's version lies: tenant/base/document/v1/original."""
    return F.concat_ws("/", F.lit("tenant"), tenant, base, document, F.concat(F.lit("v"), version), F.lit(part))


class ObjectStore:
    """Objects (key, content, content_type) under ``path``; of several writes of a key the newest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.commits = Commits(spark, path)

    def put(self, objects: DataFrame, transaction: str | None = None) -> int | None:
        """Write objects; all of them become visible at once.  Null keys are refused."""
        rows = objects.select(F.when(F.col("key").isNull(), F.raise_error(F.lit("an object needs a key"))).otherwise(F.col("key")).alias("key"), F.col("content").cast("binary").alias("content"), F.col("content_type").cast("string").alias("content_type"))
        return self.commits.add("put", {"objects": rows}, transaction)

    def delete(self, keys: DataFrame, transaction: str | None = None) -> int | None:
        return self.commits.add("delete", {"deleted": keys.select("key").distinct()}, transaction)

    def delete_prefix(self, prefix: str) -> int | None:
        """Delete every object whose key begins so; a prefix without text is refused."""
        if not prefix:
            raise ValueError("an empty prefix would delete everything")
        return self.commits.add("delete_prefix", {}, note=prefix)

    def listed(self) -> DataFrame | None:
        """key, size, content_type and _commit of every object there is."""
        rows = self.commits.rows("objects")
        if rows is None:
            return None
        sized = rows.select("key", F.octet_length("content").cast("long").alias("size"), "content_type", "_commit", "_number")
        newest = sized.groupBy("key").agg(F.max_by(F.struct("size", "content_type", "_commit"), "_number").alias("o"), F.max("_number").alias("_number"))
        deleted = self.commits.rows("deleted")
        if deleted is not None:
            last = deleted.groupBy("key").agg(F.max("_number").alias("_deleted"))
            newest = newest.join(last, "key", "left").where("_deleted IS NULL OR _deleted < _number")
        prefixes = [(c.note, c.number) for c in self.commits.entries() if c.kind == "delete_prefix"]
        newest = newest.where(~either([F.startswith("key", F.lit(p)) & (F.col("_number") < n) for p, n in prefixes]))
        return newest.select("key", "o.*")

    def get(self, keys: DataFrame) -> DataFrame | None:
        """key, content, content_type of the objects asked for; keys without an object give no row."""
        listed = self.listed()
        if listed is None:
            return None
        wanted = listed.join(keys.select("key").distinct(), "key", "left_semi").select("key", "_commit")
        return self.commits.rows("objects").join(wanted, ["key", "_commit"]).dropDuplicates(["key"]).select("key", "content", "content_type")

    def exists(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``exists``."""
        listed = self.listed()
        if listed is None:
            return keys.withColumn("exists", F.lit(False))
        return keys.join(listed.select("key", F.lit(True).alias("exists")), "key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
