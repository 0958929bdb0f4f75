"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, hot_keys, lookup


def connected(links: DataFrame) -> DataFrame:
    """node, label for every end of ``links`` (a, b); label is the smallest node reachable.

    Each round takes the smallest label around and then the label of that label, so
    the rounds grow with the logarithm of the longest path.  A node with very many
    links and a label with very many nodes are dealt over several tasks.  Labels go to
    the shared checkpoint folder after each round; nothing but counts reaches the
    driver.  Repeated links and links of a node to itself change nothing; without
    links there are no rows.  Ends must not be null.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    start = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count("*").alias("rows")).withColumnRenamed("a", "node"))
    labels = start.select("node", "label")
    linked = hot_keys(start.withColumnRenamed("node", "b"), "b")
    nodes = start.count()
    if not nodes:
        return labels
    while True:
        around = lookup(both, labels.withColumnRenamed("node", "b"), "b", linked, "a").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nearer = cut(nearer)
        held = nearer.groupBy("label").agg(F.count("*").alias("rows"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lookup(nearer, jump, "label", hot_keys(held, "label", total=nodes), "node", "left")
        moved = cut(moved.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("node", "label")
        if not moved.where("old <> label").limit(1).count():
            return labels
