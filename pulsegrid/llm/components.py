"""Connected components of a table of edges, by contraction; nothing is collected but one count per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.storage import durable


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: for every node of ``edges`` (longs a, b; none of them null) one node of its component, the same for all of it.

    In each round every node points to the one of least hash among itself and its neighbours, with another hash in each round, and the
    graph is contracted along the pointers: stars are gone after two rounds, and a chain loses a fixed share of its nodes on average,
    however its ids are ordered. The pointers are then followed from the last round back to the first. Least values are aggregated
    before the shuffle, and joins are plain, so Spark can split a node with very many edges. Rounds are written to the shared folder.
    """
    pointers, now = [], edges.where("a <> b").select("a", "b")
    loops = edges.where("a = b").select("a").distinct()
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c) + F.lit(len(pointers) * 7919)).alias("h"), F.col(c).alias("id"))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["id"].alias("to"))
        least = durable(least, "pointers")
        pointers.append(least)
        to_a = now.join(least, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        contracted = to_a.join(least, F.col("b") == F.col("node")).select("a", F.col("to").alias("b")).where("a <> b")
        now = durable(contracted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "contracted")
        if now.isEmpty():
            break
    labels = pointers.pop()
    while pointers:
        later = labels.select(F.col("node").alias("to"), F.col("to").alias("label"))
        labels = pointers.pop().join(later, "to", "left").select("node", F.coalesce("label", "to").alias("to"))
    labels = labels.select("node", F.col("to").alias("label"))
    return labels.unionByName(loops.join(labels, loops["a"] == labels["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("label")))
