"""Connected components of a link table, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, give_back


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links`` (``a``, ``b`` long): the smallest node it is connected with.

    Every round replaces a node's links by links to the smallest neighbour; the number of rounds grows with the
    logarithm of the diameter. Rounds are written to the shared folder; nothing is collected but a count and a
    checksum. Loops and repeated links are allowed; no links give no row.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    seen = None
    while True:
        # large star: every larger neighbour, and the node itself, link to the smallest of them all
        both = edges.select(F.col("x").alias("n"), F.col("y").alias("m")).unionByName(edges.select(F.col("y").alias("n"), F.col("x").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("x"), F.col("least").alias("y")).distinct()
        # small star: the smaller neighbours of a node, and the node, link to the smallest
        low = large.groupBy("x").agg(F.min("y").alias("least"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("least").alias("y")).where("x <> y").unionByName(low.select("x", F.col("least").alias("y"))).distinct()
        new = cut(small, "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        drop_table(edges)
        edges = new
        give_back(edges.sparkSession)
        if state == seen:
            break
        seen = state
    out = cut(edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()), "components")
    drop_table(edges)
    return out
