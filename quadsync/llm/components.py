"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.llm.shared import store


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (a, b) where b is the smallest node reachable from a, for
    every node that is not the smallest of its component.

    Each round hangs all larger neighbours of a node, then all smaller ones,
    below the smallest it knows; the rounds grow with the logarithm of the
    component's size.  Every round is written to the shared folder, the driver
    sees only a count and a checksum.
    """
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = store(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _state(e)
        if now == state:
            return e
        state = now
