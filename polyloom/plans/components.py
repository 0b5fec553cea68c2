"""Connected components by alternating star operations; each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.plans.shared import materialize


def _least(edges: DataFrame) -> DataFrame:
    """a, b, m: the least b of each a. Aggregated before it is shuffled; the join back is one that can be split where a node has a great many neighbours."""
    m = edges.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m"))
    return edges.join(m, F.col("a") == F.col("__a")).select("a", "b", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are tied to the least node it sees."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return _least(both).where("b > a").select(F.least("m", "a").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours, and the node, are tied to the least of them."""
    tied = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return tied.where("b <> m").select(F.col("m").alias("a"), "b").union(tied.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (its least node) for each node of ``edges`` (a, b), both of one orderable type.

    Ends when a round changes nothing, after about the logarithm of the longest chain. Loops (a = b) count as nothing.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    stamp = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(stamp.alias("s")).first()["s"]
    for _ in range(rounds):
        now = materialize(_small(_large(now)), "star")
        after = now.agg(stamp.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
