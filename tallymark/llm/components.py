"""Distributed union-find: connected components by alternating large-star and small-star rounds.

Each round is two aggregations with partial minima and two joins on node ids; a node's neighbours are never
collected in one place.  Rounds are cut by tables in the shared folder, and only a count and
a checksum of the edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def _min_over(edges: DataFrame, keep) -> DataFrame:
    """(u, v, m): every edge with the least of u and its neighbours."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "m").alias("m")).where(keep)


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _min_over(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _min_over(large.where("u > v"), F.lit(True))
    out = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b); loops and repeated edges do no harm.

    The result reads a table of scratch; tables of earlier rounds are deleted.
    """
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state = scratch.cut(state, "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(state)
    while before[0]:
        last, state = state, scratch.cut(_star(state), "edges")
        scratch.drop(last)
        now = mark(state)
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
