"""Members of large groups brought together block by block, so that no group has to fit into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch
from .textkit import chunks

#: Bytes of the members of a block and of a task.
BLOCK_BYTES, TASK_BYTES = 1 << 18, 8 << 20


def blocks_of_mixed(members: DataFrame, n_parts: int, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Rows (key, h, c, block, i, j) of every two blocks of each group, and a number of partitions for them.

    members holds (key, h, c, cost): group, member, component and bytes.  Only groups that touch several components are kept.  A
    member's block follows from a hash, so only sums by group are aggregated; blocks i <= j meet under (key, i, j).
    """
    mixed = members.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.sum("cost").alias("total")).where("least <> most")
    mixed = mixed.select(F.col("key").alias("mixed"), F.greatest(F.lit(1), F.ceil(F.col("total") / block_bytes)).cast("int").alias("n"))
    placed = members.join(mixed, F.col("key") == F.col("mixed")).withColumn("block", F.pmod(F.xxhash64("h"), "n").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    met = placed.select("key", "h", "c", "cost", "block", other)
    met = scratch.cut(met.select("key", "h", "c", "cost", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "blocks")
    return met, max(n_parts, (met.agg(F.sum("cost")).first()[0] or 0) // TASK_BYTES)


def pairs_in_groups(key: np.ndarray, block: np.ndarray, i: int, j: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of every pair of a member in block i and one in block j of the same group, about `most` at a time."""
    order = np.lexsort((block != i, key))
    k, left = key[order], block[order] == i
    end = np.searchsorted(k, k, side="right")
    if i == j:
        first = np.arange(1, len(k) + 1)  # every pair once
    else:
        begin = np.searchsorted(k, k, side="left")
        upto = np.concatenate([[0], np.cumsum(left)])
        first = begin + upto[end] - upto[begin]  # behind the group's left members
    own = np.flatnonzero(left)
    first, count = first[own], (end - first)[own]
    upto = np.concatenate([[0], np.cumsum(count)])
    for a, b in chunks(upto, most):
        n = count[a:b]
        x = np.repeat(own[a:b], n)
        y = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield order[x], order[y]
