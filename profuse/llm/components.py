"""Connected components of a link table, by alternating large and small stars.

Links stay a table: each round joins it twice with the least neighbour of a
node (combined map-side) and writes it to the shared folder.  A hub that holds a
large share of the links is joined by broadcast (``common.attach``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from profuse.llm.common import attach
from profuse.session import stored


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the sets of ``i[k]`` and ``j[k]``; ``parent`` points at each set's least member."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _least(pairs: DataFrame, key: str, other: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.min(other).alias("least"), F.count("*").alias("rows"))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) of every node that has a link; ``edges`` has (a, b); root is the least node reachable.

    Null ends and loops are left out.  An empty table gives an empty result.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(down, label)
    state = _state(links)
    while state[0]:
        total = state[0]
        up = _least(links.select(F.col("b").alias("a"), F.col("a").alias("b")), "a", "b")
        lower = _least(links, "a", "b")
        # Least of a node's neighbours below it; a node with none is its own least.
        hubs = up.select(F.col("a").alias("b"), "rows").join(
            lower.select(F.col("a").alias("b"), "least"), "b", "left").withColumn("least", F.coalesce("least", "b"))
        large = stored(attach(links, hubs, "b", "rows", total)
                       .select("a", F.col("least").alias("b")).distinct(), label)
        lows = _least(large, "a", "b")
        small = (attach(large, lows, "a", "rows", total).where("b <> least")
                 .select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(lows.select("a", F.col("least").alias("b"))).distinct())
        links = stored(small, label)
        before, state = state, _state(links)
        if state == before:
            break
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
