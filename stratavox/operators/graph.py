"""Connected components of a link table.

The links of each task become stars, one for each of their components; then large and small stars alternate between
tasks until every node has one parent and no parent has one. Every round is written, and the last one's tables removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch

#: Links whose components one task finds before tasks meet.
LINKS_PER_TASK = 250_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component under the links a - b."""
    top = np.arange(n)
    while True:
        least = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], least)
        np.minimum.at(new, top[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == top).all():
            return top
        top = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the links a - b as one star for each of their components, around its smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = roots(len(nodes), at[: len(a)], at[len(a) :])
    own = top != np.arange(len(nodes))
    return nodes[own], nodes[top[own]]


def _collapsed(links: DataFrame) -> tuple[DataFrame, Scratch]:
    """The links (u, v) of each task, about LINKS_PER_TASK of them, as stars (u, v), v the smaller; and what holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n > 4 * LINKS_PER_TASK:  # stars of what is held are no more than its nodes
                held = [forest(*(np.concatenate(x) for x in zip(*held)))]
                n = len(held[0][0])
        if n:
            u, v = forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    out = Scratch(links.sparkSession)
    with Scratch(links.sparkSession) as passing:
        raw = passing.written(links, "links")
        return out.written(raw.coalesce(1 + raw.count() // LINKS_PER_TASK).mapInArrow(run, "u long, v long"), "stars"), out


def connected(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every linked node of links (a, b: long); a component is its smallest node.

    Links of a node with itself and null ends are left out. Raises if the components do not settle within `rounds`.
    """
    edges, last = _collapsed(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v"))
    for _ in range(rounds):
        roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        roles = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not roles.where("up > 1 or (up > 0 and down > 0)").head(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _collapsed(pulled.union(small.select("u", F.col("m").alias("v"))))
        last.remove()
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
