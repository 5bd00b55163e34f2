"""Connected components of a graph whose edges are a DataFrame.

Edges are first contracted within each partition, then large-star and
small-star rounds alternate until the edges form stars around the smallest
node of each component. Every round is two aggregations with map-side combine
and joins that AQE can split, and ends in a written table; nothing is
collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .scratch import Scratch

#: Edges that a task contracts at a time.
CHUNK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node reachable) of the graph with the edges a-b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    at = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[0]], label[at[1]])
        new = label.copy()
        np.minimum.at(new, label[at[0]], low)
        np.minimum.at(new, label[at[1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components as the input's, a forest per partition and chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate(held, axis=1)
            u, v = forest(pairs[0], pairs[1])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
            size += batch.num_rows
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.mapInArrow(tidy(run), "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours go to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the edges (two long columns, no nulls).

    The component is the smallest node reachable. Loops and repeated edges do
    no harm; no edges give no rows.
    """
    u, v = edges.columns
    now = scratch.table(contract(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")), "edges-0")
    mark = None
    for turn in range(1, max_rounds + 1):
        now = scratch.table(_small_star(_large_star(now)), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
