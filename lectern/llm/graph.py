"""Connected components over an edge table, as rounds of joins and aggregates.

Each task first reduces the edges that it reads to a forest of stars, which takes no shuffle. Then
alternating large-star and small-star rounds (Kiveris et al., 2014) hang every neighbour below the
smallest one it knows, so long chains shorten by a constant factor, until all that is left are stars:
one aggregate tells. Edges stay distributed throughout; only that answer reaches the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.state import BROADCAST_ROWS, discard, replaceable

#: Edges that a task reduces at once.
HELD_EDGES = 1 << 20


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of every node the smallest one of its set) after joining the sets of ``a`` and ``b``, pair by pair."""
    while True:
        r, s = root[a], root[b]
        if (r == s).all():
            return root
        root = root.copy()
        np.minimum.at(root, np.maximum(r, s), np.minimum(r, s))
        while (root[root] != root).any():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: from the smallest node of each set to the others."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, (None,)):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(len(h) for h in held) >= HELD_EDGES):
            a, b = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1))
            held = []
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = union(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
            child = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root[child]]), pa.array(nodes[child])], names=["a", "b"])


def _star(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """One star round; with ``small`` the least neighbours are sent to the edges, so that a hub's edges stay where they are."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = both.join(F.broadcast(least) if small else least, "u")
    if large:
        hung = hung.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        hung = hung.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return hung.filter("a < b").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node hangs below two, or below one while another hangs below it."""
    ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("below")).unionByName(edges.select(F.col("a").alias("v"), F.lit(0).alias("below")))
    return ends.groupBy("v").agg(F.sum("below").alias("n"), F.min("below").alias("least")).filter("n > 1 or (n = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reachable.

    Self-loops and repeated or reversed edges are allowed; null ends are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    sound = edges.select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b"), (F.col("a") != F.col("b")).alias("sound")).filter("sound").select("a", "b")
    edges, path = replaceable(sound.mapInArrow(_stars, "a bigint, b bigint"), name)
    while not _done(edges):
        spent = path
        # a row per node at most, and no more edges after the first round than before it
        small = 2 * edges.count() <= BROADCAST_ROWS
        edges, path = replaceable(_star(_star(edges, True, small), False, small), name)
        discard(spark, spent)
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
