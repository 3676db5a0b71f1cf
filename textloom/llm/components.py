"""Connected components by alternating large-star and small-star steps.

Edges are thinned first: each task joins the edges that it reads and passes on a star per
component it sees, at most an edge a node. Each step is a partial-aggregated minimum and
one equi-join; nothing is gathered per node, so a hub with a third of all edges is only
a skewed join, which adaptive execution splits. Steps end when an aggregation, without a
join, finds that every node has one parent and no parent has one. Every step's table is
written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, stored, tidied

#: Edges that a task holds while it thins them.
HELD_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but the smallest ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _thinned(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the components of (a, b)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]))
            size += batch.num_rows
            if size >= HELD_EDGES:
                found = np.stack(stars(*np.concatenate(held, axis=1)))
                if found.shape[1] > HELD_EDGES // 2:  # hardly fewer: pass them on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])
                    found = found[:, :0]
                held, size = [found], found.shape[1]
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*np.concatenate(held, axis=1))], ["u", "v"])

    return edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(tidied(run), "u long, v long")


def _settled(now: DataFrame) -> bool:
    """Is every component a star around its smallest node?"""
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("parent")).unionByName(now.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("parent")))
    seen = ends.groupBy("node").agg(F.min("parent").alias("low"), F.max("parent").alias("high"), (F.count("*") - F.count("parent")).alias("below"))
    return seen.where("low <> high OR (low IS NOT NULL AND below > 0)").limit(1).count() == 0


def _spread(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """For every edge (u, v): v tied to the smallest node known at u."""
    return edges.join(smallest, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long); the component
    is named by its smallest node. Loops and repeated edges do no harm; null ends are
    ignored; no edges give an empty result."""
    now = stored(_thinned(edges).distinct(), label)
    while not _settled(now):
        # u > v in every row of ``now``
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{label}-low")
        large = stored(_spread(now.select(F.col("v").alias("u"), F.col("u").alias("v")), low).unionByName(low.where("u != m").select("u", F.col("m").alias("v"))).distinct(), f"{label}-large")
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-low2")
        small = stored(_spread(large, low2).unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), f"{label}-small")
        for old in (now, low, large, low2):
            forget(old)
        now = small
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
