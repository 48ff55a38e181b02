"""Connected components of links that may be far too many for one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumflow.llm.kernels import table
from albumflow.llm.shared import arrow_schema, saved

_LINKS = "a bigint, b bigint"


def forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of nodes 0..count-1 over the links a-b."""
    root = np.arange(count)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as (node, smallest node) links, without self-links."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(nodes), number[: len(a)], number[len(a) :])
    more = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[more], nodes[root[more]]


def local_stars(links: DataFrame) -> DataFrame:
    """Links (a, b) with each Arrow batch's connections as stars: at most a link a node."""
    schema = arrow_schema(_LINKS)

    def run(batches):
        for batch in batches:
            yield table(schema, *stars(batch.column(0).to_numpy(), batch.column(1).to_numpy()))

    return links.select("a", "b").mapInArrow(run, _LINKS)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node.

    Each round hooks every node to its smallest neighbour, follows hooks to their end by
    pointer doubling, and contracts the links; nodes at least halve a round.
    """
    links = saved(local_stars(links).where("a <> b").distinct())
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")))
        while True:
            ends = hooks.select(F.col("a").alias("b"), F.col("b").alias("end"))
            step = saved(hooks.join(ends, "b").select("a", F.col("end").alias("b"), (F.col("end") != F.col("b")).alias("moved")))
            hooks = step.select("a", "b")
            if step.where("moved").isEmpty():
                break
        root = hooks.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if labels is None:
            labels = root
        else:
            up = root.select(F.col("node").alias("component"), F.col("component").alias("up"))
            labels = saved(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        left = links.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").where("ra <> rb")
        links = saved(local_stars(left.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).distinct())
    return labels if labels is not None else links.toDF("node", "component")
