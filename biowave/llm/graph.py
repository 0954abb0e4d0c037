"""Connected components as an iteration of DataFrame joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biowave.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (src, dst bigint); component is the smallest node reachable.

    Each round sends every node to the smallest one around it, follows these steps to their ends and contracts the links to
    the ends they join; what has become a loop or a repetition goes, so later rounds see only what is left between groups.
    A round at least halves the nodes that have links. Joins read written tables or exchanges of their own, so adaptive
    execution can split what a node or label with a third of the rows fills. Null ends and an empty table give no rows.
    """
    ends = links.where("src IS NOT NULL AND dst IS NOT NULL")
    edges = materialize(ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = None
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        steps = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))
        roots = _ends_of(materialize(steps.select("node", F.least("node", "label").alias("label"))))
        to = roots.select(F.col("node").alias("_of"), F.col("label").alias("_up"))
        if labels is None:
            labels = roots
        else:
            before = labels
            labels = materialize(before.join(to, before["label"] == F.col("_of"), "left").select("node", F.coalesce("_up", "label").alias("label")))
            discard(before)
        left = edges.join(to, F.col("src") == F.col("_of")).select(F.col("_up").alias("a"), "dst")
        ended = left.join(to, F.col("dst") == F.col("_of")).select("a", F.col("_up").alias("b")).where("a <> b")
        before, edges = edges, materialize(ended.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        discard(before)
        if edges.isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def _ends_of(steps: DataFrame) -> DataFrame:
    """steps (node, label), which lead to smaller nodes or stay, followed to their ends by doubling."""
    last = None
    while True:
        now = steps.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == last:
            return steps
        last = now
        up = steps.select(F.col("node").alias("_of"), F.col("label").alias("_up"))
        before, steps = steps, materialize(steps.join(up, steps["label"] == F.col("_of")).select("node", F.col("_up").alias("label")))
        discard(before)


def forest(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Join the trees of the pairs (left, right) in parent, in place; the pairs that joined two trees."""
    while not np.array_equal(up := parent[parent], parent):
        parent[:] = up
    apart = parent[left] != parent[right]
    used = []
    for a, b in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            x = int(parent[x])
        while parent[y] != y:
            y = int(parent[y])
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append((a, b))
    return used
