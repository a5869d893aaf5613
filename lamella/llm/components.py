"""Connected components by rounds of hooking, pointer doubling and contraction, all of it joins and aggregates, until few edges are left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import Forest, materialise

#: So many edges, 16 bytes each, are finished in one task.
LOCAL_EDGES = 1 << 18


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component for the ends of the edges (u, v) of a task."""
    held = [np.column_stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held), return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in ends.reshape(-1, 2).tolist():
        forest.join(i, j)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.roots()])], ["node", "component"])


def _distinct(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each undirected edge once, as u < v."""
    return edges.where(f"{a} <> {b}").groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.lit(1).alias("x")).select("u", "v")


def _to_roots(hooks: DataFrame) -> DataFrame:
    """node, hook with every hook followed to its end, the distance doubling each time."""
    while True:
        ends = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("next"))
        step = hooks.select("node", "hook").join(ends, "hook").select("node", F.col("next").alias("hook"), (F.col("next") != F.col("hook")).alias("moved"))
        hooks = materialise(step, "hooks")
        if not hooks.where("moved").limit(1).count():
            return hooks.select("node", "hook")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node that links reach.

    Each round every node hooks onto its smallest neighbour, if that is smaller than itself, hooks are followed to their
    roots by doubling, and the edges are drawn anew between the roots, until none is left. A tree of hooks has two nodes
    at least, so a round leaves at most half of the nodes: rounds grow with the logarithm of the nodes, and each doubles as
    often as the logarithm of its longest chain. Edges that have become few, at most LOCAL_EDGES, are finished by union-find in one task. No node moves to a larger one, so the smallest ends as the name. The smallest
    neighbour is a partial aggregate; a hub's edges meet a table of one row a node in plain joins,
    which adaptive execution may split. Each step's table is written to the shared folder.
    Null ends and loops are ignored; repeated edges count once.
    """
    raw = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    left, labels, distinct = materialise(raw, "edges"), None, False
    while True:
        count = left.limit(LOCAL_EDGES + 1).count()
        if count <= LOCAL_EDGES:
            hooks = materialise(left.coalesce(1).mapInArrow(_finished, "node long, component long"), "labels") if count else None
        elif not distinct:
            left, distinct = materialise(_distinct(left, "u", "v"), "edges"), True
            continue
        else:
            ends = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
            hooks = _to_roots(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("hook"))).withColumnRenamed("hook", "component")
        if labels is None:
            labels = hooks
        elif hooks is not None:
            moved = hooks.select(F.col("node").alias("component"), F.col("component").alias("to"))
            labels = materialise(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        if count <= LOCAL_EDGES:
            return labels if labels is not None else left.select(F.col("u").alias("node"), F.col("v").alias("component"))
        one = left.join(hooks.select(F.col("node").alias("u"), F.col("component").alias("hu")), "u").select("hu", "v")
        two = one.join(hooks.select(F.col("node").alias("v"), F.col("component").alias("hv")), "v")
        left = materialise(_distinct(two, "hu", "hv"), "edges")
