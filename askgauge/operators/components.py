"""Connected components of a graph of ids, by contracting it task by task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgauge.session import cut_lineage

# Edges that one task connects.
EDGES_PER_TASK = 250_000


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, label`` of the edges of one task; the label is the smallest node it reaches there."""
    parent: dict = {}

    def top(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(n) for n in nodes], kind)], names=["node", "label"])


def _smaller_ends(edges: DataFrame) -> DataFrame:
    """One step that at least halves the longest paths: all ends of a node learn its smallest end."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    found = both.join(least, "a")
    linked = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(found.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_labels(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b); the label is the smallest node connected with it.

    Each task connects its share of the edges. A node that several tasks know ties their labels
    together; these ties are a smaller graph, treated alike. Where a step leaves more than half of
    the edges (long paths over many tasks), the next one first hands each node its smallest neighbour.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return _labels(edges, edges.count(), per_task)


def _labels(edges: DataFrame, count: int, per_task: int) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()
    parts = max(1, -(-count // per_task))
    local = cut_lineage(edges.repartition(parts, "b").mapInArrow(_connect, f"node {kind}, label {kind}"))
    if parts == 1:
        return local
    least = cut_lineage(local.groupBy("node").agg(F.min("label").alias("least")))
    ties = local.join(least, "node").filter("label <> least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct()
    ties = cut_lineage(ties)
    left = ties.count()
    if left == 0:
        return least.withColumnRenamed("least", "label")
    if 2 * left > count:
        # Handing on smaller ends keeps what is connected, and every node.
        ties = cut_lineage(_smaller_ends(ties))
        left = ties.count()
    higher = _labels(ties, left, per_task).select(F.col("node").alias("least"), F.col("label").alias("final"))
    return least.join(higher, "least", "left").select("node", F.coalesce("final", "least").alias("label"))
