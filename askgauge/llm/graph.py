"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of its component.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller
    ones, the smallest node it knows. Each step is a join and two aggregates; the number of rounds grows
    with the logarithm of the longest path. Edges and labels stay in Spark.
    """
    def sign(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    own = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        small = stored(small.where("u <> v").distinct(), "edges")
        before, own = sign(own), small
        if before == sign(own):
            break
    return own.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class Forest:
    """Union-find over 0, 1, ..., n - 1."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.find(int(x)) for x in members], dtype=np.int64)


def _own_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a task's edges; label is the smallest node of the task's component."""
    number: dict = {}
    forest = Forest(0)
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("a").type
        for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            own = []
            for node in pair:
                if node not in number:
                    number[node] = len(number)
                    forest.parent.append(len(forest.parent))
                own.append(number[node])
            forest.join(*own)
    nodes = list(number)
    least: dict = {}
    roots = [forest.find(i) for i in range(len(nodes))]
    for node, root in zip(nodes, roots, strict=True):
        least[root] = min(node, least.get(root, node))
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([least[r] for r in roots], kind)], names=["node", "label"])


def group_labels(edges: DataFrame, per_task: int = 250_000) -> DataFrame:
    """What ``components`` returns, in fewer steps: the graph is contracted instead of relabelled.

    Tasks connect the edges they hold (about ``per_task``, dealt by their smaller node); a node that several tasks
    know connects their labels, which are the nodes of a smaller graph, treated alike. Where a step leaves more than half of
    the edges, as in long paths over many tasks, the rest is left to ``components``.
    """
    own = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    kind = own.schema["a"].dataType.simpleString()
    many = own.count()
    parts = -(-many // per_task)
    # Few edges go to one task; keys dealt to more tasks than asked for would leave a component in parts.
    dealt = own.coalesce(1) if parts <= 1 else own.repartition(parts, "b")
    local = stored(dealt.mapInArrow(_own_components, f"node {kind}, label {kind}"), "labels")
    if parts <= 1:
        return local
    least = stored(local.groupBy("node").agg(F.min("label").alias("least")), "labels")
    between = stored(local.join(least, "node").where(F.col("label") != F.col("least")).select(F.col("label").alias("a"), F.col("least").alias("b")).distinct(), "edges")
    left = between.count()
    if not left:
        return least.withColumnRenamed("least", "label")
    higher = components(between) if 2 * left > many else group_labels(between, per_task)
    higher = higher.select(F.col("node").alias("least"), F.col("label").alias("final"))
    return least.join(higher, "least", "left").select("node", F.coalesce("final", "least").alias("label"))
