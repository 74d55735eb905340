"""Connected components of a distributed edge list.

Up to ONE_TASK edges, counted first, are joined by one task with a union-find: that bounds its memory to
some 100 MB. More go through alternating large-star and small-star steps. Each step is a grouped minimum
joined back to the edges: nothing is gathered, and a node with very many edges is one key of a plain join,
which adaptive execution may split. Each round is cut by checkpoint() in the shared folder. Both ways give
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.shared import cut

ONE_TASK = 1 << 18


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with b < a. Large star: link every larger neighbour of a node to the least of its
    neighbourhood. Small star: link the smaller neighbours, and the node, to the least."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all the edges of one task."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = (b, b) if a is None else (a, a) if b is None else (a, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    parent.pop(None, None)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 14):
        some = nodes[at : at + (1 << 14)]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root(x) for x in some], kind)], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node that an edge names; component is the component's least node.

    Nodes must be of one ordered type. Null ends, loops and repeated edges link nothing; a node that only they name is alone.
    """
    a, b = F.col(src), F.col(dst)
    edges = cut(edges.select(a.alias("a"), b.alias("b")))
    if edges.count() <= one_task:
        kind = edges.schema["a"].dataType.simpleString()
        return cut(edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    a, b = F.col("a"), F.col("b")
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    alone = edges.where(a.isNotNull() & (b.isNull() | (a == b))).select(a.alias("node"))
    alone = alone.unionByName(edges.where(b.isNotNull() & a.isNull()).select(b.alias("node")))
    state = None
    for _ in range(max_rounds):
        now = cut(_stars(_stars(now, large=True), large=False))
        # settled when no node is both a centre and a leaf, and each leaf has one centre
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    alone = alone.distinct().join(ends, "node", "left_anti").select("node", F.col("node").alias("component"))
    return ends.unionByName(alone)
