"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.session import checkpointed


def _signature(edges: DataFrame) -> tuple:
    # Two numbers, however many edges there are.
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes.

    The component is the smallest node that can be reached.  Alternates two steps
    until nothing changes: every node links its larger neighbours to its smallest
    one, then its smaller neighbours.  That takes a number of rounds logarithmic in
    the size of a component, not in its diameter.

    Minima are combined before the shuffle.  They are written out before they are
    joined back, so that a node with very many edges is a skewed join partition that
    adaptive execution can split.  Nothing is collected.
    """
    edge = edges.where(F.col(a) != F.col(b))
    edge = checkpointed(edge.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(edge)
    while before[0]:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        edge = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(edge.groupBy("u").agg(F.min("v").alias("m")))
        small = edge.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(edge)
        if after == before:
            break
        before = after
    roots = edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def spanning_edges(linked, seeds) -> list[tuple[int, int]]:
    """(vertex, root) for every vertex that hangs together with another one.

    ``linked(i)`` gives the vertices next to i; ``seeds`` are all vertices in
    ascending order, so a root is the smallest vertex of its component.  Every vertex
    is looked at once.
    """
    edges, seen = [], set()
    for root in seeds:
        if root in seen:
            continue
        seen.add(root)
        waiting = [root]
        while waiting:
            for i in linked(waiting.pop()):
                if i not in seen:
                    seen.add(i)
                    edges.append((i, root))
                    waiting.append(i)
    return edges
