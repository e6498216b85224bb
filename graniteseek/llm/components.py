"""Connected components by contraction, on DataFrames only.

Every round each node points to the smallest of itself and its neighbours; pointers are followed once, edges are
renamed by them, and loops and repeats go.  Nodes should be hashes: then a round removes a constant share
of the nodes in expectation, whatever the shape, and long chains don't cost a round for each link.

Scale: a round is one aggregation with map-side partial minima (so hubs are no single task) and joins that
Spark may split by skew.  Tables between rounds are written to the shared folder and deleted a round later.  Nothing is collected but a
count of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge (long hashes); root is one node of its component."""
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node")
        near = cut(point, "point")
        # pointers go to smaller nodes only, so following them once more is a step up the same tree
        onward = near.withColumnsRenamed({"node": "n2", "to": "t2"})
        point = cut(near.join(onward, F.col("to") == F.col("n2")).select("node", F.col("t2").alias("to")), "point")
        before, last = mapping, edges
        if mapping is None:
            mapping = cut(point.withColumnRenamed("to", "root"), "roots")
        else:
            step = point.withColumnsRenamed({"node": "n2", "to": "t2"})
            mapping = cut(mapping.join(step, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("t2", "root").alias("root")), "roots")
        pa_, pb = point.withColumnsRenamed({"node": "na", "to": "ta"}), point.withColumnsRenamed({"node": "nb", "to": "tb"})
        renamed = last.join(pa_, F.col("a") == F.col("na")).join(pb, F.col("b") == F.col("nb"))
        edges = cut(renamed.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct(), "edges")
        free(near, point, before, last)
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    free(edges)
    return mapping
