"""Connected components by repeated contraction: joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, root: equal roots within a component, for every node that has an edge to another node.

    Every round maps a node to the least node (in a fixed random order) among itself and its neighbours, twice, and
    contracts the edges. The order keeps paths from contracting slowly, and a star takes two rounds; the number of rounds
    grows with the logarithm of the nodes. Each round reads written tables only, so lineage stays short.
    """
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mapping = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        near = both.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least(F.col("m"), key("u"))["id"].alias("p"))
        near = written(near, "near")
        parent = written(near.join(near.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p")), "parent")
        if mapping is None:
            mapping = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            mapping = written(mapping.join(parent.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "mapping")
        left = edges.join(parent, "u").select("v", F.col("p").alias("a"))
        right = left.join(parent.withColumnRenamed("u", "v"), "v").select(F.least("a", "p").alias("u"), F.greatest("a", "p").alias("v"))
        edges = written(right.where("u <> v").distinct(), "edges")
        if edges.isEmpty():
            return mapping
