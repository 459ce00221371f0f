"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakroom.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b; any orderable type, any direction) -> ``node, root``: the least node of its component.

    Only nodes with an edge appear. In each round every node points to its least
    neighbour (or to itself, if it is less), pointers are followed to their ends by
    doubling, and the edges between different ends make the next, smaller graph: it has
    at most half the nodes. A node of very many edges is met by partial sums and by plain
    joins of written tables, which Spark splits where they are skewed. None of them is
    broadcast, however small: there are many, and what is broadcast passes through the driver.
    """
    now = materialize(edges.where("a <> b").select("a", "b").distinct())
    rounds = []
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")))
        while True:
            beyond = to.toDF("via", "end").hint("merge")
            hop = to.join(beyond, F.col("root") == F.col("via")).select("node", "end", (F.col("end") != F.col("root")).alias("moved"))
            hop = materialize(hop.withColumnRenamed("end", "root"))
            still = hop.where("moved").isEmpty()
            to = hop.drop("moved")
            if still:
                break
        rounds.append(to)
        ends = now.join(to.toDF("from_a", "u").hint("merge"), F.col("a") == F.col("from_a")).join(to.toDF("from_b", "v").hint("merge"), F.col("b") == F.col("from_b"))
        now = materialize(ends.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        if now.isEmpty():
            break
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.toDF("via", "end").hint("merge"), F.col("root") == F.col("via"), "left").select("node", F.coalesce("end", "root").alias("root"))
    return out
