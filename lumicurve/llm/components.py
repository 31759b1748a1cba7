"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.session import drop_materialised, materialise


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), the
    component being its least node.

    Alternates the two star steps: each node ties its larger, then its smaller
    neighbours to the least of them, until every node hangs on its component's
    least node. Each round is written to the shared folder, so lineage stays
    short; neighbours of a hot node are only reduced by partial minima and
    equi-joins, never gathered. Loops and repeated edges do no harm, edges with
    a null end are left out.
    """
    spark = edges.sparkSession
    now = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialise(tied.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        drop_materialised(spark, now)
        now = new
        count = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if tuple(count) == mark:
            break
        mark = tuple(count)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
