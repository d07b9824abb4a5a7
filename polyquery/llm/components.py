"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquery.llm.common import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs), root the least node reachable.

    Large-star ties each node's larger neighbours to its least neighbour,
    small-star each node and its smaller ones; both keep the components and, in
    turns, make them stars in O(log^2 n) rounds. Every round is written to the
    shared folder, so lineage stays short and no driver state grows. Loops
    (u = v) and repeated edges are ignored. Nulls are dropped.
    """
    spark = edges.sparkSession
    clean = edges.where("u is not null and v is not null")
    loops = clean.where("u = v").select(F.col("u").alias("node")).distinct()
    now, path = written(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = None
    for _ in range(most_rounds):
        last = path
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now, path = written(small, "stars")
        discard(spark, last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"no stars after {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.unionAll(roots).unionAll(loops.join(stars.unionAll(roots), "node", "left_anti").select("node", F.col("node").alias("root")))
