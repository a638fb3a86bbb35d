"""Connected components of an edge table, by alternating star contraction.

Each round rewires every edge towards the smallest neighbour seen so far, first for the larger
neighbours of a node and then for the smaller ones, so the number of rounds grows with the
logarithm of the longest chain and not with the chain. The edge table of a round is staged,
which cuts the lineage. Only a count and a fingerprint come back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.staging import discard, release, stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("e")
    ).select("e.n", "e.m")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    low = pairs.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("low"))
    return pairs.join(low, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    low = down.groupBy("n").agg(F.min("m").alias("low"))
    moved = down.join(low, "n")
    return moved.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("low").alias("v")), F.struct(F.col("n").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Null endpoints and self loops carry no link and are dropped; repeated edges count once; an
    empty edge table gives an empty result. Nodes without edges are not listed. Edges that are
    stars already, each to its smallest node, take one round.
    """
    spark = edges.sparkSession
    marked = lambda df, mark: df.observe(mark, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    first = Observation()
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(marked(links, first), "edges")
    seen = first.get
    for _ in range(max_rounds):
        mark = Observation()
        after = stage(marked(_small_star(_large_star(now)), mark), "edges")
        discard(spark, now)
        release(spark)
        now = after
        if mark.get == seen:
            break
        seen = mark.get
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def forest_roots(links: DataFrame, child: str, parent: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every child of a forest, in which a child has one row and a smaller parent; component is its root.

    Each round doubles the steps that a row has gone up. Roots are not listed.
    """
    spark = links.sparkSession
    now = stage(links.select(F.col(child).alias("node"), F.col(parent).alias("component")), "forest")
    for _ in range(max_rounds):
        moved = Observation()
        up = now.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = now.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved"))
        after = stage(step.observe(moved, F.count_if("moved").alias("n")).drop("moved"), "forest")
        discard(spark, now)
        release(spark)
        now = after
        if not moved.get["n"]:
            return now
    raise RuntimeError("the forest is deeper than expected")
