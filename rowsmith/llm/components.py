"""Connected components of an edge list, by alternating large-star and small-star rounds.

Edges live in the shared folder between rounds; only the count and a checksum of them reach the driver.
A vertex of very many edges is no problem: its minimum is pre-aggregated, and the join that hands it out
can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import discard, settle

#: Far more rounds than the logarithm of any number of edges.
MOST_ROUNDS = 100


def _least_neighbour(edges: DataFrame, u: str, v: str, held: list[DataFrame]) -> DataFrame:
    """u, v and m, the least of u and its neighbours, for each row; what was written for it is added to held."""
    least = settle(edges.groupBy(F.col(u).alias("k")).agg(F.min(v).alias("m")), "least")
    held.append(least)
    return edges.join(least, edges[u] == least["k"]).select(F.col(u).alias("u"), F.col(v).alias("v"), F.least(u, "m").alias("m"))


def large_star(edges: DataFrame, held: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both, "u", "v", held).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def small_star(edges: DataFrame, held: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least_neighbour(down, "u", "v", held)
    rows = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    return rows.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v): rows (u, root), root being the least vertex of u's component; roots themselves are left out.

    Loops and repeated edges are allowed; null ends are dropped; no edges give no rows.  Unfinished components are an
    error, never a result.
    """
    spark = edges.sparkSession
    now = settle(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        held = [now]
        after = settle(small_star(large_star(now, held), held), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, *held)
        now = after
        if state == seen or not state[0]:
            return now.select("u", F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
