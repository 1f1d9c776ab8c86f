"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivium.llm.store import materialize


def _star(sides: DataFrame, keep_larger: bool) -> DataFrame:
    """sides(u, v): link the neighbours of each u with the least of u and its neighbours.

    The second join key makes Spark exchange both sides anew, so that adaptive execution can
    split a node with very many neighbours.
    """
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"), F.pmod("u", F.lit(2)).alias("z")
    )
    met = sides.withColumn("z", F.pmod("u", F.lit(2))).join(least, ["u", "z"])
    if keep_larger:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the least node reachable.

    Null ends, self-links and repeated links count for nothing. The number of rounds grows with the
    logarithm of the longest chain. Nothing but a count and a checksum reaches the driver.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u <> v").distinct()
        now = materialize(_star(large, False).where("u <> v").distinct(), "links")
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
