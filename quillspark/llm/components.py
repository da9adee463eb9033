"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot, parts, spread_join, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m: u or its smallest v, whichever is smaller."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    heavy = hot(least, total, parts(rows.sparkSession))
    return spread_join(rows, least.select("u", F.least("u", "m").alias("m")), "u", heavy)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v) of longs: root is the component's smallest node. A large star ties each node's larger neighbours to
    its smallest, a small star its smaller ones; the number of rounds grows with the logarithm of the longest path. Each round is
    written to the shared folder. A node with very many edges is met by a partial aggregate and a join over salts."""
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large, state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        reached = _state(after)
        forget(now)
        now = after
        if reached == state:
            break
        state = reached
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct())
