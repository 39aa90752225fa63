"""Connected components by hooking each node to its smallest neighbour and jumping pointers.

All rounds are equi-joins of tables kept in the shared folder, so a hub's rows can be split by the
skew handling of adaptive execution, and a lost executor costs one round at most. Links are keyed by
their larger end: in a star around the smallest id every key has one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of a link. Links with a null or the same end count for nothing."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    before = None
    for _ in range(rounds):
        parent = cut(edges.groupBy("v").agg(F.min("u").alias("p"), F.count(F.lit(1)).alias("n")))
        n, many, total = parent.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.xxhash64("v", "p").cast("decimal(38,0)"))).first()
        if not n or (n == many and (n, total) == before):
            return parent.select(F.col("v").alias("node"), F.col("p").alias("component")).unionByName(
                parent.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
            )
        before = (n, total) if n == many else None
        up = parent.select(F.col("v").alias("w"), F.col("p").alias("q"))
        # what v's other neighbours now share with its parent, and v's pointer moved one step up
        jumped = parent.join(up, parent.p == up.w, "left").select("v", F.coalesce("q", "p").alias("u"))
        if n != many:
            hung = edges.join(up, edges.v == up.w).where("u <> q").select(F.greatest("u", "q").alias("v"), F.least("u", "q").alias("u"))
            jumped = jumped.unionByName(hung)
            edges = cut(jumped.distinct())
        else:
            edges = cut(jumped)
    raise RuntimeError(f"no end after {rounds} rounds")
