"""Connected components by alternating large-star and small-star rounds, in DataFrame operations only.

Every round hangs each node's neighbours on its smallest one; after O(log^2 n) rounds each component
is a star around its smallest node. A hub's neighbours are never gathered: minima are partial
aggregates, and in the join that spreads them a node with more than ``hot_rows`` neighbours (and more than
1 / 4096 of all edges) is dealt over ``salts`` keys, to which its minimum is replicated. So 8192 nodes at
most are hot, and their names are broadcast. Adaptive execution would not split such a key by itself, as
one side of the join is an aggregate of the key. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, hot_rows: int = 1_000_000, salts: int = 64) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest node.

    Edges with a null end and self-loops are dropped, repeated ones count once. No edges: no rows.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    stars = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _mark(stars)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        hot = max(hot_rows, seen[0] // 4096) if seen[0] > hot_rows else None
        large = _large_star(stars, hot, salts)
        stars = written(_small_star(large if hot is None else written(large, "cc"), hot, salts), "cc")
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no convergence within {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(rows: DataFrame, least: DataFrame, hot: int | None, salts: int) -> DataFrame:
    """rows (u, v), each with the m of its u from least (at, m, n); a u with more than ``hot`` rows is dealt over salts."""
    if hot is None:
        return rows.join(least, F.col("u") == F.col("at"))
    least = written(least, "cc-least")
    hubs = F.broadcast(least.filter(F.col("n") > hot).select(F.col("at").alias("_hub")))
    every = F.when(F.col("n") > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hubs, F.col("u") == F.col("_hub"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hub").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")))
    spread = least.select("at", "m", F.explode(every).alias("_part"))
    return dealt.join(spread, (F.col("u") == F.col("at")) & (F.col("_salt") == F.col("_part")))


def _large_star(stars: DataFrame, hot: int | None, salts: int) -> DataFrame:
    """Each node's larger neighbours are joined to the smallest of its neighbours and itself."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("at")).agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    x = _with_least(both.filter("v > u"), least, hot, salts)
    return x.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame, hot: int | None, salts: int) -> DataFrame:
    """Each node and its smaller neighbours are joined to the smallest of them."""
    least = stars.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    x = _with_least(stars, least, hot, salts)
    spread = x.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return spread.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()
