"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm._spark import as_table, drop_tables

#: A key that holds at least one in so many of all rows is large; there are
#: at most that many, so what is joined to them may be broadcast.
HUB_SHARE = 256
HUB_LINKS = 200


def join_in_place(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has each key once with the number
    ``__ts_n`` of its rows; ``total``: the number of all rows.  Rows of large
    keys are joined where they lie, so that no task gathers them."""
    large = F.col("__ts_n") >= max(HUB_LINKS, -(-total // HUB_SHARE))
    hot = keyed.where(large).drop("__ts_n")
    marked = rows.join(F.broadcast(hot.withColumn("__ts_hot", F.lit(True))), key, "left")
    found = marked.where("__ts_hot").drop("__ts_hot")
    rest = marked.where("__ts_hot IS NULL").select(*rows.columns).join(keyed.where(~large).drop("__ts_n"), key)
    return found.unionByName(rest)


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step on edges (u, v), u > v: every node's neighbours move to its
    smallest one.  The minimum is aggregated before it is joined back, and the
    links of hubs are joined where they lie, so a node with very many
    neighbours is never gathered."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__ts_n"))
    least = least.withColumn("m", F.least("u", "m"))
    moved = join_in_place(near, least, "u", 2 * total if large else total)
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.where("u > v").distinct()


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """node, comp for every node of ``links`` (a, b): comp is the smallest
    node reachable.  Nodes in no link are left out."""
    edges = as_table(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(most):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        half = as_table(_stars(edges, True, state[0]), "links")
        drop_tables(edges)
        edges = as_table(_stars(half, False, state[0]), "links")
        drop_tables(half)
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
