"""Similar sites: greedy footprint dedup, spherical k-means, medoids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.functions import vectors
from terraspan.functions.geo import bbox_join, iou
from terraspan.lineage import cut
from terraspan.operators.graph import first_come

#: Fixed values.
DUPLICATE_IOU, MIN_SIMILARITY, ITERATIONS = 0.70, 0.40, 20


def greedy_dedup(hits: DataFrame, limit: float = DUPLICATE_IOU) -> DataFrame:
    """Hits (id, rank, x0, y0, x1, y1) less those that overlap a kept one of
    better rank; any number of them.  A hit without a box is kept."""
    sides = [hits.select(*[F.col(c).alias(f"{p}{c}") for c in ("id", "x0", "y0", "x1", "y1")]) for p in ("a_", "b_")]
    corners = [tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")) for p in ("a_", "b_")]
    pairs = bbox_join(*sides).where("a_id < b_id").where(iou(*corners) > limit).select("a_id", "b_id")
    chosen = first_come(pairs, hits.select("id", F.col("rank").alias("ord")))
    return hits.join(chosen.where("id = seed").select("id"), "id", "left_semi")


def cluster_count(asked: int, n: int) -> int:
    return min(asked, max(1, n // 2))


def spherical_kmeans(items: DataFrame, vector: Column, id_col: str, k: int, iterations: int = ITERATIONS) -> DataFrame:
    """id, cluster, similarity, medoid of every item.

    Seeds: the first item by id, then always the item farthest from all seeds
    (ties: first).  Items are assigned by a matrix product per Arrow batch, and
    every task sums its items per cluster before anything is shuffled; only
    the k centroids come to the driver, so any number of items can be
    clustered.  An empty cluster keeps its centroid.  Items without a vector,
    with null or non-finite entries or of another length than the first item's
    are in no cluster: cluster and similarity are null.
    """
    every = items.select(F.col(id_col).alias("id"), vectors.doubles(vector).alias("v"))
    whole = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    first = every.where(whole).orderBy("id").first()
    fits = whole & (F.size("v") == F.lit(len(first["v"]) if first else 0))
    none = every.where(~fits).select(F.col("id").alias(id_col), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("medoid"))
    if first is None:
        return none
    base = cut(every.where(fits))
    centroids = [list(first["v"])]
    n = base.count()
    while len(centroids) < min(k, n):
        nearest = vectors.nearest(F.col("v"), centroids)["similarity"]
        centroids.append(list(base.orderBy(nearest, "id").first()["v"]))
    for _ in range(iterations if len(centroids) > 1 else 0):
        new = [list(c) for c in centroids]
        for r in vectors.cluster_sums(base, "v", centroids).collect():  # k rows
            m = np.array(r["total"])
            new[r["cluster"]] = list(m / (np.sqrt(m @ m) or 1.0))
        moved = max(float(np.abs(np.array(a) - np.array(b)).max()) for a, b in zip(new, centroids, strict=True))
        centroids = new
        if moved < 1e-12:
            break
    final = cut(base.withColumn("best", vectors.nearest(F.col("v"), centroids)).select("id", "best.cluster", "best.similarity"))
    medoids = final.groupBy("cluster").agg(F.min_by("id", F.struct(-F.col("similarity"), "id")).alias("middle"))
    out = final.join(F.broadcast(medoids), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), (F.col("cluster") + 1).alias("cluster"), "similarity", (F.col("id") == F.col("middle")).alias("medoid")).unionByName(none)


def distinct_hits(hits: DataFrame, hash_col: str, order: list[Column]) -> DataFrame:
    """The best hit of each content hash."""
    return hits.withColumn("__n", F.row_number().over(W.partitionBy(hash_col).orderBy(*order))).where("__n = 1").drop("__n")


def discover(index: DataFrame, reference: int, k: int, clusters: int, *, id_col: str, vector: str, hash_col: Column, box: list[Column] | None = None,
             keep: Column | None = None, least: float = MIN_SIMILARITY) -> DataFrame:
    """Sites like a reference scene, clustered: the 3k nearest, less the scene
    itself, copies, filtered and too dissimilar ones, less overlapping
    footprints, the first k."""
    ref = index.where(F.col(id_col) == reference).select(vector).first()
    if ref is None:
        raise ValueError(f"no vector for scene {reference}")
    ref_hash = index.where(F.col(id_col) == reference).select(hash_col.alias("h")).first()["h"]
    near = vectors.top_k(index.withColumn("__hash", hash_col), [float(x) for x in ref[vector]], 3 * k, vector, id_col)
    near = near.where((F.col(id_col) != reference) & (F.col("__hash") != F.lit(ref_hash)))
    near = distinct_hits(near, "__hash", [F.col("similarity").desc(), F.col(id_col)])
    if keep is not None:
        near = near.where(keep)
    near = near.where((F.col("similarity") + 1) / 2 >= least)
    near = near.withColumn("rank", F.row_number().over(W.orderBy(F.col("similarity").desc(), id_col)))
    if box is not None:
        cols = near.select(F.col(id_col).alias("id"), "rank", *[b.cast("double").alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])
        near = near.join(greedy_dedup(cols).select(F.col("id").alias(id_col)), id_col, "left_semi")
    near = cut(near.orderBy("rank").limit(k))
    grouped = spherical_kmeans(near, F.col(vector), id_col, cluster_count(clusters, near.count()))
    found = near.select(id_col, F.round((F.col("similarity") + 1) / 2, 4).alias("similarity_to_reference"))
    return found.join(grouped.select(id_col, "cluster", "medoid"), id_col)
