"""Vector arithmetic on array columns, top-k search and text embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.language import clean, tokens
from terraspan.functions.rules import let

DIMENSION = 512
#: Word -> (first dimension, dimensions, weight) of the text embedding.
CONCEPTS = {
    "urban": (0, 48, 2.2), "build": (0, 48, 2.2), "building": (0, 48, 2.2), "structure": (0, 48, 2.0), "construction": (24, 48, 2.4),
    "road": (48, 32, 1.8), "infrastructure": (24, 48, 2.0), "port": (80, 40, 2.5), "harbor": (80, 40, 2.5), "quay": (80, 30, 2.2),
    "breakwater": (80, 30, 2.2), "ship": (100, 20, 2.0), "vessel": (100, 20, 2.0), "water": (120, 48, 2.2), "river": (120, 48, 2.4),
    "sea": (140, 40, 2.0), "ocean": (140, 40, 2.0), "coastal": (100, 48, 2.2), "shore": (100, 48, 2.2), "flood": (150, 40, 2.5),
    "lake": (120, 30, 2.0), "vegetation": (190, 48, 2.2), "agriculture": (190, 48, 2.2), "crop": (210, 40, 2.0), "farm": (210, 40, 2.0),
    "forest": (230, 40, 2.2), "green": (190, 30, 1.5), "ndvi": (210, 48, 2.5), "canopy": (230, 30, 2.0), "sar": (270, 48, 2.6),
    "radar": (270, 48, 2.6), "microwave": (270, 48, 2.4), "backscatter": (290, 40, 2.5), "speckle": (300, 30, 2.0),
    "polarization": (310, 30, 2.0), "change": (340, 48, 2.2), "expansion": (340, 48, 2.4), "temporal": (360, 40, 2.0),
    "growth": (340, 40, 2.0), "deforestation": (370, 30, 2.2), "bare": (400, 40, 2.0), "soil": (400, 40, 2.0), "cleared": (400, 40, 2.2),
    "ground": (400, 30, 1.8),
}
HASHED_FROM, HASHED = 440, 72


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column, places: int | None = 6) -> Column:
    """The vector scaled to length one (a zero vector stays)."""

    def scaled(v: Column) -> Column:
        n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
        return let(n, lambda m: F.transform(v, lambda x: F.round(x / m, places) if places is not None else x / m))

    return let(a, scaled)


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine to one fixed vector, in Arrow batches: a matrix product instead
    of a lambda per element, for large tables."""
    q = np.asarray(query, float)
    length = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype="float64")
        m = np.stack([np.asarray(x, float) for x in s])
        n = np.sqrt(np.einsum("ij,ij->i", m, m)) * length
        return pd.Series(np.divide(m @ q, n, out=np.zeros(len(m)), where=n > 0))

    return run(vector)


def nearest(vector: Column, centroids: list[list[float]]) -> Column:
    """struct(cluster, similarity): the centroid with the largest dot product,
    the first of equal ones."""
    c = np.asarray(centroids, float)

    @F.pandas_udf("cluster int, similarity double")
    def run(s: pd.Series) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({"cluster": np.zeros(0, np.int32), "similarity": np.zeros(0)})
        dots = np.stack([np.asarray(x, float) for x in s]) @ c.T
        best = dots.argmax(1)
        return pd.DataFrame({"cluster": best.astype(np.int32), "similarity": dots[np.arange(len(best)), best]})

    return run(vector)


def cluster_sums(items: DataFrame, vector: str, centroids: list[list[float]]) -> DataFrame:
    """cluster, total: the sum of the vectors nearest to each centroid; a task
    gives one row per cluster."""
    c = np.asarray(centroids, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros_like(c)
        seen = np.zeros(len(c), bool)
        for pdf in frames:
            if len(pdf):
                m = np.stack([np.asarray(x, float) for x in pdf[vector]])
                best = (m @ c.T).argmax(1)
                np.add.at(sums, best, m)
                seen[best] = True
        if seen.any():  # pandas has no type for the sums of a task without rows
            yield pd.DataFrame({"cluster": np.flatnonzero(seen).astype(np.int32), "part": [list(x) for x in sums[seen]]})

    parts = items.select(vector).mapInPandas(run, "cluster int, part array<double>")
    each = parts.select("cluster", F.posexplode("part").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("d", "x")))
    return each.groupBy("cluster").agg(F.transform(ordered, lambda e: e["x"]).alias("total"))


def top_k(index: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id", places: int = 4) -> DataFrame:
    """The k nearest rows by cosine, rounded before the sort; ties by id.

    Sort and limit together keep k rows per task: one narrow scan with a
    matrix product per Arrow batch, no shuffle of vectors.
    """
    found = index.withColumn("similarity", F.round(cosine_to(F.col(vector), query), places))
    return found.orderBy(F.col("similarity").desc(), F.col(id_col)).limit(k)


def cache_key(target: Column, model: str, preprocessor: str) -> Column:
    return F.sha2(F.concat_ws(":", target, F.lit(model), F.lit(preprocessor)).cast("binary"), 256)


def concept_table(spark) -> DataFrame:
    """word, dim, value: one row per dimension that a word adds to."""
    rows = [
        (w, (first + d) % DIMENSION, weight * math.cos(d * math.pi / count))
        for w, (first, count, weight) in CONCEPTS.items() for d in range(count)
    ]
    return spark.createDataFrame(rows, "word string, dim int, value double")


def embed_text(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, vector (DIMENSION doubles of unit length, six places).

    A token counts for a concept if either contains the other; a token without
    a concept is spread over the hashed dimensions by its MD5.  The concept
    table has a fixed size, so it is broadcast; all else is one aggregate.
    """
    spark = queries.sparkSession
    each = queries.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    words = F.array(*[F.lit(w) for w in CONCEPTS])
    each = each.withColumn("hits", F.filter(words, lambda w: F.contains(F.col("token"), w) | F.contains(w, F.col("token"))))
    known = each.select("id", F.explode("hits").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    parts = known.join(F.broadcast(concept_table(spark)), "word").select("id", "dim", (F.col("value") * F.col("n")).alias("value"))
    other = each.where(F.size("hits") == 0).withColumn("md5", F.md5("token"))
    byte = F.conv(F.substring(F.col("md5"), F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    other = other.select("id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"), "md5").withColumn("byte", byte)
    other = other.select(
        "id", (HASHED_FROM + F.pmod(F.col("byte") + F.col("i") * 17, F.lit(HASHED))).cast("int").alias("dim"),
        ((F.col("byte") / 128.0 - 1.0) * 0.5).alias("value"),
    )
    sums = parts.unionByName(other).groupBy("id", "dim").agg(F.sum("value").alias("value"))
    maps = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSION - 1)), lambda d: F.coalesce(F.element_at(F.col("m"), d.cast("int")), F.lit(0.0)))
    return maps.select(F.col("id").alias(id_col), unit(dense).alias("vector"))


def embed_image(moments: DataFrame, cells: DataFrame, by: list[str], is_sar: Column) -> DataFrame:
    """Image embedding from its moments and the means of its 16 grid cells."""
    grid = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cell", "mean_value"))).alias("m"))
    df = moments.join(grid, by)
    edge, water = F.round("edge_density", 2), F.round("water_proxy", 3)
    plants, rough = F.round("vegetation_proxy", 3), F.round("roughness_proxy", 3)
    built = edge * 2.5 + F.when(F.round("contrast_ratio", 2) > 5, 1.5).otherwise(0.5)
    port = F.when(water > 0.05, water * 3.0 + edge * 1.5).otherwise(0.0)
    wet = water * 4.0 + F.when(F.round("mean_luminance", 2) < 60, 1.5).otherwise(0.0)
    green = F.when(plants > 0.02, plants * 5.0).otherwise(0.0)
    radar = F.when(is_sar | (rough > 0.4), F.coalesce(F.nullif(rough, F.lit(0.0)), F.lit(0.5)) * 3.5).otherwise(0.0)

    def wave(first: int, last: int, amount: Column, period: float, f) -> list[Column]:
        return [amount * f((d - first) * math.pi / period) for d in range(first, last)]

    dims = (
        wave(0, 80, built, 40, math.sin) + wave(80, 120, port, 20, math.cos) + wave(120, 190, wet, 35, math.cos)
        + wave(190, 270, green, 40, math.sin) + wave(270, 340, radar, 35, math.cos)
    )
    dims += [F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0)) * 0.4 for c in range(16) for _ in range(10)]
    dims += [F.lit(0.0)] * (DIMENSION - len(dims))
    return df.select(*by, unit(F.array(*dims)).alias("vector"))


def missing_embeddings(targets: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """The targets whose key isn't in the cache."""
    return targets.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


__all__ = ["CONCEPTS", "DIMENSION", "cache_key", "clean", "cluster_sums", "concept_table", "cosine", "cosine_to", "dot", "embed_image", "embed_text", "literal", "missing_embeddings", "nearest", "norm", "top_k", "unit"]
