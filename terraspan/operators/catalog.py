"""Scene catalogue: filters, order, pages, statistics and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: rows of a page if none or 0 are asked for.
PAGE = 50


def asked(value: object) -> bool:
    """Whether a filter value restricts anything."""
    return value not in (None, "", "all", "ALL")


def contains(col: Column, term: str) -> Column:
    """Plain, case-insensitive substring test (no wildcards); null is false."""
    return F.coalesce(F.contains(F.lower(col), F.lit(term.lower())), F.lit(False))


def text_search(term: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains(F.col(c), term.strip())
    return out


def in_range(ts: Column, start, end, keep_null: bool = False) -> Column:
    """Closed time range; rows without a time fail it, or pass it with
    ``keep_null``."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (ts >= F.lit(start))
    if end is not None:
        ok = ok & (ts <= F.lit(end))
    if start is None and end is None:
        return ok
    return ts.isNull() | ok if keep_null else F.coalesce(ok, F.lit(False))


def filter_scenes(
    scenes: DataFrame, *, search: str | None = None, modality: str | None = None, sensor: str | None = None, satellite: str | None = None,
    has_crs: bool | None = None, format: str | None = None, status: str | None = None, start=None, end=None, keep_null_dates: bool = False,
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """The catalogue query's predicates, each built only if asked for, so
    what is left reaches the scan.  ``columns`` maps the roles file_name,
    scene_id, sensor, satellite, modality, format, status, crs, geo_status
    and acquisition_date to column names."""
    c = {k: k for k in ("file_name", "scene_id", "sensor", "satellite", "modality", "format", "status", "crs", "acquisition_date")}
    c |= {"geo_status": "quality.georeferencing_status"} | (columns or {})
    if asked(search):
        scenes = scenes.where(text_search(search, c["file_name"], c["scene_id"], c["sensor"], c["satellite"]))
    if asked(modality):
        scenes = scenes.where(F.col(c["modality"]) == modality)
    if asked(sensor):
        scenes = scenes.where(contains(F.col(c["sensor"]), sensor))
    if asked(satellite):
        scenes = scenes.where(contains(F.col(c["satellite"]), satellite))
    if has_crs is not None:
        geo = F.coalesce((F.col(c["crs"]) != "unavailable") & (F.col(c["geo_status"]) == "AVAILABLE"), F.lit(False))
        scenes = scenes.where(geo if has_crs else ~geo)
    if asked(format):
        scenes = scenes.where(F.col(c["format"]) == format)
    if asked(status):
        scenes = scenes.where(F.col(c["status"]) == status)
    if start is not None or end is not None:
        scenes = scenes.where(in_range(F.col(c["acquisition_date"]), start, end, keep_null_dates))
    return scenes


def sort_scenes(scenes: DataFrame, by: str, order: str = "desc", id_col: str = "scene_id") -> DataFrame:
    """Sorted with nulls lowest and the id as tiebreak."""
    key = F.col(by).desc_nulls_last() if order == "desc" else F.col(by).asc_nulls_first()
    return scenes.orderBy(key, F.col(id_col))


def page(ordered: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    return ordered.offset(offset or 0).limit(limit or PAGE)


def archive_stats(scenes: DataFrame, modality: str = "modality", format: str = "format", size: str = "file_size_bytes",
                  geo: Column | None = None, ingested: str = "ingested_at") -> DataFrame:
    """Counts, bytes, georeferenced rows and latest ingest by modality, by
    format and in total, from one pass with grouping sets.

    Rows: (facet, value, scenes, bytes, georeferenced, latest).
    """
    geo = geo if geo is not None else F.col("is_georeferenced")
    base = scenes.select(F.col(modality).alias("m"), F.col(format).alias("f"), F.col(size).alias("b"), geo.alias("g"), F.col(ingested).alias("t"))
    sets = base.groupingSets([["m"], ["f"], []], "m", "f").agg(
        F.grouping_id("m", "f").alias("gid"), F.count(F.lit(1)).alias("scenes"), F.sum("b").alias("bytes"),
        F.count_if("g").alias("georeferenced"), F.max("t").alias("latest"),
    )
    return _faceted(sets)


def _faceted(sets: DataFrame) -> DataFrame:
    facet = F.when(F.col("gid") == 1, "modality").when(F.col("gid") == 2, "format").otherwise("all")
    value = F.when(F.col("gid") == 1, F.col("m")).when(F.col("gid") == 2, F.col("f"))
    return sets.select(facet.alias("facet"), value.alias("value"), "scenes", "bytes", "georeferenced", "latest")


def merged_stats(parts: DataFrame) -> DataFrame:
    """What ``archive_stats`` gives, from partial sums (modality, format,
    scenes, bytes, georeferenced, latest)."""
    base = parts.withColumnsRenamed({"modality": "m", "format": "f"})
    return _faceted(base.groupingSets([["m"], ["f"], []], "m", "f").agg(
        F.grouping_id("m", "f").alias("gid"), *[F.sum(c).alias(c) for c in ("scenes", "bytes", "georeferenced")], F.max("latest").alias("latest")
    ))


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changes`` added or in their place."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def remove(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key), key, "left_anti")


def only_new(incoming: DataFrame, known: DataFrame, hash_col: str = "file_hash", order: list[Column] | None = None) -> DataFrame:
    """Incoming rows whose content isn't known yet; of equal ones the first."""
    new = incoming.join(known.select(hash_col), hash_col, "left_anti")
    return latest_per_key(new, [hash_col], order or [F.col("file_name")])


def checked_vectors(rows: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """The rows; one of another dimension raises when it is read."""
    wrong = F.concat(F.lit("vector dimension "), F.size(vector).cast("string"), F.lit(f", expected {dimension}"))
    return rows.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(wrong)))


def consistency(scenes: DataFrame, index: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes without a vector and vectors without a scene."""
    a = scenes.join(index.select(key), key, "left_anti").select(key, F.lit("NO_VECTOR").alias("problem"))
    return a.unionByName(index.join(scenes.select(key), key, "left_anti").select(key, F.lit("NO_SCENE").alias("problem")))


def newest(rows: DataFrame, n: int, ts: str, id_col: str) -> DataFrame:
    return rows.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def match_by_name(images: DataFrame, image: str, scenes: DataFrame, name: str, id_col: str) -> DataFrame:
    """The scene of each image: the first (by id) whose file name equals the
    image's but for case, else the first of all; ``named`` says which."""
    first = scenes.groupBy(F.lower(name).alias("__name")).agg(F.min(id_col).alias(id_col))
    least = F.broadcast(scenes.agg(F.min(id_col).alias("__first")))  # one row
    found = images.join(first, F.lower(image) == F.col("__name"), "left").join(least)
    return found.withColumn("named", F.col(id_col).isNotNull()).withColumn(id_col, F.coalesce(id_col, "__first")).drop("__name", "__first")
