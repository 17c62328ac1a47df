"""Pixel arithmetic as column expressions, and aggregates over pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.functions.rules import cascade
from terraspan.lineage import as_table

#: Channel means and deviations of the embedding's input.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
INDEX_BANDS = {"NDVI": ("NIR", "RED"), "NDWI": ("GREEN", "NIR"), "NDBI": ("SWIR1", "NIR")}
SAMPLE, REGION_SAMPLE = 25_000, 20_000


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def log_intensity(lum: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.log1p(lum) * 45.0))


def standardised(value: Column, channel: int) -> Column:
    return (value / 255.0 - CHANNEL_MEAN[channel]) / CHANNEL_STD[channel]


def byte(x: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """Linear contrast stretch to 0-255; 0 where the range is empty."""
    return F.when(high > low, byte(F.floor((x - low) / (high - low) * 255 + 0.5).cast("double"))).otherwise(F.lit(0.0))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null for a sum of 1e-6 or less or outside [-1, 1]."""
    value = (a - b) / (a + b)
    return F.when(((a + b) > 1e-6) & (value >= -1) & (value <= 1), value)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def every(df: DataFrame, index: str, total: Column, most: int = SAMPLE) -> DataFrame:
    """Systematic sample: every ``floor(total / most)``-th row by index."""
    step = F.greatest(F.lit(1), F.floor(total / most))
    return df.where(F.pmod(F.col(index), step) == 0)


def band_statistics(pixels: DataFrame, by: list[str], value: str = "value", nodata: float | None = None) -> DataFrame:
    """min, max, mean, population deviation, valid share and number per group,
    in one partial aggregate."""
    v = F.col(value)
    ok = finite(v) if nodata is None else finite(v) & (v != nodata)
    x = F.when(ok, v)
    return pixels.groupBy(*by).agg(
        F.coalesce(F.min(x), F.lit(0.0)).alias("min"), F.coalesce(F.max(x), F.lit(0.0)).alias("max"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std_dev"),
        (F.count(x) / F.count(F.lit(1)) * 100).alias("valid_pct"), F.count(x).alias("n"),
    )


def in_ranges(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` dealt in order over as many ranges as there are partitions, with
    the range's number ``__p``; a group may lie in many of them.  A table, so
    that the ranges stay the same."""
    return as_table(df.repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id()), "ranges")


def running_counts(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, __upto, __all: the distinct finite values with the number of
    pixels up to them and in the group.

    Values are counted first and summed up range by range, so neither a large
    group nor one with nearly as many values as pixels meets in one task.
    """
    counts = in_ranges(pixels.where(finite(F.col(value))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), by, value)
    sums = counts.groupBy(*by, "__p").agg(F.sum("__n").alias("__sum"))
    group = W.partitionBy(*by)
    sums = sums.withColumns({"__base": F.sum("__sum").over(group.orderBy("__p")) - F.col("__sum"), "__all": F.sum("__sum").over(group)})
    placed = counts.join(as_table(sums.drop("__sum"), "sums"), [*by, "__p"])
    return placed.select(*by, value, (F.col("__base") + F.sum("__n").over(W.partitionBy(*by, "__p").orderBy(value))).alias("__upto"), "__all")


def value_at(place: Column, value: str) -> Column:
    """Aggregate over ``running_counts``: the value at a place, counted from 0."""
    return F.min(F.when(F.col("__upto") > place, F.col(value)))


def floor_percentiles(pixels: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place floor(n * share) of each group in order."""
    counts = running_counts(pixels, by, value)
    return counts.groupBy(*by).agg(*[value_at(F.floor(F.col("__all") * share), value).alias(name) for name, share in shares.items()])


def linear_percentiles(pixels: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles between the two values around place (n - 1) * share."""
    picks = []
    for name, share in shares.items():
        at = (F.col("__all") - 1) * share
        picks += [value_at(F.floor(at), value).alias(f"__{name}0"), value_at(F.ceil(at), value).alias(f"__{name}1"), F.max(at - F.floor(at)).alias(f"__{name}f")]
    found = running_counts(pixels, by, value).groupBy(*by).agg(*picks)
    return found.select(*by, *[(F.col(f"__{n}0") + (F.col(f"__{n}1") - F.col(f"__{n}0")) * F.col(f"__{n}f")).alias(n) for n in shares])


def looks(mean: Column, std: Column) -> Column:
    """Equivalent number of looks."""
    return F.when(std > 0, F.pow(mean / std, F.lit(2.0))).otherwise(F.lit(1.0))


def speckle(enl: Column, profile: str = "evidence") -> Column:
    """LOW over 4, MODERATE over 1.8 (``legacy``: 1.5), else HIGH."""
    return cascade([(enl > 4.0, "LOW"), (enl > (1.8 if profile == "evidence" else 1.5), "MODERATE")], "HIGH")


def pixel_classes(r: Column, g: Column, b: Column) -> Column:
    """The candidate classes of a pixel, each with the value to average."""
    lum = luminance(r, g, b)
    rules = [
        ((g > r + 15) & (g > b + 10), "VEGETATION_CANDIDATE", g - r),
        ((lum < 45) & (F.abs(r - g) < 15) & (F.abs(g - b) < 15), "WATER_CANDIDATE", lum),
        (lum > 180, "BUILT_UP_CANDIDATE", lum),
    ]
    return F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), v.cast("double").alias("value"))) for c, k, v in rules])
    )


def class_regions(pixels: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Bounding box, count and mean of each pixel class; columns x, y, r, g, b."""
    each = pixels.select(*by, "x", "y", F.explode(pixel_classes(F.col("r"), F.col("g"), F.col("b"))).alias("k"))
    boxes = each.groupBy(*by, F.col("k.category").alias("category")).agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.count(F.lit(1)).alias("pixels"), F.avg("k.value").alias("mean_value"),
    )
    return boxes.where((F.col("pixels") >= least) & (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))


def backscatter_regions(pixels: DataFrame, by: list[str], value: str = "value", least: int = 10) -> DataFrame:
    """Boxes of the pixels at or over p95 and at or under p5."""
    cuts = floor_percentiles(pixels, by, value, {"p5": 0.05, "p95": 0.95})
    v = F.col(value)
    cuts = as_table(cuts, "cuts")  # a row per group: broadcast if it is small
    joined = pixels.where(finite(v)).join(cuts, by) if by else pixels.where(finite(v)).crossJoin(cuts)  # without groups, one row
    kinds = F.array_compact(F.array(
        F.when(v >= F.col("p95"), F.struct(F.lit("HIGH_BACKSCATTER_DOUBLE_BOUNCE").alias("kind"), F.col("p95").alias("level"))),
        F.when(v <= F.col("p5"), F.struct(F.lit("LOW_BACKSCATTER_SPECULAR").alias("kind"), F.col("p5").alias("level"))),
    ))
    each = joined.select(*by, "x", "y", F.explode(kinds).alias("k"))
    boxes = each.groupBy(*by, F.col("k.kind").alias("kind"), F.col("k.level").alias("level")).agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count(F.lit(1)).alias("pixels"),
    )
    return boxes.where((F.col("pixels") >= least) & (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))


def image_metrics(pixels: DataFrame, by: list[str], order: str = "i") -> DataFrame:
    """Brightness, contrast and the shares of vegetation, dark, bright and
    rough pixels of each image; columns r, g, b and the sample's order."""
    lum = luminance(F.col("r"), F.col("g"), F.col("b"))
    df = in_ranges(pixels.select(*by, "r", "g", "b", F.col(order).alias("__o")).withColumn("lum", lum), by, "__o")
    # a pixel's successor is in its range, or the first of the group's next one
    edges = df.groupBy(*by, "__p").agg(F.min_by("lum", "__o").alias("__first"))
    edges = edges.select(*by, "__p", F.lead("__first").over(W.partitionBy(*by).orderBy("__p")).alias("__next"))
    inside = F.lead("lum").over(W.partitionBy(*by, "__p").orderBy("__o"))
    df = df.join(as_table(edges, "edges"), [*by, "__p"]).withColumn("after", F.coalesce(inside, F.col("__next")))
    r, g, b, x = F.col("r"), F.col("g"), F.col("b"), F.col("lum")

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    out = df.groupBy(*by).agg(
        F.avg(x).alias("mean_brightness"), F.stddev_pop(x).alias("std_brightness"), (F.max(x) - F.min(x)).alias("contrast"),
        share((g > r + 15) & (g > b + 10)).alias("vegetation"), share(x < 45).alias("dark"), share(x > 200).alias("bright"),
        share(F.coalesce(F.abs(x - F.col("after")) > 35, F.lit(False))).alias("rough"),
        (F.avg(F.abs(r - g) + F.abs(g - b)) > 10).alias("has_color"),
    )
    return out.withColumns({
        "overexposed": (F.col("bright") > 0.45) & (F.col("mean_brightness") > 190),
        "underexposed": (F.col("dark") > 0.65) & (F.col("mean_brightness") < 50),
        "low_contrast": (F.col("contrast") < 40) | (F.col("std_brightness") < 12),
    })


def exposure(mean: Column, std: Column) -> Column:
    """Flags of a mean over 210 or under 40 and a deviation under 12."""
    return F.array_compact(F.array(
        F.when(mean > 210, F.lit("OVEREXPOSED")), F.when(mean < 40, F.lit("UNDEREXPOSED")), F.when(std < 12, F.lit("LOW_CONTRAST")),
    ))


def image_moments(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Moments and proxies of an image for its embedding; columns x, y, r, g, b."""
    lum = luminance(F.col("r"), F.col("g"), F.col("b"))
    df = pixels.withColumn("lum", lum)
    df = df.withColumn("before", F.lag("lum").over(W.partitionBy(*by, "y").orderBy("x")))
    agg = df.groupBy(*by).agg(
        F.avg("lum").alias("mean_luminance"), F.var_pop("lum").alias("variance"), F.min("lum").alias("lo"), F.max("lum").alias("hi"),
        (F.sum(F.abs(F.col("lum") - F.col("before"))) / F.count(F.lit(1))).alias("edge_density"),
        F.avg("r").alias("mr"), F.avg("g").alias("mg"), F.avg("b").alias("mb"),
    )
    mr, mg, mb = F.col("mr"), F.col("mg"), F.col("mb")
    return agg.select(
        *by, "mean_luminance", "variance", F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(F.col("hi")).alias("contrast_ratio"),
        "edge_density", ((mg - mr) / (mg + mr + 1)).alias("vegetation_proxy"), ((mb - mr) / (mb + mr + 1)).alias("water_proxy"),
        (F.sqrt("variance") / (F.col("mean_luminance") + 1)).alias("roughness_proxy"),
    )


def grid_cells(pixels: DataFrame, by: list[str], side: int = 224, cells: int = 4, stride: int = 1) -> DataFrame:
    """Mean standardised value (summed over channels) of the grid cells, from all
    their pixels, or from every ``stride``-th column and row (the reference: 8)."""
    size = side // cells
    total = standardised(F.col("r"), 0) + standardised(F.col("g"), 1) + standardised(F.col("b"), 2)
    if stride > 1:
        pixels = pixels.where((F.pmod("x", F.lit(stride)) == 0) & (F.pmod("y", F.lit(stride)) == 0))
    cell = F.floor(F.col("y") / size) * cells + F.floor(F.col("x") / size)
    return pixels.groupBy(*by, cell.cast("int").alias("cell")).agg(F.avg(total).alias("mean_value"))


def synthetic_delta(width: int, height: int, x: Column, y: Column, kind: str) -> Column:
    """The deterministic difference field: ``expansion``, ``seasonal`` or
    ``noise``."""
    if kind == "expansion":
        parcel = (x >= width * 0.50) & (x <= width * 0.92) & (y >= height * 0.45) & (y <= height * 0.92)
        road = (x >= width * 0.10) & (x <= width * 0.95) & (y >= height * 0.40) & (y <= height * 0.44)
        return cascade(
            [(parcel, F.lit(68.0) + F.sin(x * 0.3) * F.cos(y * 0.3) * 12.0), (road, F.lit(55.0))], F.abs(F.sin(x * 0.1) * 3.0)
        )
    if kind == "seasonal":
        return F.lit(14.0) + F.sin(x * 0.05) * 5.0
    seed = F.pmod(x * 37 + y * 73, F.lit(100))
    return F.when(seed > 85, (seed - 85) * 2.0).otherwise(F.lit(0.0))


def grid(spark, width: int, height: int) -> DataFrame:
    """x, y of every pixel, generated in parallel."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def pair_metrics(pairs: DataFrame, by: list[str], before: str, after: str, threshold: Column) -> DataFrame:
    """Mean absolute difference, changed share and mean shift of aligned pixels."""
    d = F.abs(F.col(before) - F.col(after))
    return pairs.groupBy(*by).agg(
        F.avg(d).alias("mad"), F.avg(F.when(d > threshold, 1.0).otherwise(0.0)).alias("changed"),
        F.abs(F.avg(before) - F.avg(after)).alias("shift"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"),
        F.max(d).alias("max_delta"), F.count(F.lit(1)).alias("pixels"),
    )


TWO_PI = 2 * math.pi


#: The bands behind red, green and blue of each composite.
COMPOSITES = {"TRUE_COLOR": ("RED", "GREEN", "BLUE"), "FALSE_COLOR": ("NIR", "RED", "GREEN")}


def color_composite(bands: Column, mode: str = "TRUE_COLOR") -> Column:
    """struct(status, red, green, blue) of a pixel from its bands (map of band
    to value); values are cut to 0-255 without a stretch, a missing value is 0.
    A mode whose bands aren't all there is unavailable."""
    names = COMPOSITES[mode]
    there = F.lit(True)
    for n in names:
        there = there & F.map_contains_key(bands, n)
    cut = [F.when(there, F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.coalesce(F.nanvl(F.element_at(bands, n), F.lit(0.0)), F.lit(0.0))).cast("double")))) for n in names]
    status = F.when(there, "GENERATED").otherwise("UNAVAILABLE_REQUIRED_BANDS_NOT_FOUND")
    return F.struct(status.alias("status"), *[c.alias(k) for c, k in zip(cut, ("red", "green", "blue"), strict=True)])
