"""Resampling of images as joins with sparse weights.

A kernel of one axis is a table (n, new, old, weight): how much the old place
of an axis of length n gives to a new one.  An image is brought to a grid in
two passes, along x and then along y, each an equi-join with the table of its
axis and a sum.  The tables hold a few rows per new place and length, whatever
the number of images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.lineage import as_table, spread

#: Fixed value: the cubic kernel's parameter.
CUBIC = -0.75
#: Share of a new pixel's weight that has to be there.
LEAST_WEIGHT = 0.3
KERNELS = ("box", "bilinear", "cubic")


def _cubic(d: Column) -> Column:
    near = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
    far = ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def weights(lengths: DataFrame, new: int, kernel: str = "bilinear") -> DataFrame:
    """n, new, old, weight for each length n of ``lengths``.

    ``box`` is the mean of what a new place covers; ``bilinear`` and ``cubic``
    interpolate between the places' centres, where places beyond the edge
    count as the edge.
    """
    if kernel not in KERNELS:
        raise ValueError(f"no kernel {kernel}; there are {', '.join(KERNELS)}")
    n, i = F.col("n"), F.col("new")
    each = lengths.where("n > 0").select(F.col("n").cast("long").alias("n")).distinct().select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(new - 1).cast("long"))).alias("new"))
    if kernel == "box":  # in units of 1 / new of an old place
        taps = each.select("n", "new", F.explode(F.sequence(F.floor(i * n / new), F.ceil((i + 1) * n / new) - 1)).alias("old"))
        shared = F.least((F.col("old") + 1) * new, (i + 1) * n) - F.greatest(F.col("old") * new, i * n)
        return taps.withColumn("weight", shared / n).where("weight > 0")
    at = (i + 0.5) * n / new - 0.5
    reach = (0, 1) if kernel == "bilinear" else (-1, 0, 1, 2)
    taps = each.select("n", "new", at.alias("at"), F.explode(F.array(*[F.floor(at) + k for k in reach])).alias("tap"))
    d = F.abs(F.col("at") - F.col("tap"))
    taps = taps.withColumn("weight", 1 - d if kernel == "bilinear" else _cubic(d))
    taps = taps.withColumn("old", F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.col("tap"))))
    return taps.groupBy("n", "new", "old").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def _along(pixels: DataFrame, axis: str, length: str, taps: DataFrame, by: list[str], value: str) -> DataFrame:
    w = taps.select(F.col("n").alias("__n"), F.col("new").alias("__new"), F.col("old").alias("__old"), "weight")
    joined = pixels.join(w, (F.col(length) == F.col("__n")) & (F.col(axis) == F.col("__old")))
    sums = joined.groupBy(*by, F.col("__new").alias(axis)).agg(F.sum(F.col(value) * F.col("weight")).alias("__sum"), F.sum("weight").alias("__there"))
    return sums.where(F.col("__there") >= LEAST_WEIGHT).select(*by, axis, (F.col("__sum") / F.col("__there")).alias(value))


def resample(pixels: DataFrame, size: tuple[Column, Column], grid: tuple[int, int], by: list[str], value: str = "value", kernel: str = "box") -> DataFrame:
    """The columns ``by``, x, y and value: images (x, y, value) of ``size``
    (width, height: columns, so that images may differ) on a grid.

    A missing or null pixel leaves its weight to the others of a new one; that
    is missing if less than LEAST_WEIGHT of its weight is there.
    """
    kept = pixels.where(F.col(value).isNotNull()).select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).cast("double").alias(value),
                                                        size[0].cast("long").alias("__w"), size[1].cast("long").alias("__h"))
    # small tables, as the planner then knows: pixels aren't shuffled for them
    across, down = (as_table(weights(kept.select(F.col(c).alias("n")), n, kernel), "weights") for c, n in zip(("__w", "__h"), grid, strict=True))
    wide = _along(kept, "x", "__w", across, [*by, "y", "__h"], value)
    if kernel != "box":  # columns of an image are kept together, so that what a row gives to several new ones isn't shuffled
        wide = wide.repartition(spread(pixels.sparkSession), *by, "x")
    return _along(wide, "y", "__h", down, [*by, "x"], value).select(*by, "x", "y", value)
