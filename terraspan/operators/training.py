"""Training records: validation, counts, accuracy, band rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.functions.language import answer_matches
from terraspan.functions.raster import byte, linear_percentiles
from terraspan.functions.resampling import resample
from terraspan.functions.rules import cascade
from terraspan.lineage import as_table

MODALITIES = ["optical", "sar", "multispectral", "RGB", "S1", "S2"]


def validated(records: DataFrame, line: str = "line") -> DataFrame:
    """Records with the reason they are rejected (null: accepted): a missing
    field, no image, an unknown modality, a choice answer that isn't among
    the choices, or an id seen on an earlier line."""
    first = F.row_number().over(W.partitionBy("id").orderBy(line)) > 1
    blank = F.lit(False)
    for c in ("id", "task_type", "question", "answer"):
        blank = blank | F.coalesce(F.trim(c) == "", F.lit(True))
    modality = F.exists("images", lambda i: ~F.coalesce(i["modality"].isin(*MODALITIES), F.lit(False)))
    choice = (F.size("choices") > 0) & ~F.coalesce(F.array_contains(F.col("choices"), F.col("answer")), F.lit(False))
    reason = cascade([
        (blank, "MISSING_FIELD"), (F.coalesce(F.size("images") <= 0, F.lit(True)), "NO_IMAGES"), (modality, "BAD_MODALITY"),
        (F.coalesce(choice, F.lit(False)), "ANSWER_NOT_A_CHOICE"), (first, "DUPLICATE_ID"),
    ])
    return records.withColumn("rejected", reason)


def counts(records: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n for each column and in total, in one pass."""
    sets = [[c] for c in columns] + [[]]
    g = records.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("gid"), F.count(F.lit(1)).alias("n"))
    n = len(columns)
    facets = [(F.col("gid") == (2**n - 1) - (1 << (n - 1 - k)), c) for k, c in enumerate(columns)]
    return g.select(
        cascade(facets, "all").alias("facet"), cascade([(cond, F.col(c).cast("string")) for cond, c in facets]).alias("value"), "n"
    )


def accuracy(answers: DataFrame, task: str = "task_type", predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """task (null: all), n, accuracy."""
    hit = F.when(answer_matches(F.col(predicted), F.col(truth)), 1.0).otherwise(0.0)
    return answers.rollup(task).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def with_annotations(manifest: DataFrame, annotations: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The manifest with annotated values in place of its own."""
    a = annotations.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    df = manifest.join(a, key, "left")
    return df.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in manifest.columns])


def reflectance_byte(x: Column, top: float = 4000.0) -> Column:
    """Reflectance clipped to 0..top as 0-255."""
    return byte(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(top)) / top * 255).cast("double"))


def percentile_stretch(pixels: DataFrame, by: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``stretched`` (0-255) between two percentiles of each group.

    The cut values are a small table, which the planner broadcasts if its size
    allows that; pixels aren't shuffled for them then.
    """
    cuts = as_table(linear_percentiles(pixels, by, value, {"__lo": low, "__hi": high}), "cuts")
    df = pixels.join(cuts, by)
    x = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 255
    return df.withColumn("stretched", F.when(F.col("__hi") > F.col("__lo"), byte(x)).otherwise(F.lit(0.0))).drop("__lo", "__hi")


def band_pixels(patches: DataFrame, key: str) -> DataFrame:
    """key, band, side, x, y, value from bands (band, side, values row by row)."""
    each = patches.select(key, "band", "side", F.posexplode("values").alias("__k", "value"))
    return each.select(key, "band", "side", (F.col("__k") % F.col("side")).alias("x"), F.floor(F.col("__k") / F.col("side")).alias("y"), F.col("value").cast("double").alias("value"))


def stack_bands(patches: DataFrame, key: str, order: list[str], size: int = 120) -> DataFrame:
    """key, missing, stack (bands x rows x columns): the bands (band, side,
    values row by row) of each patch on one grid, by cubic interpolation where
    they are coarser.  A patch that lacks a band has its names in ``missing``
    and no stack.  Rows of an array are gathered first, then bands, then
    patches, so a group is an image at most."""
    wanted = patches.where(F.col("band").isin(order))
    pixels = band_pixels(wanted, key)
    fine = pixels.where(F.col("side") == size).select(key, "band", "x", "y", "value")
    coarse = resample(pixels.where(F.col("side") != size), (F.col("side"), F.col("side")), (size, size), [key, "band"], kernel="cubic")

    def listed(df: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v"))))
        return df.groupBy(*by).agg(F.transform(items, lambda s: s["v"]).alias(value))

    rows = listed(fine.unionByName(coarse), [key, "band", "y"], "x", "value")
    bands = listed(rows, [key, "band"], "y", "value").withColumn("place", F.array_position(F.lit(order), F.col("band")))
    stacks = listed(bands, [key], "place", "value").withColumnRenamed("value", "stack")
    lacking = wanted.groupBy(key).agg(F.array_except(F.lit(order), F.collect_set("band")).alias("missing"))
    every = patches.select(key).distinct().join(lacking, key, "left").withColumn("missing", F.coalesce("missing", F.lit(order)))
    return every.join(stacks, key, "left").select(key, "missing", F.when(F.size("missing") == 0, F.col("stack")).alias("stack"))
