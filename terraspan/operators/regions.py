"""Connected regions of change masks, tile by tile, and their grading.

A mask is a table of set pixels.  Each tile of a scene is labelled on its own,
as runs of pixels in rows; runs that touch across a tile's border link their
labels, and connected labels are one region.  So no task holds more than a
tile, however large the scene or the region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.functions.rules import cascade
from terraspan.lineage import as_table
from terraspan.operators.graph import connected

#: Side of a tile in pixels.
TILE = 512
#: A pixel's place in row order is y * ROW + x.
ROW = 1 << 31


def runs_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of the runs of neighbours in rows, for pixels in
    row order."""
    new = np.ones(len(x) + 1, bool)
    new[1:-1] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    edges = np.flatnonzero(new)
    return edges[:-1], edges[1:] - 1


def label_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each run (row, first and last column, in row order) the place of the
    first run of its 4-connected region."""
    n, width = len(y), int(x1.max(initial=0)) + 2
    starts, ends = y * width + x0, y * width + x1
    # runs of the row above that share a column
    low, high = np.searchsorted(ends, starts - width, "left"), np.searchsorted(starts, ends - width, "right")
    count = np.maximum(high - low, 0)
    below = np.repeat(np.arange(n), count)
    above = np.repeat(low, count) + np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(n)
    while True:
        a, b = root[below], root[above]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]


def tile_runs(mask: DataFrame, scene: str = "scene", tile: int = TILE) -> DataFrame:
    """scene, y, x0, x1, label, pixels, total, most, deltas: the runs of each
    tile with what they sum up.  ``label`` is the place of the first pixel of
    the region within the tile."""
    kind = mask.schema[scene].dataType.simpleString()
    rows = mask.where(F.col(scene).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        scene, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce(F.col("delta").cast("double"), F.lit(0.0)).alias("delta")
    )
    rows = rows.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def run(table: pa.Table) -> pa.Table:
        x, y, delta = (table[c].to_numpy() for c in ("x", "y", "delta"))
        order = np.lexsort((delta, x, y))
        x, y, delta = x[order], y[order], delta[order]
        last = np.append((x[1:] != x[:-1]) | (y[1:] != y[:-1]), True)  # of rows for one pixel the largest
        x, y, delta = x[last], y[last], delta[last]
        first, end = runs_of(x, y)
        root = label_runs(y[first] - y[0], x[first] - x.min(), x[end] - x.min())
        offsets = np.append(first, len(x)).astype(np.int32)
        return pa.table({
            scene: pa.array([table[scene][0].as_py()] * len(first), table[scene].type), "y": y[first], "x0": x[first], "x1": x[end],
            "label": (y[first] * ROW + x[first])[root], "pixels": end - first + 1, "total": np.add.reduceat(delta, first),
            "most": np.maximum.reduceat(delta, first), "deltas": pa.ListArray.from_arrays(pa.array(offsets), pa.array(delta)),
        })

    out = f"{scene} {kind}, y long, x0 long, x1 long, label long, pixels long, total double, most double, deltas array<double>"
    return rows.groupBy(scene, "tx", "ty").applyInArrow(run, out)


def border_links(runs: DataFrame, scene: str = "scene", tile: int = TILE) -> DataFrame:
    """a, b (scene and label): labels that touch across a border of tiles.
    Only pixels on borders are compared, so rows grow with the borders."""
    node = F.struct(scene, "label")
    left = runs.where(F.pmod(F.col("x1") + 1, F.lit(tile)) == 0).select(scene, "y", (F.col("x1") + 1).alias("x"), node.alias("a"))
    right = runs.where(F.pmod("x0", F.lit(tile)) == 0).select(scene, "y", F.col("x0").alias("x"), node.alias("b"))
    each = F.explode(F.sequence("x0", "x1")).alias("x")
    upper = runs.where(F.pmod(F.col("y") + 1, F.lit(tile)) == 0).select(scene, (F.col("y") + 1).alias("y"), each, node.alias("a"))
    lower = runs.where(F.pmod("y", F.lit(tile)) == 0).select(scene, "y", each, node.alias("b"))
    beside, under = left.join(right, [scene, "y", "x"]), upper.join(lower, [scene, "y", "x"])
    return beside.select("a", "b").unionByName(under.select("a", "b")).distinct()


def region_runs(mask: DataFrame, scene: str = "scene", tile: int = TILE) -> DataFrame:
    """The runs of a mask (scene, x, y, delta) with their ``region``: the place
    (y * ROW + x) of its first pixel in row order.

    Rows without scene, x or y are left out, a missing delta counts as 0, and
    of several rows for a pixel the one of the largest delta counts.
    """
    runs = as_table(tile_runs(mask, scene, tile), "runs")
    groups = connected(border_links(runs, scene, tile)).select(f"node.{scene}", "node.label", F.col("group.label").alias("region"))
    return runs.join(groups, [scene, "label"], "left").withColumn("region", F.coalesce("region", "label"))


def components(mask: DataFrame, scene: str = "scene", tile: int = TILE) -> DataFrame:
    """scene, x, y, delta, region: the pixels of a mask with their region."""
    each = region_runs(mask, scene, tile).select(scene, "y", "x0", "region", F.posexplode("deltas").alias("k", "delta"))
    return each.select(scene, (F.col("x0") + F.col("k")).cast("int").alias("x"), F.col("y").cast("int").alias("y"), "delta", "region")


def graded(pixels: Column, density: Column) -> Column:
    return cascade([((pixels >= 100) & (density >= 0.40), "STRONG"), (pixels >= 40, "MODERATE")], "WEAK")


def meaning(pixels: Column, density: Column, w: Column, h: Column) -> Column:
    return cascade([((density > 0.45) & (pixels > 80), "CONSTRUCTION"), ((w > 3 * h) | (h > 3 * w), "ROAD_DEVELOPMENT")], "VEGETATION_CHANGE")


def region_table(runs: DataFrame, scene: str = "scene", least: int = 15) -> DataFrame:
    """One row per region of at least ``least`` pixels, from ``region_runs``."""
    g = runs.groupBy(scene, "region").agg(
        F.sum("pixels").alias("pixels"), F.min("x0").cast("int").alias("min_x"), F.max("x1").cast("int").alias("max_x"), F.min("y").cast("int").alias("min_y"),
        F.max("y").cast("int").alias("max_y"), F.sum("total").alias("total"), F.max("most").alias("max_delta"),
    ).where(F.col("pixels") >= least)
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    g = g.withColumns({"mean_delta": F.col("total") / F.col("pixels"), "density": F.round(F.col("pixels") / (w * h), 3)}).drop("total")
    return g.withColumns({
        "coherence": graded(F.col("pixels"), F.col("density")), "meaning": meaning(F.col("pixels"), F.col("density"), w, h),
    })


def change_metrics(deltas: DataFrame, by: list[str], delta: str = "delta", threshold: float = 30.0) -> DataFrame:
    """Changed share in per cent, mean and largest delta of each scene."""
    d = F.col(delta)
    return deltas.groupBy(*by).agg(
        (F.avg(F.when(d >= threshold, 1.0).otherwise(0.0)) * 100).alias("changed_pct"), F.avg(d).alias("mean_delta"), F.max(d).alias("max_delta"),
    )


def largest(table: DataFrame, n: int | None = None) -> DataFrame:
    """Regions by pixels, largest first; ties in row order."""
    ordered = table.orderBy(F.col("pixels").desc(), "region")
    return ordered.limit(n) if n is not None else ordered


def first_in_scan(table: DataFrame, n: int = 8, scene: str = "scene") -> DataFrame:
    """The first regions of each scene in row order, whatever their size."""
    place = F.row_number().over(W.partitionBy(scene).orderBy("region"))
    return table.withColumn("place", place).where(F.col("place") <= n)
