"""Resampling by joins with weights against dense numpy kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import resampling
from terraspan.operators import training


def dense(n, new, kernel):
    """The kernel of one axis as a matrix, place by place."""
    m = np.zeros((new, n))
    for i in range(new):
        if kernel == "box":
            lo, hi = i * n / new, (i + 1) * n / new
            for j in range(n):
                m[i, j] = max(0.0, min(j + 1, hi) - max(j, lo)) / (hi - lo)
            continue
        at = (i + 0.5) * n / new - 0.5
        for k in range(-3, 5):
            j = int(np.floor(at)) + k
            d = abs(at - j)
            if kernel == "bilinear":
                w = max(0.0, 1 - d)
            else:
                w = 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3 if d < 2 else 0.0
            m[i, min(n - 1, max(0, j))] += w
    return m


@pytest.mark.parametrize("kernel", resampling.KERNELS)
@pytest.mark.parametrize("grid", [(4, 3), (6, 5), (13, 17), (1, 1)])
def test_resample(spark, kernel, grid):
    rng = np.random.default_rng(1)
    images = {"a": rng.normal(size=(5, 6)), "b": rng.normal(size=(8, 3)), "c": rng.normal(size=(1, 1))}
    rows = [(s, x, y, float(v), *m.shape) for s, m in images.items() for (y, x), v in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "s string, x int, y int, v double, h int, w int").repartition(5)
    got = resampling.resample(df, (F.col("w"), F.col("h")), grid, ["s"], "v", kernel).collect()
    assert len(got) == len(images) * grid[0] * grid[1]
    for s, m in images.items():
        want = dense(m.shape[0], grid[1], kernel) @ m @ dense(m.shape[1], grid[0], kernel).T
        assert all(r.v == pytest.approx(want[r.y, r.x], abs=1e-9) for r in got if r.s == s)


def test_missing_pixels(spark):
    rows = [("s", x, y, None if (x, y) == (0, 0) else float(x + 10 * y)) for x in range(6) for y in range(4) if x < 4]
    df = spark.createDataFrame(rows, "s string, x int, y int, v double")
    got = {(r.x, r.y): r.v for r in resampling.resample(df, (F.lit(6), F.lit(4)), (3, 2), ["s"], "v").collect()}
    assert got == {(0, 0): (1 + 10.5) / 2, (1, 0): 7.5, (0, 1): 25.5, (1, 1): 27.5}  # row by row, then rows
    assert resampling.resample(df.limit(0), (F.lit(6), F.lit(4)), (3, 2), ["s"], "v").count() == 0
    with pytest.raises(ValueError, match="no kernel"):
        resampling.weights(spark.range(1).withColumnRenamed("id", "n"), 2, "sinc")


def test_stack_of_bands(spark):
    rng = np.random.default_rng(2)
    bands = {"B02": rng.normal(size=(12, 12)), "B05": rng.normal(size=(6, 6)), "B01": rng.normal(size=(2, 2))}
    rows = [(p, b, len(m), m.ravel().tolist()) for p in ("p", "q") for b, m in bands.items() if (p, b) != ("q", "B05")] + [("r", "XX", 1, [0.0])]
    df = spark.createDataFrame(rows, "patch string, band string, side int, values array<double>")
    got = {r.patch: r for r in training.stack_bands(df, "patch", ["B02", "B05", "B01"], 12).collect()}
    want = [bands["B02"], *(dense(n, 12, "cubic") @ bands[b] @ dense(n, 12, "cubic").T for b, n in (("B05", 6), ("B01", 2)))]
    assert np.allclose(np.array(got["p"].stack), np.array(want)) and got["p"].missing == []
    assert got["q"].missing == ["B05"] and got["q"].stack is None and got["r"].missing == ["B02", "B05", "B01"]


def test_pixels_are_shuffled_twice(spark):
    """Once to a row's new pixels and once to their columns, not for the
    weights nor for what a row gives to several new ones."""
    df = spark.range(384).select((F.col("id") % 2).alias("s"), (F.col("id") % 24).alias("x"), F.floor(F.col("id") / 24).alias("y"), F.col("id").cast("double").alias("v"))
    plan = resampling.resample(df, (F.lit(24), F.lit(16)), (40, 40), ["s"], "v", "cubic")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("BroadcastHashJoin") == 2
