"""Procedural demo rasters, generated in parallel."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.rules import cascade

SIDE, KINDS = 128, 6


def demo_pixels(scenes: DataFrame) -> DataFrame:
    """scene, x, y, r, g, b of a demo raster for each row of ``scenes`` (scene,
    and kind: 0 to 5): fields, a road, water, a harbour, built-up blocks and
    speckle."""
    rows = scenes.select("scene", "kind", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"))
    base = rows.select("scene", "kind", "y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x"))
    x, y, s = F.col("x"), F.col("y"), F.col("kind")
    water = (s == 3) & (x > 70) | (s == 5) & (y > 80)
    built = (s.isin(1, 5)) & (x % 16 > 4) & (y % 16 > 4) & (x < 64)
    road = F.abs(x - y) < 3
    noise = F.pmod(x * 37 + y * 73 + s * 11, F.lit(40))
    return base.withColumns({
        "r": cascade([(water, F.lit(20.0)), (built, F.lit(190.0)), (road, F.lit(120.0))], (noise + 60).cast("double")),
        "g": cascade([(water, F.lit(40.0)), (built, F.lit(185.0)), (road, F.lit(118.0))], (noise + 90).cast("double")),
        "b": cascade([(water, F.lit(60.0)), (built, F.lit(180.0)), (road, F.lit(115.0))], (noise + 40).cast("double")),
    }).drop("kind")


def _little(x: Column, size: int) -> Column:
    """Hex digits of a number, least byte first."""
    return F.concat(*[F.lpad(F.hex(F.floor(x / 256**k).cast("long") % 256), 2, "0") for k in range(size)])


def _hexed(text: Column) -> Column:
    return F.hex(text.cast("binary"))


def tiff_bytes(width: Column, height: Column, bands: Column, bits: Column, sample_format: Column, epsg: Column, date_time: Column,
               scale: float = 10.0, origin: tuple[float, float] = (500000.0, 2000000.0)) -> Column:
    """A little-endian TIFF header with one directory and no pixels; nodata is
    -9999, ``date_time`` has 19 characters."""
    place = 8 + 2 + 10 * 12 + 4
    doubles = struct.pack("<3d6d", scale, scale, 0.0, 0.0, 0.0, 0.0, *origin, 0.0).hex().upper()
    entries = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (277, 3, 1, bands), (306, 2, 20, F.lit(place)), (339, 3, 1, sample_format),
        (33550, 12, 3, F.lit(place + 20)), (33922, 12, 6, F.lit(place + 44)), (34735, 3, 8, F.lit(place + 92)), (42113, 2, 6, F.lit(place + 108)),
    ]
    fields = [F.concat(_little(F.lit(tag), 2), _little(F.lit(kind), 2), _little(F.lit(n), 4), _little(value, 4)) for tag, kind, n, value in entries]
    keys = F.concat(*[_little(F.lit(x) if isinstance(x, int) else x, 2) for x in (1, 1, 0, 1, 3072, 0, 1, epsg)])
    parts = [F.lit("49492A0008000000"), _little(F.lit(len(entries)), 2), *fields, F.lit("00000000"), _hexed(date_time), F.lit("00"), F.lit(doubles), keys, F.lit("2D3939393900")]
    return F.unhex(F.concat(*parts))
