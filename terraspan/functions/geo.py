"""Affine transforms, projections, areas and boxes as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.rules import cascade, has, let
from terraspan.lineage import as_table, spread

#: WGS84 and UTM.
RADIUS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
FALSE_EASTING, FALSE_NORTHING = 500000.0, 10000000.0


def pixel_to_projected(x: Column, y: Column, t: Column) -> Column:
    """struct(x, y) by a six-parameter transform; null without one."""
    return F.when(
        F.size(t) >= 6,
        F.struct(
            (F.get(t, F.lit(0)) + x * F.get(t, F.lit(1)) + y * F.get(t, F.lit(2))).alias("x"),
            (F.get(t, F.lit(3)) + x * F.get(t, F.lit(4)) + y * F.get(t, F.lit(5))).alias("y"),
        ),
    )


def projected_to_pixel(px: Column, py: Column, t: Column, places: int = 2) -> Column:
    """The inverse; null where the determinant is below 1e-12."""
    g = [F.get(t, F.lit(k)) for k in range(6)]
    det = g[1] * g[5] - g[2] * g[4]
    return F.when(
        (F.size(t) >= 6) & (F.abs(det) >= 1e-12),
        F.struct(
            F.round((g[5] * (px - g[0]) - g[2] * (py - g[3])) / det, places).alias("x"),
            F.round((g[1] * (py - g[3]) - g[4] * (px - g[0])) / det, places).alias("y"),
        ),
    )


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    lat = 2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2
    return F.degrees(x / RADIUS), F.degrees(lat)


def utm_to_wgs84(x: Column, y: Column, zone: Column, south: Column, fourth_term: bool = True) -> Column:
    """struct(lng, lat) by the footpoint-latitude series; without
    ``fourth_term`` the series for the latitude stops at sin 6mu."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    root = math.sqrt(1 - e2)
    n = (1 - root) / (1 + root)
    series = [1.5 * n - 27 / 32 * n**3, 21 / 16 * n**2 - 55 / 32 * n**4, 151 / 96 * n**3, 1097 / 512 * n**4]

    def footpoint(mu: Column) -> Column:
        foot = mu
        for k, c in enumerate(series if fourth_term else series[:3], start=1):
            foot = foot + c * F.sin(mu * (2 * k))
        return let(foot, parts)

    def parts(foot: Column) -> Column:
        w = 1 - e2 * F.sin(foot) * F.sin(foot)
        across = RADIUS / F.sqrt(w)
        return let(
            F.struct(
                foot.alias("foot"), across.alias("across"), (RADIUS * (1 - e2) / F.pow(w, F.lit(1.5))).alias("along"),
                (F.tan(foot) * F.tan(foot)).alias("t"), (ep2 * F.cos(foot) * F.cos(foot)).alias("c"),
                ((x - FALSE_EASTING) / (across * SCALE)).alias("d"),
            ),
            place,
        )

    def place(p: Column) -> Column:
        t, c, d = p["t"], p["c"], p["d"]
        lat = p["foot"] - p["across"] * F.tan(p["foot"]) / p["along"] * (
            d * d / 2
            - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24
            + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, F.lit(6.0)) / 720
        )
        lng = (
            d
            - (1 + 2 * t + c) * F.pow(d, F.lit(3.0)) / 6
            + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5.0)) / 120
        ) / F.cos(p["foot"])
        return F.struct(((zone - 1) * 6 - 177 + F.degrees(lng)).alias("lng"), F.degrees(lat).alias("lat"))

    north = y - F.when(south, FALSE_NORTHING).otherwise(0.0)
    return let(north / (SCALE * RADIUS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)), footpoint)


def to_wgs84(x: Column, y: Column, epsg: Column, profile: str = "archive", places: int = 6) -> Column:
    """struct(lng, lat) for EPSG 4326, 3857/900913 and UTM; null for any other.

    Profiles: ``archive`` uses four terms of the latitude series, ``evidence``
    three.
    """
    south = epsg.between(32701, 32760)
    utm = south | epsg.between(32601, 32660)
    zone = F.when(south, epsg - 32700).otherwise(epsg - 32600)
    mlng, mlat = mercator_to_wgs84(x, y)

    def pair(lng: Column, lat: Column) -> Column:
        return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))

    def rounded(p: Column) -> Column:
        return pair(F.round(p["lng"], places), F.round(p["lat"], places))

    return (
        F.when(epsg == 4326, pair(x, y))
        .when(epsg.isin(3857, 900913), pair(F.round(mlng, places), F.round(mlat, places)))
        .when(utm, let(utm_to_wgs84(x, y, zone, south, profile == "archive"), rounded))
    )


def bounds_of(width: Column, height: Column, t: Column, epsg: Column) -> Column:
    """Bounds of a raster: projected from its four corners, geographic from
    the smallest and largest corner."""
    zero = F.lit(0)
    corners = [pixel_to_projected(a, b, t) for a, b in ((zero, zero), (width, zero), (width, height), (zero, height))]
    box = F.struct(
        F.least(*[c["x"] for c in corners]).alias("min_x"), F.least(*[c["y"] for c in corners]).alias("min_y"),
        F.greatest(*[c["x"] for c in corners]).alias("max_x"), F.greatest(*[c["y"] for c in corners]).alias("max_y"),
    )

    def geographic(b: Column) -> Column:
        low, high = to_wgs84(b["min_x"], b["min_y"], epsg), to_wgs84(b["max_x"], b["max_y"], epsg)
        return let(
            F.struct(low.alias("low"), high.alias("high")),
            lambda c: F.struct(
                *[b[k].alias(k) for k in ("min_x", "min_y", "max_x", "max_y")],
                F.least(c["low"]["lng"], c["high"]["lng"]).alias("min_lng"), F.least(c["low"]["lat"], c["high"]["lat"]).alias("min_lat"),
                F.greatest(c["low"]["lng"], c["high"]["lng"]).alias("max_lng"), F.greatest(c["low"]["lat"], c["high"]["lat"]).alias("max_lat"),
            ),
        )

    return F.when((F.size(t) >= 6) & (width > 0) & (height > 0), let(box, geographic))


def ground_area(pixels: Column, res_x: Column, res_y: Column, epsg: Column) -> Column:
    """struct(status, m2, ha, km2, reason); refused for no pixels, no
    resolution, or degrees (EPSG 4326 or both resolutions below 0.01)."""
    rx, ry = F.abs(res_x), F.abs(res_y)
    missing = rx.isNull() | ry.isNull() | (rx == 0) | (ry == 0)
    degrees = F.coalesce(epsg == 4326, F.lit(False)) | ((rx < 0.01) & (ry < 0.01))
    reason = cascade([(pixels.isNull() | (pixels <= 0), "NO_PIXELS"), (missing, "NO_RESOLUTION"), (degrees, "ANGULAR_UNITS")])
    m2 = F.when(reason.isNull(), pixels * rx * ry)
    return F.struct(
        F.when(reason.isNull(), F.lit("CALCULATED")).otherwise(F.lit("AREA_UNAVAILABLE")).alias("status"),
        F.round(m2, 1).alias("m2"), F.round(m2 / 1e4, 3).alias("ha"), F.round(m2 / 1e6, 4).alias("km2"), reason.alias("reason"),
    )


def region_area(pixels: Column, res_x: Column, res_y: Column, crs: Column) -> Column:
    """Square metres of a change region; only in northern UTM."""
    ok = has(crs, "EPSG:326") & (res_x > 0) & (res_y > 0)
    return F.when(F.coalesce(ok, F.lit(False)), F.floor(pixels * res_x * res_y + 0.5).cast("double"))


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """struct(intersection, union, iou, pct_a, pct_b) of boxes given as
    (min x, min y, max x, max y)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area_a, area_b = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    meet = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    whole = F.when(meet > 0, F.greatest(F.lit(1e-9), area_a + area_b - meet)).otherwise(area_a + area_b)
    return F.struct(
        F.round(meet, 6).alias("intersection"), F.round(whole, 6).alias("union"),
        F.round(F.when(meet > 0, meet / whole).otherwise(F.lit(0.0)), 4).alias("iou"),
        F.round(F.when((meet > 0) & (area_a > 0), meet / area_a * 100).otherwise(F.lit(0.0)), 1).alias("pct_a"),
        F.round(F.when((meet > 0) & (area_b > 0), meet / area_b * 100).otherwise(F.lit(0.0)), 1).alias("pct_b"),
    )


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of footprints; 0 where a side is missing."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.coalesce(F.when(whole > 0, w * h / whole), F.lit(0.0))


def share_of_smaller(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    small = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when(small > 0, w * h / small).otherwise(F.lit(0.0))


def intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether closed boxes touch."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def _box(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


#: Boxes of the right side in a cell from which its work is split.
DENSE = 2048
#: Levels of cells: sides of 2**-30 to 2**60.
LEVELS = (-30, 60)


def _level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The smallest level whose cells are at least as wide as the box."""
    side = F.greatest(x1 - x0, y1 - y0)
    return F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.when(side > 0, F.ceil(F.log2(side))).otherwise(LEVELS[0]))).cast("int")


def _cells(level: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The cells of a level that a box lies in: four at most, if it is no wider."""
    size = F.pow(F.lit(2.0), level)
    along = [F.sequence(F.floor(a / size), F.floor(b / size)) for a, b in ((x0, x1), (y0, y1))]
    return F.flatten(F.transform(along[0], lambda x: F.transform(along[1], lambda y: F.struct(level.alias("z"), x.alias("x"), y.alias("y")))))


def bbox_join(left: DataFrame, right: DataFrame, prefix: tuple[str, str] = ("a_", "b_"), keys: Sequence[str] = (), merge: bool = False) -> DataFrame:
    """All pairs of touching boxes with equal ``keys``: an equi-join on cells,
    not a nested loop.

    Both sides have columns id, x0, y0, x1, y1 (after their prefix); boxes with
    a missing or reversed side touch nothing.  A box is at home in the cells
    of the level of its own size, four at most.  Of two boxes the larger one
    is met at home, so a box also looks at the cells around it of every larger
    level that occurs.  A pair is reported in one cell, that of the lower left
    corner of the boxes' intersection.  Cells in which many boxes are at home
    are split over several tasks; their number follows from a count.  ``merge``:
    neither side is broadcast, however small the planner takes it for.
    """
    sides, levels = [], []
    for df, p in ((left, prefix[0]), (right, prefix[1])):
        box = _box(p)
        df = df.where((box[0] <= box[2]) & (box[1] <= box[3])).withColumn(f"__z{p}", _level(*box))
        sides.append(df)
        levels.append({r[0] for r in df.select(f"__z{p}").distinct().collect()})  # of 91 at most
    a, b = _box(prefix[0]), _box(prefix[1])
    za, zb = F.col(f"__z{prefix[0]}"), F.col(f"__z{prefix[1]}")
    found = []
    for home, away, z, other, own in ((sides[1], sides[0], zb, za, 1), (sides[0], sides[1], za, zb, 0)):
        box, guest = (b, a) if own else (a, b)
        there = sorted(levels[own])
        # the right side is home to pairs of one level
        larger = F.filter(F.array(*[F.lit(x) for x in there]).cast("array<int>"), lambda x: x >= other if own else x > other)
        housed = home.withColumn("__cell", F.explode(_cells(z, *box)))
        visits = away.withColumn("__at", F.explode(larger)).withColumn("__cell", F.explode(_cells(F.col("__at"), *guest))).drop("__at")
        parts = housed.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > DENSE)
        parts = parts.select("__cell", F.ceil(F.col("__n") / DENSE).cast("int").alias("__parts"))
        housed = housed.join(parts, "__cell", "left").withColumn("__part", F.pmod(F.xxhash64(*box), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
        visits = visits.join(parts, "__cell", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
        housed = housed.withColumnsRenamed({"__cell": "__home", "__part": "__hpart"})
        same = (F.col("__cell") == F.col("__home")) & (F.col("__part") == F.col("__hpart"))
        for k in keys:
            same = same & (F.col(f"{prefix[0]}{k}") == F.col(f"{prefix[1]}{k}"))
        size = F.pow(F.lit(2.0), F.col("__cell.z"))
        first = (F.col("__cell.x") == F.floor(F.greatest(a[0], b[0]) / size)) & (F.col("__cell.y") == F.floor(F.greatest(a[1], b[1]) / size))
        pairs = visits.join(housed.hint("merge") if merge else housed, same).where(intersects(a, b) & first)
        found.append(pairs.select(*left.columns, *right.columns))
    return found[0].unionByName(found[1])


def touching(left: DataFrame, right: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """kind, a, b: all pairs of touching boxes (id, x0, y0, x1, y1) of two tables
    without a row per pair of copies: PAIR with the smallest ids of the equal
    boxes that touch, and for every row its kind, the smallest id of its box
    and its own id."""
    box, alike, members = ["x0", "y0", "x1", "y1"], [], []
    for df, p, kind in zip((left, right), ("a_", "b_"), kinds, strict=True):
        first = as_table(df.groupBy(*box).agg(F.min("id").alias("id")), "alike")
        alike.append(first.select(*[F.col(c).alias(p + c) for c in first.columns]))
        same = [df[c].eqNullSafe(first[c]) for c in box]
        members.append(df.join(first, same).select(F.lit(kind).alias("kind"), first["id"].alias("a"), df["id"].alias("b")))
    pairs = bbox_join(*alike).select(F.lit("PAIR").alias("kind"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs.unionByName(members[0]).unionByName(members[1])


#: Ids of a list of equal boxes, about.
LISTED = 1024


def touching_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: the ids of all pairs of touching boxes (id, x0, y0, x1, y1) of two
    tables.  Equal boxes of the left one are joined once, as lists of their ids,
    and make their pairs behind the join; many equal boxes are several lists."""
    box = ["x0", "y0", "x1", "y1"]
    whole = left.where("x0 <= x1 AND y0 <= y1").select("id", *box)
    counts = whole.groupBy(*box).agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("__parts"))
    dealt = whole.join(counts, box).withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int"))
    lists = as_table(dealt.groupBy(*box, "__part").agg(F.collect_list("id").alias("ids")).drop("__part"), "lists")
    a, b = (df.select(*[F.col(c).alias(p + c) for c in (name, *box)]) for df, name, p in ((lists, "ids", "a_"), (right, "id", "b_")))
    return bbox_join(a, b).select(F.explode("a_ids").alias("a"), F.col("b_id").alias("b"))


#: Pairs of boxes that are compared at once.
AT_ONCE = 1 << 16


def share_sums(boxes: DataFrame, least: float, keys: Sequence[str] = (), apart: str | None = None) -> DataFrame:
    """id, n, total, own: what the boxes (id: long, x0, y0, x1, y1, n, total)
    with equal ``keys`` whose intersection is at least ``least`` of the smaller
    area add up to; ``own`` says that the box itself is among them.  Two boxes
    with ``apart`` don't count.

    Cells as for ``bbox_join``: a box visits the cells of its own and every
    larger level, a pair counts for both in one cell.  Boxes of a cell are
    compared in numpy, some thousand pairs at once; no row is made per pair.
    """
    box = _box("")
    cell = ["__z", "__x", "__y", *keys]
    df = boxes.where((box[0] <= box[2]) & (box[1] <= box[3])).select("id", *box, "n", "total", *keys, (F.col(apart) if apart else F.lit(False)).alias("__apart"), _level(*box).alias("__own"))
    there = sorted(r[0] for r in df.select("__own").distinct().collect())  # of 91 at most
    if not there:
        return boxes.sparkSession.createDataFrame([], _SUMS)
    larger = F.filter(F.array(*[F.lit(x) for x in there]).cast("array<int>"), lambda x: x >= F.col("__own"))
    each = df.withColumn("__at", F.explode(larger)).withColumn("__cell", F.explode(_cells(F.col("__at"), *box)))
    visits = each.select("*", F.col("__at").alias("__z"), F.col("__cell.x").alias("__x"), F.col("__cell.y").alias("__y")).drop("__at", "__cell")
    housed = visits.where("__z = __own")
    parts = as_table(housed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / DENSE).cast("int").alias("__parts")).where("__parts > 1"), "cells")  # few: the planner knows their size
    known = F.coalesce("__parts", F.lit(1))
    housed = housed.join(parts, cell, "left").withColumn("__part", F.pmod(F.xxhash64("id"), known).cast("int"))
    visits = visits.join(parts, cell, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), known - 1)))
    names = [*cell, "__part", "__visits", "id", "x0", "y0", "x1", "y1", "n", "total", "__apart", "__own"]
    rows = housed.withColumn("__visits", F.lit(False)).select(*names).unionByName(visits.withColumn("__visits", F.lit(True)).select(*names))
    place = [*cell, "__part"]
    ordered = rows.repartition(spread(boxes.sparkSession), *place).sortWithinPartitions(*place, "__visits")
    width = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, sums = None, None, None  # of the cell at hand

        def columns(batch):
            at = dict(zip(names, batch.columns, strict=True))
            out = {c: at[c].to_numpy(zero_copy_only=False) for c in names[width:]}
            out["area"] = (out["x1"] - out["x0"]) * (out["y1"] - out["y0"])
            return out

        def meet(v, lo, z):
            """Adds up n, total and own of the visits, and what homes of a larger level get."""
            n, total, own = np.zeros(len(v["id"]), np.int64), np.zeros(len(v["id"]), np.int64), np.zeros(len(v["id"]), bool)
            step = max(1, AT_ONCE // max(1, len(home["id"])))
            for k in range(0, len(n), step):
                p = {c: x[k : k + step, None] for c, x in v.items()}
                x, y = np.maximum(p["x0"], home["x0"]), np.maximum(p["y0"], home["y0"])
                w, h, small = np.minimum(p["x1"], home["x1"]) - x, np.minimum(p["y1"], home["y1"]) - y, np.minimum(p["area"], home["area"])
                hit = (w > 0) & (h > 0) & (small > 0) & (x >= lo[0]) & (y >= lo[1])  # the intersection's corner is in the cell
                hit &= np.divide(w * h, small, out=np.zeros_like(w), where=small > 0) >= least
                if apart:
                    hit &= ~(p["__apart"] & home["__apart"])
                r, c = np.nonzero(hit)
                np.add.at(n, r + k, home["n"][c])
                np.add.at(total, r + k, home["total"][c])
                own[r[v["id"][r + k] == home["id"][c]] + k] = True
                m = v["__own"][r + k] < z
                r, c = r[m] + k, c[m]
                np.add.at(sums[0], c, v["n"][r])
                np.add.at(sums[1], c, v["total"][r])
            return v["id"], n, total, own

        def batch_of(found):
            ids, n, total, own = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = n > 0
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, n, total, own)], ["id", "n", "total", "own"])

        for batch in batches:
            if not batch.num_rows:
                continue
            every, found = columns(batch), []
            ids = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]]
            new = np.zeros(batch.num_rows, bool)
            for x in (*ids, every["__visits"]):
                new[1:] |= x[1:] != x[:-1]
            starts = [0, *np.flatnonzero(new), batch.num_rows]
            for i, j in zip(starts, starts[1:], strict=False):
                key = tuple(x[i] for x in ids)
                some = {c: x[i:j] for c, x in every.items()}
                if key != group:
                    if home is not None:
                        found.append((home["id"], *sums, np.zeros(len(home["id"]), bool)))
                    group, home, sums = key, None, None
                if not every["__visits"][i]:
                    home = some if home is None else {c: np.concatenate([x, some[c]]) for c, x in home.items()}
                    sums = np.zeros(len(home["id"]), np.int64), np.zeros(len(home["id"]), np.int64)
                elif home is not None:
                    size = 2.0 ** float(key[0])
                    found.append(meet(some, (key[1] * size, key[2] * size), key[0]))
            if found:
                yield batch_of(found)
        if home is not None:
            yield batch_of([(home["id"], *sums, np.zeros(len(home["id"]), bool))])

    return ordered.mapInArrow(run, _SUMS).groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("own").alias("own"))


_SUMS = "id long, n long, total long, own boolean"


def meetings(boxes: DataFrame, keys: Sequence[str] = ()) -> int:
    """The pairs (x0, y0, x1, y1) that ``bbox_join`` of a table with itself
    looks at, about, from counts by cell; none is made."""
    box = _box("")
    df = boxes.where((box[0] <= box[2]) & (box[1] <= box[3])).select(*keys, *box).withColumn("__z", _level(*box))
    there = sorted(r[0] for r in df.select("__z").distinct().collect())  # of 91 at most
    larger = F.filter(F.array(*[F.lit(x) for x in there]).cast("array<int>"), lambda x: x >= F.col("__z"))
    housed = df.select(*keys, F.explode(_cells(F.col("__z"), *box)).alias("__cell")).groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("n"))
    visits = df.withColumn("__at", F.explode(larger)).select(*keys, F.explode(_cells(F.col("__at"), *box)).alias("__cell")).groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("m"))
    found = housed.join(visits, [*keys, "__cell"]).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    return int(2 * (found or 0))


#: Words of a label that allow a box over the whole image.
WHOLE_WORDS = ["entire", "full", "whole", "scene"]


def check_box(ymin: Column, xmin: Column, ymax: Column, xmax: Column, label: Column, mode: str = "strict",
              width: Column | None = None, height: Column | None = None) -> Column:
    """struct(ymin, xmin, ymax, xmax, label, reason) on the 0-1 scale; reason
    is null for an accepted box, the numbers null for a rejected one.

    ``strict``: 0-1000 only.  ``clamp``: 0-1 is scaled up, 0-1000 clamped,
    area 0.0001 to 0.95.  ``evidence``: 0-1 or 0-1000, no negative numbers,
    area below 0.90, at least four pixels of the image.
    """
    box = [ymin, xmin, ymax, xmax]
    name = F.trim(label)
    no_name = F.coalesce(name == "", F.lit(True))
    missing = F.lit(False)
    for c in box:
        missing = missing | c.isNull()
    unit = (F.greatest(*box) <= 1.0) & (F.greatest(ymax, xmax) > 0)
    if mode == "strict":
        n = [c / 1000 for c in box]
        rules = [(missing, "NOT_A_BOX"), (no_name, "NO_LABEL"), ((F.least(*box) < 0) | (F.greatest(*box) > 1000), "OUT_OF_RANGE")]
    elif mode == "clamp":
        scaled = [F.when(unit, F.floor(c * 1000 + 0.5)).otherwise(c) for c in box]
        n = [F.least(F.lit(1000.0), F.greatest(F.lit(0.0), c)) / 1000 for c in scaled]
        rules = [(missing, "NOT_A_BOX"), (no_name, "NO_LABEL")]
    else:
        n = [F.when(unit, c).otherwise(c / 1000) for c in box]
        rules = [(missing, "NOT_A_BOX"), (F.least(*box) < 0, "NEGATIVE"), (F.greatest(*box) > 1000, "OUT_OF_RANGE")]
    rules.append(((n[0] >= n[2]) | (n[1] >= n[3]), "EMPTY"))
    area = (n[2] - n[0]) * (n[3] - n[1])
    words = F.lower(F.coalesce(name, F.lit("")))
    if mode == "clamp":
        rules += [(area < 0.0001, "TOO_SMALL"), ((area > 0.95) & ~has(words, *WHOLE_WORDS, "clamped"), "WHOLE_IMAGE")]
    if mode == "evidence":
        rules.append(((area >= 0.90) & ~has(words, *WHOLE_WORDS), "WHOLE_IMAGE"))
        if width is not None and height is not None:
            px = F.greatest(F.lit(1), F.floor(n[3] * width + 0.5) - F.floor(n[1] * width + 0.5))
            py = F.greatest(F.lit(1), F.floor(n[2] * height + 0.5) - F.floor(n[0] * height + 0.5))
            rules.append((px * py < 4, "TOO_SMALL"))
        name = F.when(no_name, F.lit("Unlabeled Region")).otherwise(name)
    reason = cascade(rules)
    return F.struct(
        *[F.when(reason.isNull(), F.round(c, 4)).alias(k) for c, k in zip(n, ("ymin", "xmin", "ymax", "xmax"), strict=True)],
        F.when(reason.isNull(), name).alias("label"), reason.alias("reason"),
    )
