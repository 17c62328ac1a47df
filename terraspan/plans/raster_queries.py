"""Raster queries; line items stand for pixels (quantity, price and discount
as bands, return flag as scene), orders for images."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions import raster, vectors
from terraspan.lineage import as_table
from terraspan.operators import regions, training
from terraspan.plans._base import query, table


def _pixels(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("scene"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"),
        (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2500).alias("g"), (F.col("l_tax") * 3000).alias("b"),
        (F.col("l_partkey") % 128).cast("int").alias("x"), (F.col("l_suppkey") % 128).cast("int").alias("y"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


PX = """p AS (SELECT l_returnflag AS scene, l_orderkey AS o, l_linenumber AS n, l_quantity AS q, l_quantity * 5 AS r, l_discount * 2500 AS g, l_tax * 3000 AS b,
 l_partkey % 128 AS x, l_suppkey % 128 AS y, l_extendedprice AS price, l_partkey AS part, l_suppkey AS supp, 0.299 * (l_quantity * 5) + 0.587 * (l_discount * 2500) + 0.114 * (l_tax * 3000) AS lum FROM lineitem)"""


@query(f"WITH {PX} SELECT scene, min(q) AS min, max(q) AS max, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std_dev, 100.0::DOUBLE AS valid_pct, count(*) AS n FROM p GROUP BY scene")
def agg_band_statistics(spark, sf):
    s = raster.band_statistics(_pixels(spark, sf), ["scene"], "q")
    return s.select("scene", "min", "max", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), "valid_pct", "n")


@query(f"""WITH {PX}, r AS (SELECT scene, q, row_number() OVER (PARTITION BY scene ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n FROM p)
SELECT scene, min(q) FILTER (WHERE i = floor(n * 0.05)) AS p5, min(q) FILTER (WHERE i = floor(n * 0.95)) AS p95 FROM r GROUP BY scene""")
def agg_sar_percentiles(spark, sf):
    return raster.floor_percentiles(_pixels(spark, sf), ["scene"], "q", {"p5": 0.05, "p95": 0.95})


@query(f"""WITH {PX}, s AS (SELECT scene, pow(avg(q) / stddev_pop(q), 2) AS enl FROM p GROUP BY scene)
SELECT scene, round(enl, 6) AS enl, CASE WHEN enl > 4 THEN 'LOW' WHEN enl > 1.8 THEN 'MODERATE' ELSE 'HIGH' END AS speckle,
 CASE WHEN enl > 4 THEN 'LOW' WHEN enl > 1.5 THEN 'MODERATE' ELSE 'HIGH' END AS legacy FROM s""")
def agg_enl(spark, sf):
    s = raster.band_statistics(_pixels(spark, sf), ["scene"], "q")
    e = raster.looks(F.col("mean"), F.col("std_dev"))
    return s.select("scene", F.round(e, 6).alias("enl"), raster.speckle(e).alias("speckle"), raster.speckle(e, "legacy").alias("legacy"))


@query(f"""WITH {PX}, m AS (SELECT *, lead(lum) OVER (PARTITION BY scene ORDER BY o, n, price, part, supp) AS nx FROM p)
SELECT scene, round(avg(lum), 6) AS mean_brightness, round(stddev_pop(lum), 6) AS std_brightness, round(max(lum) - min(lum), 6) AS contrast,
 round(avg((g > r + 15 AND g > b + 10)::INT), 6) AS vegetation, round(avg((lum < 45)::INT), 6) AS dark, round(avg((lum > 200)::INT), 6) AS bright,
 round(avg(coalesce(abs(lum - nx) > 35, false)::INT), 6) AS rough FROM m GROUP BY scene""")
def agg_image_metrics(spark, sf):
    p = _pixels(spark, sf).withColumn("i", F.struct("o", "n", "price", "part", "supp"))
    m = raster.image_metrics(p, ["scene"], "i")
    return m.select("scene", *[F.round(c, 6).alias(c) for c in ("mean_brightness", "std_brightness", "contrast", "vegetation", "dark", "bright", "rough")])


CLS = """k AS (SELECT scene, x, y, 'VEGETATION_CANDIDATE' AS category, g - r AS v FROM p WHERE g > r + 15 AND g > b + 10
 UNION ALL SELECT scene, x, y, 'WATER_CANDIDATE', lum FROM p WHERE lum < 45 AND abs(r - g) < 15 AND abs(g - b) < 15
 UNION ALL SELECT scene, x, y, 'BUILT_UP_CANDIDATE', lum FROM p WHERE lum > 180)"""


@query(f"""WITH {PX}, {CLS} SELECT scene, category, min(x)::INT AS xmin, max(x)::INT AS xmax, min(y)::INT AS ymin, max(y)::INT AS ymax, count(*) AS pixels, round(avg(v), 5) AS mean_value
FROM k GROUP BY scene, category HAVING count(*) >= 10 AND max(x) > min(x) AND max(y) > min(y)""")
def agg_class_regions(spark, sf):
    r = raster.class_regions(_pixels(spark, sf), ["scene"])
    return r.select("scene", "category", "xmin", "xmax", "ymin", "ymax", "pixels", F.round("mean_value", 5).alias("mean_value"))


@query(f"""WITH {PX}, r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY scene) AS n2 FROM p),
c AS (SELECT scene, min(q) FILTER (WHERE i = floor(n2 * 0.05)) AS p5, min(q) FILTER (WHERE i = floor(n2 * 0.95)) AS p95 FROM r GROUP BY scene),
k AS (SELECT scene, x, y, 'HIGH_BACKSCATTER_DOUBLE_BOUNCE' AS kind, p95 AS level FROM p JOIN c USING (scene) WHERE q >= p95
 UNION ALL SELECT scene, x, y, 'LOW_BACKSCATTER_SPECULAR', p5 FROM p JOIN c USING (scene) WHERE q <= p5)
SELECT scene, kind, level, min(x)::INT AS xmin, max(x)::INT AS xmax, min(y)::INT AS ymin, max(y)::INT AS ymax, count(*) AS pixels FROM k GROUP BY scene, kind, level
HAVING count(*) >= 10 AND max(x) > min(x) AND max(y) > min(y)""")
def agg_sar_regions(spark, sf):
    return raster.backscatter_regions(_pixels(spark, sf), ["scene"], "q").select("scene", "kind", "level", "xmin", "xmax", "ymin", "ymax", "pixels")


@query(f"""WITH {PX} SELECT scene, round(avg((r - g) / (r + g)), 6) AS mean, round(min((r - g) / (r + g)), 6) AS min, round(max((r - g) / (r + g)), 6) AS max, count(*) AS n
FROM p WHERE r + g > 1e-6 AND (r - g) / (r + g) BETWEEN -1 AND 1 GROUP BY scene""")
def ras_normalised_difference(spark, sf):
    p = _pixels(spark, sf).withColumn("v", raster.normalised_difference(F.col("r"), F.col("g"))).where("v IS NOT NULL")
    return p.groupBy("scene").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"), F.count("v").alias("n"))


@query(f"WITH {PX} SELECT o, n, round(lum, 6) AS lum, round(least(255, greatest(0, ln(1 + lum) * 45.0)), 6) AS sar, round((r / 255.0 - 0.485) / 0.229, 6) AS red FROM p")
def ras_pixel_arithmetic(spark, sf):
    lum = raster.luminance(F.col("r"), F.col("g"), F.col("b"))
    return _pixels(spark, sf).select("o", "n", F.round(lum, 6).alias("lum"), F.round(raster.log_intensity(lum), 6).alias("sar"), F.round(raster.standardised(F.col("r"), 0), 6).alias("red"))


@query(f"""WITH {PX}, s AS (SELECT *, min(price) OVER (PARTITION BY scene) AS lo, max(price) OVER (PARTITION BY scene) AS hi FROM p)
SELECT o, n, least(255, greatest(0, floor((price - lo) / (hi - lo) * 255 + 0.5)))::DOUBLE AS v FROM s""")
def ras_contrast_stretch(spark, sf):
    p = _pixels(spark, sf)
    lim = p.groupBy("scene").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    return p.join(lim, "scene").select("o", "n", raster.stretch(F.col("price"), F.col("lo"), F.col("hi")).alias("v"))


@query(f"""WITH {PX}, c AS (SELECT scene, quantile_cont(price, 0.02) AS lo, quantile_cont(price, 0.98) AS hi FROM p GROUP BY scene)
SELECT o, n, round(least(255, greatest(0, (price - lo) / (hi - lo) * 255)), 5) AS v FROM p JOIN c USING (scene)""")
def ras_percentile_stretch(spark, sf):
    return training.percentile_stretch(_pixels(spark, sf), ["scene"], "price").select("o", "n", F.round("stretched", 5).alias("v"))


@query(f"WITH {PX} SELECT o, n, least(255, greatest(0, r)) AS red, least(255, greatest(0, floor(least(greatest(price, 0), 4000) / 4000 * 255)))::DOUBLE AS refl FROM p")
def ras_color_composite(spark, sf):
    return _pixels(spark, sf).select("o", "n", raster.byte(F.col("r")).alias("red"), training.reflectance_byte(F.col("price")).alias("refl"))


@query("""SELECT p_partkey, list_filter_ AS flags FROM (SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN p_retailprice % 256 > 210 THEN 'OVEREXPOSED' END,
 CASE WHEN p_retailprice % 256 < 40 THEN 'UNDEREXPOSED' END, CASE WHEN p_size < 12 THEN 'LOW_CONTRAST' END] IF x IS NOT NULL], ',') AS list_filter_ FROM part)""")
def ras_exposure(spark, sf):
    f = raster.exposure(F.col("p_retailprice") % 256, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(f, ",").alias("flags"))


def _delta(spark, sf):
    """The three difference fields at the places of the line items."""
    li = table(spark, sf, "lineitem").select((F.col("l_partkey") % 128).alias("x"), (F.col("l_suppkey") % 128).alias("y"), F.col("l_returnflag").alias("flag"))
    x, y = F.col("x"), F.col("y")
    kinds = [("A", "expansion"), ("N", "seasonal")]
    delta = F.when(F.col("flag") == "A", raster.synthetic_delta(128, 128, x, y, "expansion")).when(F.col("flag") == "N", raster.synthetic_delta(128, 128, x, y, "seasonal"))
    kind = F.when(F.col("flag") == kinds[0][0], kinds[0][1]).when(F.col("flag") == kinds[1][0], kinds[1][1]).otherwise("noise")
    return li.select(kind.alias("kind"), delta.otherwise(raster.synthetic_delta(128, 128, x, y, "noise")).alias("delta"))


@query("""WITH g AS (SELECT l_returnflag AS flag, l_partkey % 128 AS x, l_suppkey % 128 AS y FROM lineitem),
d AS (SELECT CASE flag WHEN 'A' THEN 'expansion' WHEN 'N' THEN 'seasonal' ELSE 'noise' END AS kind, CASE flag
 WHEN 'A' THEN CASE WHEN x >= 64 AND x <= 128 * 0.92 AND y >= 128 * 0.45 AND y <= 128 * 0.92 THEN 68.0 + sin(x * 0.3) * cos(y * 0.3) * 12.0
  WHEN x >= 128 * 0.10 AND x <= 128 * 0.95 AND y >= 128 * 0.40 AND y <= 128 * 0.44 THEN 55.0 ELSE abs(sin(x * 0.1) * 3.0) END
 WHEN 'N' THEN 14.0 + sin(x * 0.05) * 5.0
 ELSE CASE WHEN (x * 37 + y * 73) % 100 > 85 THEN ((x * 37 + y * 73) % 100 - 85) * 2.0 ELSE 0 END END AS d FROM g)
SELECT kind, round(avg((d >= 30)::INT) * 100, 6) AS changed_pct, round(avg(d), 6) AS mean_delta, round(max(d), 6) AS max_delta FROM d GROUP BY kind""")
def agg_change_metrics(spark, sf):
    m = regions.change_metrics(_delta(spark, sf), ["kind"])
    return m.select("kind", *[F.round(c, 6).alias(c) for c in ("changed_pct", "mean_delta", "max_delta")])


#: Half of the places of each scene are set; a scene is as long as there are parts.
MASK = """m AS (SELECT l_linestatus AS scene, l_partkey::BIGINT AS x, (l_suppkey % 20)::BIGINT AS y, max(l_quantity) AS delta FROM lineitem WHERE l_quantity >= 6 GROUP BY ALL),
e AS (SELECT scene, x, y, x + 1 AS x2, y AS y2 FROM m UNION ALL SELECT scene, x, y, x - 1, y FROM m UNION ALL SELECT scene, x, y, x, y + 1 FROM m UNION ALL SELECT scene, x, y, x, y - 1 FROM m),
j AS (SELECT e.* FROM e JOIN m ON e.scene = m.scene AND e.x2 = m.x AND e.y2 = m.y),
r AS (SELECT scene, x, y, y * 2147483648 + x AS c FROM m UNION SELECT j.scene, j.x2, j.y2, r.c FROM r JOIN j ON r.scene = j.scene AND r.x = j.x AND r.y = j.y),
l AS (SELECT scene, x, y, min(c) AS c FROM r GROUP BY ALL),
t AS (SELECT scene, c AS region, count(*) AS pixels, min(x)::INT AS min_x, max(x)::INT AS max_x, min(y)::INT AS min_y, max(y)::INT AS max_y, round(avg(delta), 6) AS mean_delta, max(delta) AS max_delta
 FROM l JOIN m USING (scene, x, y) GROUP BY ALL)"""


def _mask(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity >= 6")
    return li.select(F.col("l_linestatus").alias("scene"), F.col("l_partkey").alias("x"), (F.col("l_suppkey") % 20).alias("y"), F.col("l_quantity").alias("delta"))


@query(f"WITH RECURSIVE {MASK} SELECT * FROM t WHERE pixels >= 15")
def gr_connected_regions(spark, sf):
    t = regions.region_table(regions.region_runs(_mask(spark, sf)))
    return t.select("scene", "region", "pixels", "min_x", "max_x", "min_y", "max_y", F.round("mean_delta", 6).alias("mean_delta"), "max_delta")


@query(f"WITH RECURSIVE {MASK} SELECT l.scene, l.x::INT AS x, l.y::INT AS y, delta, c AS region FROM l JOIN m USING (scene, x, y)")
def gr_region_pixels(spark, sf):
    """Every pixel with its region, over tiles small enough to cut many."""
    return regions.components(_mask(spark, sf), tile=16)


@query(f"""WITH RECURSIVE {MASK} SELECT 'largest' AS list, * FROM (SELECT scene, region, pixels, min_x, min_y FROM t WHERE pixels >= 2 ORDER BY pixels DESC, region LIMIT 5)
UNION ALL SELECT 'first', scene, region, pixels, min_x, min_y FROM t WHERE pixels >= 2 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY region) <= 8""")
def top_regions(spark, sf):
    t = as_table(regions.region_table(regions.region_runs(_mask(spark, sf)), least=2), "regions")
    cols = ["scene", "region", "pixels", "min_x", "min_y"]
    return regions.largest(t, 5).select(F.lit("largest").alias("list"), *cols).unionByName(regions.first_in_scan(t).select(F.lit("first").alias("list"), *cols))


@query(f"""WITH RECURSIVE {MASK}, d AS (SELECT *, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h, round(pixels::DOUBLE / ((max_x - min_x + 1) * (max_y - min_y + 1)), 3) AS density FROM t WHERE pixels >= 15)
SELECT scene, region, pixels, density, CASE WHEN pixels >= 100 AND density >= 0.4 THEN 'STRONG' WHEN pixels >= 40 THEN 'MODERATE' ELSE 'WEAK' END AS coherence,
 CASE WHEN density > 0.45 AND pixels > 80 THEN 'CONSTRUCTION' WHEN w > 3 * h OR h > 3 * w THEN 'ROAD_DEVELOPMENT' ELSE 'VEGETATION_CHANGE' END AS meaning FROM d""")
def gr_region_grading(spark, sf):
    return regions.region_table(regions.region_runs(_mask(spark, sf))).select("scene", "region", "pixels", "density", "coherence", "meaning")


@query(f"""WITH {PX}, m AS (SELECT *, v AS mode, n % 4 > 0 AS nir FROM p, (VALUES ('TRUE_COLOR'), ('FALSE_COLOR')) t(v))
SELECT o, n, mode, CASE WHEN mode = 'TRUE_COLOR' OR nir THEN 'GENERATED' ELSE 'UNAVAILABLE_REQUIRED_BANDS_NOT_FOUND' END AS status,
 CASE WHEN mode = 'TRUE_COLOR' THEN least(255, greatest(0, floor(r))) WHEN nir THEN least(255, greatest(0, floor(price / 100))) END::DOUBLE AS red,
 CASE WHEN mode = 'TRUE_COLOR' THEN least(255, greatest(0, floor(g))) WHEN nir THEN least(255, greatest(0, floor(r))) END::DOUBLE AS green,
 CASE WHEN mode = 'TRUE_COLOR' THEN least(255, greatest(0, floor(b))) WHEN nir THEN least(255, greatest(0, floor(g))) END::DOUBLE AS blue FROM m""")
def ras_false_color(spark, sf):
    p = _pixels(spark, sf)
    seen = F.create_map(*[x for k, c in (("RED", "r"), ("GREEN", "g"), ("BLUE", "b")) for x in (F.lit(k), F.col(c).cast("double"))])
    p = p.withColumn("bands", F.when(F.col("n") % 4 > 0, F.map_concat(seen, F.create_map(F.lit("NIR"), (F.col("price") / 100).cast("double")))).otherwise(seen))
    both = [p.select("o", "n", F.lit(m).alias("mode"), raster.color_composite(F.col("bands"), m).alias("c")) for m in raster.COMPOSITES]
    return both[0].unionByName(both[1]).select("o", "n", "mode", "c.*")


@query(f"""WITH {PX} SELECT scene, round(avg(abs(r - g)), 6) AS mad, round(avg((abs(r - g) > 35)::INT), 6) AS changed, round(abs(avg(r) - avg(g)), 6) AS shift FROM p GROUP BY scene""")
def agg_bitemporal(spark, sf):
    m = raster.pair_metrics(_pixels(spark, sf), ["scene"], "r", "g", F.lit(35))
    return m.select("scene", *[F.round(c, 6).alias(c) for c in ("mad", "changed", "shift")])


@query("""WITH b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), a AS (SELECT c_custkey AS k, c_acctbal * 1.01 AS v FROM customer WHERE c_custkey % 3 <> 0)
SELECT count(*) AS pixels, round(avg(abs(b.v - a.v)), 6) AS mad FROM b JOIN a USING (k)""")
def jn_pixel_aligned(spark, sf):
    c = table(spark, sf, "customer")
    b, a = c.select("c_custkey", F.col("c_acctbal").alias("b")), c.where("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_acctbal") * 1.01).alias("a"))
    return b.join(a, "c_custkey").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg(F.abs(F.col("b") - F.col("a"))), 6).alias("mad"))


#: Every order stands for eight pixels of square images, row by row.
SAMPLED = " WHERE x % 8 = 0 AND y % 8 = 0"
IMAGE = f"""i AS (SELECT o_orderkey * 8 + k AS i, floor(o_totalprice + 31 * k) % 256 AS r, ((o_custkey * 7 + 3 * k) % 256)::DOUBLE AS g, (o_orderkey * (3 + k) % 256)::DOUBLE AS b FROM orders, range(8) t(k)),
p AS (SELECT i // 50176 AS scene, i % 224 AS x, i // 224 % 224 AS y, r, g, b, 0.299 * r + 0.587 * g + 0.114 * b AS lum FROM i),
e AS (SELECT *, lag(lum) OVER (PARTITION BY scene, y ORDER BY x) AS pl FROM p),
m AS (SELECT scene, avg(lum) AS mean_luminance, var_pop(lum) AS variance, CASE WHEN min(lum) > 0 THEN max(lum) / min(lum) ELSE max(lum) END AS contrast_ratio,
 sum(abs(lum - pl)) / count(*) AS edge_density, (avg(g) - avg(r)) / (avg(g) + avg(r) + 1) AS vegetation_proxy, (avg(b) - avg(r)) / (avg(b) + avg(r) + 1) AS water_proxy,
 sqrt(var_pop(lum)) / (avg(lum) + 1) AS roughness_proxy FROM e GROUP BY scene),
c AS (SELECT scene, ((y // 56) * 4 + x // 56)::INT AS cell, avg((r / 255.0 - 0.485) / 0.229 + (g / 255.0 - 0.456) / 0.224 + (b / 255.0 - 0.406) / 0.225) AS mean_value
 FROM p{SAMPLED} GROUP BY ALL)"""
MOMENTS = ["mean_luminance", "variance", "contrast_ratio", "edge_density", "vegetation_proxy", "water_proxy", "roughness_proxy"]


def _image(spark, sf):
    o, k = table(spark, sf, "orders").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")), F.col("k")
    i = F.col("o_orderkey") * 8 + k
    return o.select(
        F.floor(i / 50176).alias("scene"), (i % 224).alias("x"), (F.floor(i / 224) % 224).alias("y"), (F.floor(F.col("o_totalprice") + 31 * k) % 256).cast("double").alias("r"),
        ((F.col("o_custkey") * 7 + 3 * k) % 256).cast("double").alias("g"), (F.col("o_orderkey") * (3 + k) % 256).cast("double").alias("b"),
    )


@query(f"WITH {IMAGE} SELECT scene, {', '.join(f'round({c}, 5) AS {c}' for c in MOMENTS)} FROM m")
def agg_image_moments(spark, sf):
    return raster.image_moments(_image(spark, sf), ["scene"]).select("scene", *[F.round(c, 5).alias(c) for c in MOMENTS])


@query(f"WITH {IMAGE} SELECT scene, cell, round(mean_value, 6) AS mean_value FROM c")
def agg_grid_cells(spark, sf):
    return raster.grid_cells(_image(spark, sf), ["scene"], stride=8).select("scene", "cell", F.round("mean_value", 6).alias("mean_value"))


@query(f"""WITH {IMAGE.replace(SAMPLED, "")}, k AS (SELECT scene, round(edge_density, 2) AS edge, round(contrast_ratio, 2) AS contrast, round(water_proxy, 3) AS water, round(vegetation_proxy, 3) AS plants,
 round(roughness_proxy, 3) AS rough, round(mean_luminance, 2) AS lum FROM m WHERE scene IN (SELECT scene FROM c)),
a AS (SELECT scene, edge * 2.5 + CASE WHEN contrast > 5 THEN 1.5 ELSE 0.5 END AS built, CASE WHEN water > 0.05 THEN water * 3 + edge * 1.5 ELSE 0 END AS port,
 water * 4 + CASE WHEN lum < 60 THEN 1.5 ELSE 0 END AS wet, CASE WHEN plants > 0.02 THEN plants * 5 ELSE 0 END AS green,
 CASE WHEN rough > 0.4 THEN rough * 3.5 ELSE 0 END AS radar FROM k),
v AS (SELECT a.scene, d, CASE WHEN d < 80 THEN built * sin(d * pi() / 40) WHEN d < 120 THEN port * cos((d - 80) * pi() / 20) WHEN d < 190 THEN wet * cos((d - 120) * pi() / 35)
 WHEN d < 270 THEN green * sin((d - 190) * pi() / 40) WHEN d < 340 THEN radar * cos((d - 270) * pi() / 35) ELSE coalesce(mean_value, 0) * 0.4 END AS v
 FROM a, range(500) t(d) LEFT JOIN c ON c.scene = a.scene AND c.cell = (d - 340) // 10),
n AS (SELECT scene, sqrt(sum(v * v)) AS length FROM v GROUP BY 1)
SELECT scene, d::INT AS dim, round(round(v / length, 6) * 1000000)::BIGINT AS millionths FROM v JOIN n USING (scene) WHERE abs(round(v / length, 6)) > 0.001""")
def vec_image_embedding(spark, sf):
    img = _image(spark, sf)
    v = vectors.embed_image(raster.image_moments(img, ["scene"]), raster.grid_cells(img, ["scene"]), ["scene"], F.lit(False))
    each = v.where(F.size("vector") == vectors.DIMENSION).select("scene", F.posexplode("vector").alias("dim", "x"))
    return each.where(F.abs("x") > 0.001).select("scene", "dim", F.round(F.col("x") * 1000000).cast("long").alias("millionths"))


@query(f"""WITH {PX} SELECT scene, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std_dev, count(*) AS n FROM p WHERE x BETWEEN 10 AND 90 AND y BETWEEN 20 AND 100 GROUP BY scene""")
def agg_region_statistics(spark, sf):
    s = raster.band_statistics(_pixels(spark, sf).where("x BETWEEN 10 AND 90 AND y BETWEEN 20 AND 100"), ["scene"], "q")
    return s.select("scene", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), "n")


@query("""WITH g AS (SELECT s_suppkey AS scene, s_suppkey % 6 AS k, x, y, (x * 37 + y * 73 + s_suppkey % 6 * 11) % 40 AS n FROM supplier, range(128) a(x), range(128) b(y)),
p AS (SELECT *, CASE WHEN k = 3 AND x > 70 OR k = 5 AND y > 80 THEN 'water' WHEN k IN (1, 5) AND x % 16 > 4 AND y % 16 > 4 AND x < 64 THEN 'built' WHEN abs(x - y) < 3 THEN 'road' ELSE 'field' END AS kind FROM g)
SELECT scene, kind, count(*) AS pixels, sum(CASE kind WHEN 'water' THEN 20.0 WHEN 'built' THEN 190 WHEN 'road' THEN 120 ELSE n + 60 END)::DOUBLE AS r,
 sum(CASE kind WHEN 'water' THEN 40.0 WHEN 'built' THEN 185 WHEN 'road' THEN 118 ELSE n + 90 END)::DOUBLE AS g, sum(CASE kind WHEN 'water' THEN 60.0 WHEN 'built' THEN 180 WHEN 'road' THEN 115 ELSE n + 40 END)::DOUBLE AS b,
 sum(x * 1000 + y)::BIGINT AS places FROM p GROUP BY scene, kind""")
def src_demo_scenes(spark, sf):
    """A demo raster for each supplier, its pixels by what they show."""
    from terraspan.sources.demo import demo_pixels

    p = demo_pixels(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene"), (F.col("s_suppkey") % 6).alias("kind")))
    kind = F.when(F.col("r") == 20, "water").when(F.col("b") == 180, "built").when((F.col("r") == 120) & (F.col("g") == 118), "road").otherwise("field")
    return p.groupBy("scene", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("pixels"), *[F.sum(c).alias(c) for c in "rgb"], F.sum(F.col("x") * 1000 + F.col("y")).cast("long").alias("places")
    )
