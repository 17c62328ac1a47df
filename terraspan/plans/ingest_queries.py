"""Headers, validation and outcome of raster files, made from the orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions import raster
from terraspan.functions.resampling import resample
from terraspan.lineage import drop_path, own_path, spread
from terraspan.operators import tools
from terraspan.plans._base import query, table
from terraspan.sources import ingest, lmdb, pixels, rasters
from terraspan.sources.demo import tiff_bytes
from terraspan.streaming import catalogue

EPSG = "CASE o_orderkey % 3 WHEN 0 THEN 32643 WHEN 1 THEN 32767 ELSE 4326 END"
BITS = "CASE o_orderkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END"
FORMAT = "(1 + o_orderkey % 3)"


def _files(spark, sf):
    k = F.col("o_orderkey")
    content = tiff_bytes(
        k % 4000 + 1, F.col("o_custkey") % 3000 + 1, k % 5 + 1, F.when(k % 4 == 0, 8).when(k % 4 == 1, 16).otherwise(32), 1 + k % 3,
        F.when(k % 3 == 0, 32643).when(k % 3 == 1, 32767).otherwise(4326), F.date_format("o_orderdate", "yyyy:MM:dd '10:20:30'"),
    )
    damaged = F.when(k % 11 == 0, F.substring(content, 1, 60)).when(k % 13 == 0, F.lit("plain text").cast("binary")).when(k % 17 == 0, F.lit("").cast("binary")).otherwise(content)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(spread(spark), "o_orderkey")  # few bytes, files of many
    return orders.select("o_orderkey", F.concat(F.lit("s2_"), k.cast("string"), F.lit(".tif")).alias("file_name"), damaged.alias("content"))


WHOLE = "o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0"


@query(f"""SELECT o_orderkey, o_orderkey % 4000 + 1 AS width, o_custkey % 3000 + 1 AS height, o_orderkey % 5 + 1 AS band_count, len(range(o_orderkey % 5 + 1)) AS bands,
 CASE o_orderkey % 5 WHEN 0 THEN 'Band 1 (Intensity / SAR)' ELSE 'Band 1' END AS first_band,
 CASE {FORMAT} WHEN 3 THEN 'float32' WHEN 2 THEN 'int16' ELSE 'uint' || ({BITS}) END AS data_type, CASE WHEN ({EPSG}) <> 32767 THEN {EPSG} END AS epsg,
 CASE WHEN ({EPSG}) <> 32767 THEN 'EPSG:' || ({EPSG}) END AS crs, '500000.0,10.0,0.0,2000000.0,0.0,-10.0' AS transform, 10.0::DOUBLE AS pixel_width, -9999.0::DOUBLE AS nodata_value,
 strftime(o_orderdate, '%Y-%m-%dT10:20:30Z') AS acquisition_date, CASE o_orderkey % 5 WHEN 0 THEN 'sar' WHEN 1 THEN 'unknown' WHEN 2 THEN 'optical' ELSE 'multispectral' END AS modality
FROM orders WHERE {WHOLE}""")
def src_tiff_header(spark, sf):
    s = rasters.raw_headers(_files(spark, sf), "o_orderkey").withColumn("s", rasters.scene_header(F.col("h"))).where("s IS NOT NULL")
    first = F.get("s.bands", F.lit(0))
    return s.select(
        "o_orderkey", "s.width", "s.height", "s.band_count", F.size("s.bands").alias("bands"), first["name"].alias("first_band"), first["data_type"].alias("data_type"),
        "s.epsg", "s.crs", F.array_join(F.transform("s.transform", lambda x: x.cast("decimal(20,1)").cast("string")), ",").alias("transform"), "s.pixel_width", "s.nodata_value",
        "s.acquisition_date", "s.modality",
    )


@query(f"""SELECT o_orderkey, {WHOLE} AS valid, CASE WHEN {WHOLE} THEN 'GeoTIFF' ELSE 'UNKNOWN' END AS format, CASE WHEN {WHOLE} THEN o_orderkey % 4000 + 1 END AS width,
 CASE WHEN {WHOLE} THEN o_orderkey % 5 + 1 ELSE 0 END AS bands, CASE WHEN NOT ({WHOLE}) THEN 'UNKNOWN' ELSE CASE {FORMAT} WHEN 3 THEN 'Float' WHEN 2 THEN 'Int' ELSE 'Uint' END || ({BITS}) END AS data_type,
 CASE WHEN NOT ({WHOLE}) THEN 'INVALID_RASTER' END AS failure_state,
 CASE WHEN {WHOLE} THEN NULL WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'CORRUPT' ELSE 'EMPTY' END AS warning FROM orders""")
def src_raster_validation(spark, sf):
    h = rasters.raw_headers(_files(spark, sf), "o_orderkey").withColumn("v", rasters.validated(F.col("h")))
    return h.select("o_orderkey", *[f"v.{c}" for c in ("valid", "format", "width", "bands", "data_type", "failure_state", "warning")])


@query(f"""SELECT o_orderkey, o_orderkey % 5 + 1 AS bands, CASE WHEN o_orderkey % 5 > 2 THEN 'MULTISPECTRAL' ELSE 'OPTICAL' END AS modality, 'UNKNOWN' AS sensor, 'UNKNOWN' AS calibration,
 2000000.0 - 10.0 * (o_custkey % 3000 + 1) AS south, 500000.0 + 10.0 * (o_orderkey % 4000 + 1) AS east FROM orders WHERE {WHOLE}""")
def src_chat_metadata(spark, sf):
    h = rasters.raw_headers(_files(spark, sf), "o_orderkey").where("h.kind = 'TIFF'").withColumn("m", rasters.chat_metadata(F.col("h")))
    return h.select("o_orderkey", "m.bands", "m.modality", "m.sensor", "m.calibration", F.get("m.bounds", F.lit(1)).alias("south"), F.get("m.bounds", F.lit(2)).alias("east"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%dT23:59:00Z') END AS iso FROM orders""")
def dt_tiff_date(spark, sf):
    text = F.when(F.col("o_orderkey") % 4 == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy:MM:dd '23:59:00 '")))
    return table(spark, sf, "orders").select("o_orderkey", rasters.tiff_date(text).alias("iso"))


@query("""SELECT conv_id, turn, text AS decoded FROM conversations""")
def src_base64_image(spark, sf):
    body = F.base64(F.encode("text", "UTF-8"))
    half = (F.length(body) / 2).cast("int")
    uri = F.concat(F.lit("  data:image/png;base64,"), F.substring(body, F.lit(1), half), F.lit("\r\n "), F.substring(body, half + 1, F.length(body)))
    sent = F.when(F.col("turn") % 2 == 0, uri).otherwise(body)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.decode(rasters.base64_bytes(sent), "UTF-8").alias("decoded"))


def _streamed(spark, sf):
    """The orders' files, every fourth one twice, taken in as a stream of parts."""
    home = own_path(spark, "archive")
    files = _files(spark, sf).drop("o_orderkey")
    again = F.when(F.pmod(F.xxhash64("file_name"), F.lit(4)) == 0, F.array(F.lit(""), F.lit("copy_of_"))).otherwise(F.array(F.lit("")))
    files = files.select(F.explode(again).alias("prefix"), "file_name", "content").select(F.concat("prefix", "file_name").alias("file_name"), "content")
    n = max(4, spread(spark))
    files.repartition(n).write.parquet(f"{home}/files")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", n // 2).parquet(f"{home}/files")
    catalogue.ingest_stream(stream, f"{home}/catalogue", f"{home}/checkpoint").awaitTermination()
    return f"{home}/catalogue"


#: A file's content depends on these columns alone.
CONTENT = f"""c AS (SELECT DISTINCT o_orderkey % 4000 AS a, o_custkey % 3000 AS b, o_orderkey % 5 AS bands, o_orderkey % 4 AS bits, o_orderkey % 3 AS f, CAST(o_orderdate AS DATE) AS d, ({EPSG}) AS epsg FROM orders WHERE {WHOLE}),
t AS (SELECT CASE WHEN bands = 0 THEN 'sar' WHEN bands = 1 THEN 'unknown' WHEN bands = 2 THEN 'optical' ELSE 'multispectral' END AS modality, epsg <> 32767 AS geo FROM c)"""


@query(f"""WITH {CONTENT}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE geo) AS g FROM t) SELECT 'all' AS facet, NULL AS value, n AS scenes, n * 248 AS bytes, g AS georeferenced FROM s
UNION ALL SELECT 'format', 'TIFF', n, n * 248, g FROM s""")
def src_stream_totals(spark, sf):
    t = catalogue.totals(spark, _streamed(spark, sf))
    return t.where("facet <> 'modality'").select("facet", "value", "scenes", "bytes", "georeferenced")


@query(f"""WITH {CONTENT} SELECT 'NEW' AS outcome, count(*) AS files FROM c""")
def src_stream_ingest(spark, sf):
    return catalogue.outcomes(spark, _streamed(spark, sf)).where("outcome = 'NEW'")


#: Customers as small images in one of six kinds of files; every 13th is cut.
PIXEL_SQL = """f AS (SELECT c_custkey AS k, c_custkey % 4 + 5 AS w, c_custkey % 3 + 4 AS h, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END AS bands FROM customer WHERE c_custkey % 13 <> 0),
p AS (SELECT k, x, y, b, ((k * 7 + x * 3 + y * 5 + b * 11) % 256)::DOUBLE AS value FROM f, range(8) i(x), range(6) j(y), range(3) l(b) WHERE x < w AND y < h AND b < bands)"""


def _image_files(spark, sf):
    # a file of keys is small and would be one task's, what is made of them isn't
    c = table(spark, sf, "customer").select("c_custkey").repartition(spread(spark), "c_custkey")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from terraspan.sources import encoders

        for batch in batches:
            files = []
            for k in batch.column(0).to_pylist():
                y, x, b = np.meshgrid(np.arange(k % 3 + 4), np.arange(k % 4 + 5), np.arange(1 if k % 2 == 0 else 3), indexing="ij")
                m = ((k * 7 + x * 3 + y * 5 + b * 11) % 256).astype(np.uint8 if k % 5 else np.uint16)
                kinds = [
                    lambda m: encoders.png(m), lambda m: encoders.png(m, (4,), True), lambda m: encoders.tiff(m), lambda m: encoders.tiff(m, 5, 2, rows=2),
                    lambda m: encoders.tiff(m, 8, tile=(16, 16), order=">"), lambda m: encoders.tiff(m, 8, 2, rows=3, planar=2),
                ]
                data = kinds[k % 6](m)
                files.append(data[: len(data) // 3] if k % 13 == 0 else data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["k", "content"])

    return c.mapInArrow(run, "k long, content binary")


@query(f"WITH {PIXEL_SQL} SELECT k, x::INT AS x, y::INT AS y, b::INT AS band, value FROM p")
def src_pixels(spark, sf):
    """All pixels of the whole files; a cut one gives some of its rows, which
    ``src_pixel_problems`` reports and SQL can't foretell."""
    found = pixels.pixels(pixels.decoded(_image_files(spark, sf), "k"), "k")
    return found.where("k % 13 <> 0")


@query("""SELECT c_custkey % 6 AS kind, count(*) AS files, count(*) FILTER (WHERE c_custkey % 13 = 0) AS damaged FROM customer GROUP BY 1""")
def src_pixel_problems(spark, sf):
    bad = pixels.problems(pixels.decoded(_image_files(spark, sf), "k"), "k").select("k").distinct().withColumn("bad", F.lit(1))
    every = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(bad, "k", "left")
    return every.groupBy((F.col("k") % 6).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("damaged"))


@query(f"WITH {PIXEL_SQL} SELECT k, b::INT AS band, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, count(*) AS n FROM p GROUP BY k, b")
def agg_file_statistics(spark, sf):
    """Band statistics straight from the files' pixels."""
    found = pixels.pixels(pixels.decoded(_image_files(spark, sf).where("k % 13 <> 0"), "k"), "k")
    s = raster.band_statistics(found, ["k", "band"], "value")
    return s.select("k", "band", "min", "max", F.round("mean", 6).alias("mean"), F.round("std_dev", 6).alias("std_dev"), "n")


#: Keys of an LMDB file, and of the files that exist at a time, about (4 GB).
KEYS_OF_A_FILE, KEYS_OF_A_TURN = 5000, 2_000_000


def _write_lmdb(spark, orders, home):
    """A file in a folder of its own for each ``file`` of the orders; their number."""
    key = F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    value = F.repeat(F.concat("o_orderpriority", F.lit("|")), (F.col("o_orderkey") % 300 + 1).cast("int"))
    items = orders.repartition(spread(spark), "o_orderkey").select("file", key.cast("binary").alias("key"), value.cast("binary").alias("value"))

    def write(group):
        from pyarrow import fs

        from terraspan.sources import encoders

        system, root = fs.FileSystem.from_uri(home if "://" in home else f"file://{home}")
        place = f"{root}/{group['file'][0].as_py()}"
        system.create_dir(place)
        with system.open_output_stream(f"{place}/data.mdb") as f:
            f.write(encoders.lmdb(list(zip(group["key"].to_pylist(), group["value"].to_pylist(), strict=True))))
        return group.select(["file"]).slice(0, 1)

    return items.groupBy("file").applyInArrow(write, "file long").count()


@query("""SELECT 'o' || lpad(o_orderkey::VARCHAR, 9, '0') AS key, sha256(repeat(o_orderpriority || '|', (o_orderkey % 300 + 1)::INT)) AS value FROM orders""")
def src_lmdb(spark, sf):
    """Orders as items of LMDB files that tasks write, some too large for a
    page, read back by key range.  The files are about fifty times as large as
    the table, so they are written, read and removed for a part of the keys at a
    time."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").withColumn("file", F.floor(F.col("o_orderkey") / KEYS_OF_A_FILE))
    turns = -(-orders.count() // KEYS_OF_A_TURN)
    cuts = sorted(set(orders.approxQuantile("file", [k / turns for k in range(1, turns)], 0.001))) if turns > 1 else []
    out = own_path(spark, "read")
    for turn, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = orders if low is None else orders.where(F.col("file") >= int(low))
        part = part if high is None else part.where(F.col("file") < int(high))
        home = own_path(spark, "lmdb")
        items = lmdb.read(spark, home, 8) if _write_lmdb(spark, part, home) else spark.createDataFrame([], "key binary, value binary")
        found = items.select(F.col("key").cast("string").alias("key"), F.sha2("value", 256).alias("value"))
        found.write.option("compression", "zstd").parquet(f"{out}/turn={turn}")
        drop_path(spark, home)
    return spark.read.schema("key string, value string").parquet(out).select("key", "value")


@query(f"""WITH {PIXEL_SQL}, w AS (SELECT k, x, y, max(value) FILTER (WHERE b = 0) AS r, max(value) FILTER (WHERE b = 1) AS g, max(value) FILTER (WHERE b = 2) AS b FROM p WHERE k % 2 = 1 GROUP BY ALL),
v AS (SELECT CASE WHEN k % 6 < 2 THEN 'PNG' ELSE 'TIFF' END AS format, k, CASE WHEN r + g > 1e-6 AND abs((r - g) / (r + g)) <= 1 THEN (r - g) / (r + g) END AS nd, 0.299 * r + 0.587 * g + 0.114 * b AS lum FROM w)
SELECT format, count(DISTINCT k) AS files, round(avg(nd), 6) AS difference, round(avg(lum), 6) AS luminance FROM v GROUP BY format""")
def udf_tools_in_sql(spark, sf):
    """Four tools by name in one SQL statement: two over tables of files, two
    measures of their pixels.  The planner sees keys, not how many pixels come of
    them, so the join is told to merge: neither side has a bound."""
    tools.register(spark)
    return spark.sql(
        """WITH p AS (SELECT k, x, y, max(value) FILTER (WHERE band = 0) AS r, max(value) FILTER (WHERE band = 1) AS g, max(value) FILTER (WHERE band = 2) AS b
           FROM read_pixels(TABLE({files})) WHERE problem IS NULL GROUP BY k, x, y)
           SELECT /*+ MERGE(p, h) */ h.format, count(DISTINCT p.k) AS files, round(avg(normalised_difference(r, g)), 6) AS difference, round(avg(luminance(r, g, b)), 6) AS luminance
           FROM p JOIN validate_raster(TABLE({files})) h ON p.k = h.k GROUP BY h.format""",
        files=_image_files(spark, sf).where("k % 2 = 1 AND k % 13 <> 0"),
    )


#: Orders as the pixels of images of two sizes, row by row.
IMAGES = """i AS (SELECT o_orderkey // 384 AS s, o_orderkey % 384 AS k, CASE WHEN o_orderkey // 384 % 2 = 0 THEN 24 ELSE 16 END AS w, floor(o_totalprice) % 1000 AS value FROM orders),
p AS (SELECT s, w, 384 // w AS h, k % w AS x, k // w AS y, value FROM i)"""


def _weights_sql(name: str, n: str, new: int, kernel: str) -> str:
    """The kernel along one axis, stated on its own: overlaps for box, else the
    taps around a new place's centre, drawn in at the edges."""
    lengths = f"(SELECT DISTINCT {n} AS n FROM p)"
    if kernel == "box":
        return f"""{name} AS (SELECT n, i, j, (least((j + 1.0) / n, (i + 1.0) / {new}) - greatest(j * 1.0 / n, i * 1.0 / {new})) * {new} AS weight
 FROM {lengths}, range({new}) a(i), range(24) b(j) WHERE j < n AND (j + 1) * {new} > i * n AND j * {new} < (i + 1) * n)"""
    reach, form = ("(0), (1)", "1 - d") if kernel == "bilinear" else (
        "(-1), (0), (1), (2)", "CASE WHEN d <= 1 THEN 1.25 * pow(d, 3) - 2.25 * d * d + 1 WHEN d < 2 THEN -0.75 * pow(d, 3) + 3.75 * d * d - 6 * d + 3 ELSE 0 END")
    return f"""{name} AS (SELECT n, i, least(n - 1, greatest(0, tap)) AS j, sum({form}) AS weight FROM (SELECT n, i, t + floor(c) AS tap, abs(c - (t + floor(c))) AS d
 FROM (SELECT n, i, (i + 0.5) * n / {new} - 0.5 AS c FROM {lengths}, range({new}) a(i)), (VALUES {reach}) v(t)) GROUP BY ALL)"""


def _resampled_sql(grid: tuple[int, int], kernel: str) -> str:
    x, y = _weights_sql("wx", "w", grid[0], kernel), _weights_sql("wy", "h", grid[1], kernel)
    return f"""WITH {IMAGES}, {x}, {y}, a AS (SELECT s, h, wx.i AS x, y, sum(value * weight) / sum(weight) AS value FROM p JOIN wx ON p.w = wx.n AND p.x = wx.j GROUP BY ALL HAVING sum(weight) >= 0.3)
SELECT s, x, wy.i AS y, sum(value * weight) / sum(weight) AS value FROM a JOIN wy ON a.h = wy.n AND a.y = wy.j GROUP BY ALL HAVING sum(weight) >= 0.3"""


GRIDS = [("box", (10, 7)), ("box", (48, 32)), ("bilinear", (40, 40)), ("cubic", (40, 40)), ("cubic", (9, 11))]


def _images(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.floor(k / 384).alias("s"), (k % 384).alias("k"), F.when(F.floor(k / 384) % 2 == 0, 24).otherwise(16).alias("w"),
                                          (F.floor("o_totalprice") % 1000).cast("double").alias("value"))
    return o.select("s", "w", F.floor(384 / F.col("w")).alias("h"), (F.col("k") % F.col("w")).alias("x"), F.floor(F.col("k") / F.col("w")).alias("y"), "value")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kernel, '{g[0]}x{g[1]}' AS grid, s, x::INT AS x, y::INT AS y, round(value, 6) AS value FROM ({_resampled_sql(g, k)})" for k, g in GRIDS))
def ras_resample(spark, sf):
    parts = [
        resample(_images(spark, sf), (F.col("w"), F.col("h")), g, ["s"], kernel=k).select(
            F.lit(k).alias("kernel"), F.lit(f"{g[0]}x{g[1]}").alias("grid"), "s", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round("value", 6).alias("value"))
        for k, g in GRIDS
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS bands FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0)
SELECT 'NEW' AS outcome, count(*) AS n, sum(bands) AS bands FROM f WHERE k % 2 = 1 UNION ALL SELECT 'DUPLICATE', count(*), NULL FROM f WHERE k % 2 = 0
UNION ALL SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'DAMAGED' WHEN o_orderkey % 13 = 0 THEN 'UNSUPPORTED' ELSE 'EMPTY_BUFFER' END, count(*), NULL FROM orders
WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 GROUP BY 1""")
def src_ingest(spark, sf):
    files = _files(spark, sf).withColumn("content", F.concat("content", F.when(F.length("content") > 20, F.col("o_orderkey").cast("string").cast("binary")).otherwise(F.lit("").cast("binary"))))
    known = files.where("o_orderkey % 2 = 0 AND length(content) > 100").select(F.sha2("content", 256).alias("file_hash"))
    rows = ingest.scene_rows(files.drop("o_orderkey"), known)
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("outcome") == "NEW", F.col("band_count"))).alias("bands"))


@query(f"""WITH a AS ({_resampled_sql((8, 8), 'box')}), c AS (SELECT c_custkey // 64 AS s, c_custkey % 8 AS x, c_custkey // 8 % 8 AS y, floor(abs(c_acctbal)) % 1000 AS v FROM customer)
SELECT s, count(*) AS pixels, round(avg(abs(a.value - c.v)), 5) AS mad, round(max(abs(a.value - c.v)), 5) AS most FROM a JOIN c USING (s, x, y) GROUP BY s""")
def jn_common_grid(spark, sf):
    """Two images of each place, the finer (orders) brought to the grid of the
    coarser one (customers)."""
    k = F.col("c_custkey")
    coarse = table(spark, sf, "customer").select(F.floor(k / 64).alias("s"), (k % 8).alias("x"), (F.floor(k / 8) % 8).alias("y"), (F.floor(F.abs("c_acctbal")) % 1000).alias("other"))
    down = resample(_images(spark, sf), (F.col("w"), F.col("h")), (8, 8), ["s"])
    m = raster.pair_metrics(down.join(coarse, ["s", "x", "y"]), ["s"], "value", "other", F.lit(35))
    return m.select("s", "pixels", F.round("mad", 5).alias("mad"), F.round("max_delta", 5).alias("most"))


def _part_sql(title: str, *lines: str) -> str:
    return f"'', '{title}', '{'-' * len(title)}', " + ", ".join(lines)


REPORT = ", ".join([
    "repeat('=', 60), 'EVIDENCE AND AUDIT REPORT', repeat('=', 60)",
    _part_sql("Candidate", "'Id: ' || o_orderkey", "'Status: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' ELSE 'NEW' END", "'Origin: SEARCH'", "'Run: R' || o_orderkey"),
    _part_sql("Scene", "'Location: Lo\"c ' || o_orderkey", "'CRS: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'EPSG:32643' ELSE 'Not available' END", "'Sensors: MSI, C-SAR'", "'Modality: OPTICAL'", "'Dates: 2020 to 2024'"),
    _part_sql("Retrieval", "'Similarity: ' || printf('%.3f', (o_orderkey % 1000) / 1000.0)"),
    _part_sql("Change", "'Class: ROAD'", "'Share: ' || printf('%.2f%%', (o_orderkey % 100)::DOUBLE)", "'Pixels: 5 of 100'", "'First supported: ' || CASE WHEN o_orderkey % 5 = 0 THEN '2021-06' ELSE 'Not available' END"),
    _part_sql("Quality", "'Overall: USABLE'", "'Registration: ALIGNED'", "'Season: ' || CASE WHEN o_orderkey % 4 = 1 THEN 'HIGH' ELSE 'Not available' END", "'Cloud: Not available'"),
    _part_sql("Decision", "'Analyst: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END", "'Reason: ' || CASE WHEN o_orderkey % 7 = 0 THEN 'too \"cloudy\"' ELSE 'Not available' END"),
])


@query(f"SELECT o_orderkey::VARCHAR AS candidate_id, array_to_string([{REPORT}], chr(10)) AS report FROM orders")
def snk_audit_text(spark, sf):
    from terraspan.plans.review_queries import _candidates

    return ingest.audit_text(_candidates(spark, sf))
