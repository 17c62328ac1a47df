"""Raster headers from real bytes, and what is appended to."""

import base64
import struct
import zlib

from pyspark.sql import functions as F

from terraspan.functions import vectors
from terraspan.operators import review
from terraspan.sources import ingest, rasters


def tiff(order="<", big=False, **tags):
    """A TIFF of the given (type, values) per tag number."""
    code, word = order, {3: "H", 4: "I", 12: "d", 2: "s", 16: "Q"}
    room, body, fields = 8 if big else 4, b"", []
    start = (16 if big else 8) + (8 if big else 2) + len(tags) * (20 if big else 12) + (8 if big else 4)
    for tag, (kind, values) in sorted((int(k[1:]), v) for k, v in tags.items()):
        n = len(values)
        raw = values if kind == 2 else struct.pack(code + word[kind] * n, *values)
        if len(raw) > room:
            place, body = start + len(body), body + raw
            raw = struct.pack(code + ("Q" if big else "I"), place)
        fields.append(struct.pack(code + "HH" + ("Q" if big else "I"), tag, kind, n) + raw.ljust(room, b"\0"))
    head = (b"II" if order == "<" else b"MM") + (struct.pack(code + "HHHQ", 43, 8, 0, 16) if big else struct.pack(code + "HI", 42, 8))
    return head + struct.pack(code + ("Q" if big else "H"), len(fields)) + b"".join(fields) + b"\0" * (8 if big else 4) + body


def png(width, height, colour=2, tail=b""):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"") + tail


def jpeg(width, height, tail=b""):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HHB", height, width, 3) + b"\0" * 9 + b"\xff\xd9" + tail


BASE = {"t256": (4, [640]), "t257": (3, [480])}


def test_headers(spark):
    geo = {"t33550": (12, [2.0, 3.0, 0.0]), "t33922": (12, [0.0, 0, 0, 100.0, 900.0, 0]), "t34735": (3, [1, 1, 0, 2, 3072, 0, 1, 32767, 2048, 0, 1, 4326])}
    files = {
        "little": tiff(**BASE, **geo, t277=(3, [4]), t306=(2, b"2021:02:03 04:05:06\0"), t42113=(2, b"-1e3 \0"), t270=(2, b"calibrated sar VV VH\0"), t272=(2, b"MSI\0")),
        "large": tiff(">", **BASE, t277=(3, [3]), t258=(3, [16, 16, 16]), t339=(3, [1, 1, 1]), t34264=(12, [2.0, 0, 0, 10.0, 0, -2.0, 0, 50.0] + [0.0] * 8), t270=(2, b"RGB raw\0")),
        "big": tiff(big=True, **BASE, t306=(2, b"yesterday at noon  \0")),
        "png": png(7, 5, 6), "jpg": jpeg(31, 17), "cut": tiff(**BASE)[:20], "no size": tiff(t277=(3, [1])), "text": b"hello", "empty": b"", "null": None, "bad png": png(7, 5)[:20],
        "loop": b"II*\0" + struct.pack("<I", 4_000_000_000),
    }
    df = spark.createDataFrame(list(files.items()), "name string, content binary")
    rows = rasters.raw_headers(df, "name").select("name", "h.kind", *[f(F.col("h")).alias(n) for n, f in (("s", rasters.scene_header), ("m", rasters.chat_metadata), ("v", rasters.validated))]).collect()
    by = {r.name: r for r in rows}
    assert {n: r.kind for n, r in by.items()} == {
        "little": "TIFF", "large": "TIFF", "big": "TIFF", "png": "PNG", "jpg": "JPG", "cut": "BROKEN", "no size": "BROKEN", "text": "UNKNOWN", "empty": "EMPTY", "null": "EMPTY",
        "bad png": "BROKEN", "loop": "BROKEN",
    }
    s, m, v = by["little"].s, by["little"].m, by["little"].v
    assert (s.width, s.height, s.band_count, s.epsg, s.crs, s.modality) == (640, 480, 4, 4326, "EPSG:4326", "multispectral")
    assert s.transform == [100.0, 2.0, 0.0, 900.0, 0.0, -3.0] and (s.pixel_width, s.pixel_height) == (2.0, -3.0)
    assert s.acquisition_date == "2021-02-03T04:05:06Z" and s.nodata_value == -1000.0 and [b.name for b in s.bands] == ["Band 1", "Band 2", "Band 3", "Band 4"]
    assert (m.polarization, m.calibration, m.modality, m.sensor, m.nodata) == ("VV/VH", "CALIBRATED", "SAR", "MSI", -1000.0) and m.bounds == [100.0, -540.0, 1380.0, 900.0]
    assert (v.valid, v.format, v.epsg, v.failure_state, v.warning) == (True, "GeoTIFF", 32767, None, None)
    m, v = by["large"].m, by["large"].v
    assert (m.dtype, m.modality, m.calibration, m.epsg) == ("uint16", "OPTICAL", "UNCALIBRATED", None) and m.bounds == [10.0, -910.0, 1290.0, 50.0] and m.resolution == [2.0, 2.0]
    assert (v.data_type, v.warning) == ("Uint16", "MISSING_GEOREFERENCE")
    assert by["big"].s.acquisition_date is None and by["big"].s.band_count == 1 and by["big"].s.modality == "sar"
    assert (by["png"].m.width, by["png"].m.bands, by["png"].v.format) == (7, 3, "PNG") and (by["jpg"].m.width, by["jpg"].m.height) == (31, 17)
    for n in ("cut", "no size", "text", "empty", "null", "bad png", "loop"):
        assert by[n].s is None and not by[n].v.valid and by[n].v.failure_state == "INVALID_RASTER"


def test_trimmed_and_base64(spark):
    broken = png(3, 3)[:-12] + b"\xff\xff\xff\xffIDAT" + b"IEND\xae\x42\x60\x82tail"
    cases = [(png(3, 3, tail=b"junk"), png(3, 3)), (jpeg(3, 3, tail=b"junk"), jpeg(3, 3)), (b"other\xff\xd9", b"other\xff\xd9"), (b"", b""), (None, None), (broken, broken[:-4])]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, content binary")
    assert {r.k: r.content and bytes(r.content) for r in rasters.trimmed(df).collect()} == {k: b for k, (_, b) in enumerate(cases)}
    sent = [("data:image/png;base64, " + base64.b64encode(b"abc").decode(), b"abc"), (" YW\nJj ", b"abc"), ("", b"")]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(sent)], "k int, t string").select("k", rasters.base64_bytes(F.col("t")).alias("b")).collect()
    assert {r.k: bytes(r.b) for r in got} == {k: b for k, (_, b) in enumerate(sent)}


def test_ingest_appends(spark, tmp_path):
    def files(*rows):
        return spark.createDataFrame([(n, c, 0) for n, c in rows], "file_name string, content binary, h int")

    none = spark.createDataFrame([], "file_hash string")
    first = ingest.scene_rows(files(("b.tif", tiff(**BASE)), ("a.tif", tiff(**BASE)), ("x.png", png(2, 2)), ("e.tif", b"")), none)
    assert {r.file_name: r.outcome for r in first.collect()} == {"a.tif": "NEW", "b.tif": "DUPLICATE", "x.png": "NEW", "e.tif": "EMPTY_BUFFER"}
    path = str(tmp_path / "scenes")
    ingest.append_scenes(first, path)
    again = ingest.scene_rows(files(("c.tif", tiff(**BASE)), ("y.png", png(9, 2))), spark.read.parquet(path))
    assert {r.file_name: r.outcome for r in again.collect()} == {"c.tif": "DUPLICATE", "y.png": "NEW"}
    ingest.append_scenes(again, path)
    assert spark.read.parquet(path).count() == 3
    assert ingest.scene_rows(files(), none).count() == 0
    got = {r.extension: (r.files, r.bytes > 0) for r in ingest.folder_bytes(spark, path, "*.parquet").collect()}
    assert got.keys() == {"parquet"} and got["parquet"][1]


def test_embeddings_are_computed_once(spark):
    targets = spark.createDataFrame([(1, "flood in the delta"), (2, "port"), (3, "port")], "target_id int, text string")
    empty = spark.createDataFrame([], "cache_key string")
    new = ingest.embedded(targets, empty, "text", "m", "p")
    rows = new.collect()
    assert len(rows) == 2 and all(len(r.vector) == vectors.DIMENSION == r.dimension for r in rows)
    assert ingest.embedded(targets, new, "text", "m", "p").count() == 0 and ingest.embedded(targets, new, "text", "m2", "p").count() == 2


def test_enqueue_and_reports(spark, tmp_path):
    queue = spark.createDataFrame([("a", "NEW")], "candidate_id string, status string")
    rows, events = ingest.enqueued(spark.createDataFrame([("a",), ("b",), ("b",)], "candidate_id string"), queue)
    assert [(r.candidate_id, r.status) for r in rows.collect()] == [("b", "NEW")] and [r.operation for r in events.collect()] == ["CANDIDATE_ENQUEUED"]
    ingest.write_benchmark(spark.createDataFrame([("recall", 0.9, 0.8), ("precision", 0.5, 0.8)], "name string, value double, target double"), str(tmp_path))
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()][2:] == ["| precision | 0.5000 | 0.8000 | missed |", "| recall | 0.9000 | 0.8000 | met |"]
    assert spark.read.json(f"{tmp_path}/metrics").count() == 2
    tools = {r.name: r for r in ingest.tool_table(spark).collect()}
    assert "validateRaster" in tools and ingest.tools_for("SAR_ANALYSIS", "SAR").keys() == {"identifyPolarization", "validateRaster"}
    assert ingest.tools_for("SAR_ANALYSIS", "OPTICAL").keys() == {"validateRaster"} and "inspectBands" in ingest.capability_json(spark)


def test_csv_file_has_the_lines_of_the_export(spark, tmp_path):
    from terraspan.plans.review_queries import _candidates

    q = _candidates(spark, "/root/testdata/sf0.001").limit(50).cache()
    review.write_csv(q.coalesce(1), str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0] == ",".join(f'"{c}"' for c in review.CSV_COLUMNS)
    assert sorted(lines[1:]) == sorted(r.line for r in review.csv_lines(q).collect())
    report = {r.candidate_id: r.report for r in ingest.audit_text(q).collect()}
    assert len(report) == 50 and all("Analyst: " in t and "None" not in t for t in report.values())


def test_days_that_do_not_exist(spark):
    """A number in a file's name, or a tag, that looks like a day but is none."""
    tagged = tiff(**BASE, t306=(2, b"2021:02:31 04:05:06\0"))
    files = [("s2_20200231.tif", tiff(**BASE)), ("s2_20200229.tif", tiff(**BASE)), ("tagged.tif", tagged)]
    rows = {r.file_name: r for r in ingest.described(spark.createDataFrame(files, "file_name string, content binary")).collect()}
    assert {k: r.scene_id.split("_")[1] for k, r in rows.items()} == {"s2_20200231.tif": "20200231", "s2_20200229.tif": "20200229", "tagged.tif": "20210231"}
    assert rows["s2_20200231.tif"].acquisition_date is None and rows["tagged.tif"].acquisition_date is None
    assert str(rows["s2_20200229.tif"].acquisition_date) == "2020-02-29 00:00:00"
