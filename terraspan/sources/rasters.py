"""Headers of raster files: tags from the bytes, all else from the tags.

Only ``raw_headers`` and ``trimmed`` look at bytes, in Arrow batches; what a
header means is stated in column expressions over the tags.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.language import polarization
from terraspan.functions.rules import cascade, has

#: TIFF tags read, by the name of their column.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "description": 270, "make": 271, "model": 272, "samples": 277, "page_name": 285, "software": 305, "date_time": 306,
    "sample_format": 339, "pixel_scale": 33550, "tie_point": 33922, "matrix": 34264, "geo_keys": 34735, "gdal_metadata": 42112, "nodata": 42113,
}
TEXTS = {"description", "make", "model", "page_name", "software", "date_time", "gdal_metadata", "nodata"}
ARRAYS = {"pixel_scale", "tie_point", "matrix", "geo_keys"}
#: Struct codes of the TIFF field types.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q"}
#: GeoKeys of the projected, the projection's and the geographic code; 32767 is user-defined.
PROJECTED, PROJECTION, GEOGRAPHIC, OWN_CODE = 3072, 3074, 2048, 32767

RAW = (
    "kind string, " + ", ".join(f"{k} {'string' if k in TEXTS else 'array<double>' if k in ARRAYS else 'int'}" for k in TAGS)
)


def tiff_fields(data: bytes, tags: set[int], whole: set[int]) -> dict[int, tuple]:
    """The values of the tags in a TIFF's first directory; of those that aren't
    in ``whole`` the first.  A count is believed only as far as the file goes."""
    order = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at, step, room, code = at + (8 if big else 2), 20 if big else 12, 8 if big else 4, "Q" if big else "I"
    found: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + code, data, at + k * step)
        if tag not in tags or kind not in TYPES:
            continue
        size = struct.calcsize(order + TYPES[kind]) * count
        if size > len(data):
            raise struct.error("more values than bytes")
        place = at + k * step + step - room
        if size > room:
            place = struct.unpack_from(order + code, data, place)[0]
        if tag not in whole:
            count = min(count, 1)
        form = f"{count}s" if TYPES[kind] == "s" else TYPES[kind][0] * (count * len(TYPES[kind]))
        found[tag] = struct.unpack_from(order + form, data, place)
    return found


def _tiff(data: bytes) -> dict:
    names = {v: k for k, v in TAGS.items()}
    out: dict = {"kind": "TIFF"}
    for tag, values in tiff_fields(data, set(names), {TAGS[k] for k in TEXTS | ARRAYS}).items():
        name = names[tag]
        if name in TEXTS:
            first = values[0] if values and isinstance(values[0], bytes) else bytes(values)
            out[name] = first.split(b"\0")[0].decode("utf-8", "replace")
        else:
            out[name] = [float(v) for v in values] if name in ARRAYS else int(values[0])
    return out if out.get("width") and out.get("height") else {"kind": "BROKEN"}


def _jpeg(data: bytes) -> dict:
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, samples = struct.unpack_from(">HHB", data, at + 5)
            return {"kind": "JPG", "width": width, "height": height, "samples": samples}
        at += 2 + size
    return {"kind": "BROKEN"}


def header(data: bytes | None) -> dict:
    """The tags of one file; ``kind`` is TIFF, PNG, JPG, BROKEN, UNKNOWN or EMPTY."""
    if not data:
        return {"kind": "EMPTY"}
    try:
        if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            return _tiff(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, bits, colour = struct.unpack_from(">IIBB", data, 16)
            return {"kind": "PNG", "width": width, "height": height, "bits": bits, "samples": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]} if width and height else {"kind": "BROKEN"}
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, KeyError, IndexError, OverflowError, MemoryError, ValueError):
        return {"kind": "BROKEN"}
    return {"kind": "UNKNOWN"}


def raw_headers(files: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``files`` (content and others) and ``h``, the
    tags of each file as a struct.  Null and empty contents are EMPTY, damaged
    headers BROKEN; no file fails the job."""
    from terraspan.schemas import schema

    kept = files.select(*keep, "content")
    out_schema = kept.select(*keep).schema.add("h", schema(RAW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        from terraspan.sources.rasters import TAGS, header

        kind = to_arrow_type(out_schema["h"].dataType)
        for batch in batches:
            found = [{"kind": None} | dict.fromkeys(TAGS) | header(b) for b in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, kind)], [*keep, "h"])

    return kept.mapInArrow(run, out_schema)


def tiff_date(text: Column) -> Column:
    """ISO time of a TIFF date tag (YYYY:MM:DD HH:MM:SS), else null."""
    parts = F.regexp_extract(F.trim(text), r"(\d{4}:\d{2}:\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    iso = F.regexp_replace(parts, r"^(\d{4}):(\d{2}):(\d{2})\s+(\d{2}):(\d{2}):(\d{2})$", r"$1-$2-$3T$4:$5:$6Z")
    return F.when(parts != "", iso)


def geo_key(h: Column, key: int) -> Column:
    """The value of a GeoKey that is held in place; 0 counts as absent."""
    k = h["geo_keys"]
    entries = F.transform(F.sequence(F.lit(1), F.greatest((F.size(k) / 4).cast("int") - 1, F.lit(1))), lambda i: F.slice(k, i * 4 + 1, F.lit(4)))
    hit = F.filter(entries, lambda e: (F.get(e, F.lit(0)) == key) & (F.get(e, F.lit(1)) == 0))
    return F.nullif(F.get(F.get(hit, F.lit(0)), F.lit(3)).cast("int"), F.lit(0))


def epsg_of(h: Column) -> Column:
    code = F.coalesce(geo_key(h, PROJECTED), geo_key(h, PROJECTION))
    land = geo_key(h, GEOGRAPHIC)
    return F.when(code != OWN_CODE, code).when(land != OWN_CODE, land)


def affine(h: Column) -> Column:
    """struct(transform, pixel_width, pixel_height, bounds) from the matrix or
    from tie point and scale, null without either."""
    m, t, s = h["matrix"], h["tie_point"], h["pixel_scale"]

    def at(x: Column, k: int) -> Column:
        return F.get(x, F.lit(k))

    width, height = h["width"].cast("double"), h["height"].cast("double")
    dx, dy = F.coalesce(F.nullif(at(m, 0), F.lit(0.0)), F.lit(1.0)), F.coalesce(F.nullif(at(m, 5), F.lit(0.0)), F.lit(-1.0))
    far = at(m, 7) + height * dy
    by_matrix = F.struct(
        m.alias("transform"), F.abs(dx).alias("pixel_width"), F.abs(dy).alias("pixel_height"),
        F.array(at(m, 3), F.least(far, at(m, 7)), at(m, 3) + width * dx, F.greatest(far, at(m, 7))).alias("bounds"),
    )
    x, y = at(t, 3), at(t, 4)
    by_point = F.struct(
        F.array(x, at(s, 0), F.lit(0.0), y, F.lit(0.0), -at(s, 1)).alias("transform"), at(s, 0).alias("pixel_width"), at(s, 1).alias("pixel_height"),
        F.array(x, y - height * at(s, 1), x + width * at(s, 0), y).alias("bounds"),
    )
    return F.when(m.isNotNull(), by_matrix).when(t.isNotNull() & s.isNotNull(), by_point)


def data_type(h: Column) -> Column:
    """float32, int16 or uint with the number of bits, as scenes state it."""
    bits = F.coalesce(h["bits"], F.lit(8))
    return F.when(h["sample_format"] == 3, "float32").when(h["sample_format"] == 2, "int16").otherwise(F.concat(F.lit("uint"), bits.cast("string")))


def scene_header(h: Column) -> Column:
    """What a scene's row takes from the header of a TIFF (null for others)."""
    bands, geo = F.coalesce(h["samples"], F.lit(1)), affine(h)
    epsg = epsg_of(h)
    each = F.transform(F.sequence(F.lit(1), bands), lambda k: F.struct(
        k.alias("index"), F.when(bands == 1, "Band 1 (Intensity / SAR)").otherwise(F.concat(F.lit("Band "), k.cast("string"))).alias("name"),
        data_type(h).alias("data_type"), number(h["nodata"]).alias("nodata_value"),
    ))
    return F.when(h["kind"] == "TIFF", F.struct(
        h["width"].alias("width"), h["height"].alias("height"), bands.alias("band_count"), each.alias("bands"),
        F.concat(F.lit("EPSG:"), epsg.cast("string")).alias("crs"), epsg.alias("epsg"), geo["transform"].alias("transform"),
        geo["pixel_width"].alias("pixel_width"), (-geo["pixel_height"]).alias("pixel_height"), number(h["nodata"]).alias("nodata_value"),
        tiff_date(h["date_time"]).alias("acquisition_date"),
        cascade([(bands == 1, "sar"), (bands == 3, "optical"), (bands > 3, "multispectral")], "unknown").alias("modality"),
    ))


def number(text: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double")


def chat_metadata(h: Column) -> Column:
    """What a question about an uploaded image may know of it."""
    tiff, text = h["kind"] == "TIFF", F.upper(h["description"])
    bands = F.when(tiff, F.coalesce(h["samples"], F.lit(1))).when(h["kind"].isin("PNG", "JPG"), F.lit(3))
    waves = F.when(tiff & h["description"].isNotNull(), polarization(text)).otherwise(F.lit("UNKNOWN"))
    calibrated = cascade(
        [(tiff & has(text, "CALIBRATED", "SIGMA0", "GAMMA0", "BETA0"), "CALIBRATED"), (tiff & has(text, "RAW", "UNRESOLVED", "DN"), "UNCALIBRATED")], "UNKNOWN"
    )
    many = F.when(bands > 3, "MULTISPECTRAL").otherwise("OPTICAL")
    told = cascade([(tiff & (has(text, "SAR", "RADAR") | (waves != "UNKNOWN")), "SAR"), (tiff & has(text, "OPTICAL", "MSI", "RGB"), many), (tiff, many)], "UNKNOWN")
    geo, epsg = affine(h), epsg_of(h)
    return F.struct(
        h["width"].alias("width"), h["height"].alias("height"), bands.alias("bands"), F.when(tiff, data_type(h)).otherwise("uint8").alias("dtype"),
        F.concat(F.lit("EPSG:"), epsg.cast("string")).alias("crs"), epsg.alias("epsg"), geo["transform"].alias("transform"), geo["bounds"].alias("bounds"),
        F.when(geo.isNotNull(), F.array(geo["pixel_width"], geo["pixel_height"])).alias("resolution"), number(h["nodata"]).alias("nodata"),
        F.coalesce(h["model"], h["make"], F.lit("UNKNOWN")).alias("sensor"), waves.alias("polarization"), calibrated.alias("calibration"), told.alias("modality"),
        tiff.alias("has_tiff_tags"),
    )


#: Fixed value: the warning about rasters that can't be placed.
UNPLACED = "MISSING_GEOREFERENCE"


def validated(h: Column) -> Column:
    """struct(valid, format, width, height, bands, data_type, epsg, failure_state, warning)."""
    tiff, ok = h["kind"] == "TIFF", h["kind"].isin("TIFF", "PNG", "JPG")
    prefix = F.when(h["sample_format"] == 3, "Float").when(h["sample_format"] == 2, "Int").otherwise("Uint")
    epsg = F.when(tiff, F.coalesce(geo_key(h, PROJECTED), geo_key(h, GEOGRAPHIC)))
    return F.struct(
        ok.alias("valid"), F.when(tiff, "GeoTIFF").when(ok, h["kind"]).otherwise("UNKNOWN").alias("format"), F.when(ok, h["width"]).alias("width"),
        F.when(ok, h["height"]).alias("height"), F.when(tiff, F.coalesce(h["samples"], F.lit(1))).when(ok, F.lit(3)).otherwise(0).alias("bands"),
        F.when(tiff, F.concat(prefix, F.coalesce(h["bits"], F.lit(8)).cast("string"))).when(ok, "Uint8").otherwise("UNKNOWN").alias("data_type"),
        epsg.alias("epsg"), F.when(~ok, "INVALID_RASTER").alias("failure_state"),
        F.when(ok & epsg.isNull(), UNPLACED).when(h["kind"] == "EMPTY", "EMPTY").when(~ok, "CORRUPT").alias("warning"),
    )


def base64_bytes(text: Column) -> Column:
    """The bytes of a base64 text, with or without a data URI's prefix and white space."""
    t = F.trim(text)
    comma = F.instr(t, ",")
    body = F.when((comma > 0) & (comma <= 100), F.substring(t, comma + 1, F.length(t))).otherwise(t)
    return F.unbase64(F.regexp_replace(body, r"\s", ""))


def trim(data: bytes | None) -> bytes | None:
    """A PNG or JPEG without the bytes behind its end; any other as it is."""
    if data and data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            at += size + 12
            if name == b"IEND":
                return data[:at]
        end = data.rfind(b"IEND")
        return data[: end + 8] if end >= 0 else data
    if data and data[:2] == b"\xff\xd8" and (end := data.rfind(b"\xff\xd9", 2)) >= 0:
        return data[: end + 2]
    return data


def trimmed(files: DataFrame) -> DataFrame:
    """``files`` with contents cut behind the end of the image."""
    k = files.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.sources.rasters import trim

        for batch in batches:
            yield batch.set_column(k, "content", pa.array([trim(b) for b in batch.column(k).to_pylist()], pa.binary()))

    return files.mapInArrow(run, files.schema)

