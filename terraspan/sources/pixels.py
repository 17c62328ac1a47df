"""Pixels of image files: PNG, and TIFF in strips or tiles.

A file is first taken apart into what can be decoded on its own: the strips or
tiles of a TIFF, the whole of a PNG.  These parts are dealt over all tasks and
decoded row by row, so neither a large file nor a large strip is unpacked as a
whole.  What can't be decoded is reported by part, and never fails the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terraspan.lineage import spread
from terraspan.schemas import schema
from terraspan.sources import rasters

#: Bytes of one row of an image at most; a wider one is reported.
ROW_BYTES = 1 << 28
#: Values that are sent on at once, about.
AT_ONCE = 1 << 18
#: Numbers of TIFF tags.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_sizes": 279, "planar": 284,
    "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_sizes": 325, "sample_format": 339,
}
#: TIFF compressions that are decoded.
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
#: Samples of a pixel by PNG colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row and steps of the passes of an interlaced PNG.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]

#: A part: its place in the image, how its samples are laid out, its bytes.
PART = "kind string, x0 int, y0 int, width int, height int, shown_width int, shown_height int, band int, bands int, type string, bits int, compression int, predictor int, problem string, payload binary"
PART_NAMES = [c.split()[0] for c in PART.split(", ")]


class Damaged(ValueError):
    """What is wrong with a part."""


def file_parts(data: bytes | None) -> Iterator[dict]:
    """The parts of one file; one with a problem if there is nothing to decode."""
    kind = rasters.header(data)["kind"]
    if kind == "PNG":
        yield {"kind": kind, "payload": rasters.trim(data)}
    elif kind == "TIFF":
        try:
            yield from _tiff_parts(data)
        except (struct.error, IndexError, KeyError, OverflowError, ZeroDivisionError, Damaged) as e:
            yield {"kind": kind, "problem": str(e) if isinstance(e, Damaged) else "DIRECTORY"}
    else:
        yield {"kind": kind, "problem": "UNSUPPORTED" if kind in ("JPG", "UNKNOWN") else kind}


def _tiff_parts(data: bytes) -> Iterator[dict]:
    found = rasters.tiff_fields(data, set(TAGS.values()), whole=set(TAGS.values()))
    tags = {k: found[n] for k, n in TAGS.items() if n in found}

    def one(name: str, usual: int) -> int:
        return int(tags.get(name, [usual])[0])

    width, height, bands, planar = one("width", 0), one("height", 0), one("samples", 1), one("planar", 1)
    bits, compression, predictor = one("bits", 1), one("compression", NONE), one("predictor", 1)
    if min(width, height, bands) <= 0 or len(set(tags.get("bits", [1]))) > 1:
        raise Damaged("DIRECTORY")
    type_ = {1: "u", 2: "i", 3: "f"}.get(one("sample_format", 1))
    if type_ is None or bits not in ((32, 64) if type_ == "f" else (1, 2, 4, 8, 16, 32) if type_ == "u" else (8, 16, 32)) or predictor not in (1, 2) \
            or compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise Damaged("UNSUPPORTED")
    order = "<" if data[:2] == b"II" else ">"
    tiled = "tile_offsets" in tags
    w, h = (one("tile_width", 0), one("tile_height", 0)) if tiled else (width, min(height, one("rows_per_strip", height)))
    offsets, sizes = tags["tile_offsets" if tiled else "strip_offsets"], tags.get("tile_sizes" if tiled else "strip_sizes")
    across, down = -(-width // w), -(-height // h)
    each = bands if planar == 2 else 1
    if sizes is None:
        sizes = [len(data)] * len(offsets)
    for k in range(min(across * down * each, max(len(offsets), 1))):
        band, place = divmod(k, across * down)
        x0, y0 = place % across * w, place // across * h
        shown_h = min(h, height - y0)
        part = {
            "kind": "TIFF", "x0": x0, "y0": y0, "width": w, "height": h if tiled else shown_h, "shown_width": min(w, width - x0), "shown_height": shown_h, "band": band,
            "bands": 1 if planar == 2 else bands, "type": order + type_, "bits": bits, "compression": compression, "predictor": predictor,
        }
        at, size = offsets[k], sizes[k]
        yield part | ({"payload": data[at : at + size]} if at < len(data) else {"problem": "BEYOND_THE_END"})
    if len(offsets) < across * down * each:
        yield {"kind": "TIFF", "problem": "PARTS_MISSING"}


def _unlzw(data: bytes) -> Iterator[bytes]:
    """Strings of a TIFF's LZW codes: first bit first, widened one code early."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, room, last = list(first), 9, 0, 0, b""
    for byte in data:
        held, room = (held << 8 | byte) & 0xFFFFFF, room + 8
        while room >= width:
            room -= width
            code = held >> room & ((1 << width) - 1)
            if code == 256:
                table, width, last = list(first), 9, b""
                continue
            if code == 257:
                return
            if not last:
                if code > 255:
                    raise Damaged("CODES")
                last = table[code]
                yield last
                continue
            if code < len(table):
                text = table[code]
            elif code == len(table):
                text = last + last[:1]
            else:
                raise Damaged("CODES")
            yield text
            table.append(last + text[:1])
            last = text
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1


def _unpacked(payload: bytes, compression: int) -> Iterator[bytes]:
    """The bytes of a strip, piece by piece."""
    if compression == NONE:
        yield payload
    elif compression == LZW:
        yield from _unlzw(payload)
    else:
        yield from _inflated([payload])


def _inflated(pieces) -> Iterator[bytes]:
    unzip = zlib.decompressobj()
    try:
        for data in pieces:
            while data:
                yield unzip.decompress(data, 1 << 20)
                data = unzip.unconsumed_tail
            if unzip.eof:
                return
        yield unzip.flush()
    except zlib.error as e:
        raise Damaged("INFLATE") from e


class _Rows:
    """Rows of given lengths from pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def take(self, n: int) -> bytes:
        if n > ROW_BYTES:
            raise Damaged("TOO_WIDE")
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                raise Damaged("TRUNCATED")
            self.held += piece
        row = bytes(self.held[:n])
        del self.held[:n]
        return row


def _samples(row: bytes, count: int, type_: str, bits: int) -> np.ndarray:
    """``count`` samples of a row."""
    if bits >= 8:
        return np.frombuffer(row, f"{type_[0]}{type_[1]}{bits // 8}", count)
    each = np.unpackbits(np.frombuffer(row, np.uint8))[: count * bits].reshape(count, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1))


Row = tuple[int, int, int, np.ndarray]  # row, first column, step, samples by pixel


def tiff_rows(part: dict) -> Iterator[Row]:
    """The rows of a strip or tile, without a tile's margin."""
    n, bits = part["width"] * part["bands"], part["bits"]
    rows = _Rows(_unpacked(part["payload"], part["compression"]))
    for y in range(part["shown_height"]):
        values = _samples(rows.take(-(-n * bits // 8)), n, part["type"], bits).reshape(-1, part["bands"])
        if part["predictor"] == 2 and part["type"][1] != "f" and bits >= 8:
            values = np.add.accumulate(values.astype(values.dtype.newbyteorder("=")), axis=0, dtype=values.dtype.newbyteorder("=").type)
        yield part["y0"] + y, part["x0"], 1, values[: part["shown_width"]]


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size:
            if name == b"IDAT":
                yield name, body
            return
        if zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Damaged("CHECKSUM")
        yield name, body
        at += size + 12


def unfiltered(kind: int, row: bytes, above: bytes, step: int) -> bytes:
    """A PNG row without its filter."""
    if kind == 0:
        return row
    if kind == 2:
        return (np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes()
    if kind == 1:
        whole = np.frombuffer(row + bytes(-len(row) % step), np.uint8).reshape(-1, step)
        return np.add.accumulate(whole, axis=0, dtype=np.uint8).tobytes()[: len(row)]
    out = bytearray(row)
    if kind == 3:
        for k in range(len(out)):
            out[k] = out[k] + ((out[k - step] if k >= step else 0) + above[k] >> 1) & 255
    elif kind == 4:
        for k in range(len(out)):
            a, b, c = (out[k - step], above[k], above[k - step]) if k >= step else (0, above[k], 0)
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[k] = out[k] + (a if p <= q and p <= r else b if q <= r else c) & 255
    else:
        raise Damaged("FILTER")
    return bytes(out)


def png_rows(data: bytes) -> Iterator[Row]:
    """The rows of a PNG; palette colours as red, green and blue."""
    head, palette, chunks = None, None, _chunks(data)
    first: list[bytes] = []
    for name, body in chunks:
        if name == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            first.append(body)
            break
    if head is None or not first:
        raise Damaged("CHUNKS")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in SAMPLES or bits not in (1, 2, 4, 8, 16) or interlaced > 1 or (colour == 3 and palette is None):
        raise Damaged("UNSUPPORTED")
    bands = SAMPLES[colour]

    def bodies() -> Iterator[bytes]:
        yield first.pop()
        for name, body in chunks:
            if name == b"IDAT":
                yield body

    rows = _Rows(_inflated(bodies()))
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        size = -(-w * bands * bits // 8)
        above = bytes(min(size, ROW_BYTES))
        for k in range(h):
            row = rows.take(size + 1)
            above = unfiltered(row[0], row[1:], above, max(1, bands * bits // 8))
            values = _samples(above, w * bands, ">u", bits).reshape(w, bands)
            if colour == 3:
                if values.max() >= len(palette):
                    raise Damaged("PALETTE")
                values = palette[values[:, 0]]
            yield y0 + k * dy, x0, dx, values


def part_rows(part: dict) -> Iterator[Row | str]:
    """The rows of a part, and if something is wrong what it is."""
    if part["problem"]:
        yield part["problem"]
        return
    try:
        yield from png_rows(part["payload"]) if part["kind"] == "PNG" else tiff_rows(part)
    except Damaged as e:
        yield str(e)
    except (struct.error, ValueError):
        yield "BROKEN"


def parts(files: DataFrame, key: str) -> DataFrame:
    """key, part (number) and what PART has, for each file (key, content)."""
    kind = to_arrow_type(files.schema[key].dataType)
    fields = [to_arrow_type(f.dataType) for f in schema(PART)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.sources.pixels import PART_NAMES, file_parts

        held, size = [], 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, p in enumerate(file_parts(data.as_py())):
                    held.append((name, k, p))
                    size += len(p.get("payload") or b"")
                    if size > 1 << 22 or len(held) >= 1 << 12:
                        yield out(held, PART_NAMES)
                        held, size = [], 0
        if held:
            yield out(held, PART_NAMES)

    def out(held, names) -> pa.RecordBatch:
        columns = [pa.array([n for n, _, _ in held], kind), pa.array([k for _, k, _ in held], pa.int32())]
        columns += [pa.array([p.get(c) for _, _, p in held], t) for c, t in zip(names, fields, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [key, "part", *names])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, part int, {PART}")


def decoded(files: DataFrame, key: str) -> DataFrame:
    """key, part, y, x0, step, band (from 0), values, problem: the rows of each
    part of each file (key, content) by band, the values at x0, x0 + step and
    so on; a part that is damaged has the rows before the damage and one row
    that names the problem.  Null and empty contents have the problem EMPTY."""
    dealt = parts(files, key).repartition(spread(files.sparkSession), key, "part")  # by number: a small part may hold many pixels
    name_type = to_arrow_type(files.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.sources.pixels import AT_ONCE, part_rows

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [name_type, *[pa.int32()] * 5, pa.list_(pa.float64()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "part", "y", "x0", "step", "band", "values", "problem"])

        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                if k % 64 == 0:
                    small = batch.slice(k, 64)
                    few = iter(small.to_pylist() if small.nbytes < 1 << 26 else [])
                part = next(few, None) or batch.slice(k, 1).to_pylist()[0]
                for row in part_rows(part):
                    if isinstance(row, str):
                        rows.append((part[key], part["part"], None, None, None, None, None, row))
                        continue
                    y, x0, step, values = row
                    values = values.astype(np.float64)
                    for b in range(values.shape[1]):
                        rows.append((part[key], part["part"], y, x0, step, (part["band"] or 0) + b, values[:, b], None))
                    size += values.size
                    if size > AT_ONCE:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    kind = files.schema[key].dataType.simpleString()
    return dealt.mapInArrow(run, f"{key} {kind}, part int, y int, x0 int, step int, band int, values array<double>, problem string")


def pixels(rows: DataFrame, key: str) -> DataFrame:
    """key, x, y, band, value of what ``decoded`` has read."""
    each = rows.where("problem IS NULL").select(key, "x0", "step", "y", "band", F.posexplode("values").alias("__k", "value"))
    return each.select(key, (F.col("x0") + F.col("__k") * F.col("step")).alias("x"), "y", "band", "value")


def problems(rows: DataFrame, key: str) -> DataFrame:
    """key, part, problem of what ``decoded`` couldn't read."""
    return rows.where("problem IS NOT NULL").select(key, "part", "problem")
