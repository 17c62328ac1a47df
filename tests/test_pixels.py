"""Decoded pixels against the arrays that the files were made from."""

import itertools
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terraspan.sources import encoders, pixels, rasters


def read(data):
    """(array of the decoded pixels, NaN where there is none; problems)."""
    out, bad = {}, []
    for part in pixels.file_parts(data):
        part = dict.fromkeys(pixels.PART_NAMES) | part
        for row in pixels.part_rows(part):
            if isinstance(row, str):
                bad.append(row)
                continue
            y, x0, step, values = row
            for k, v in enumerate(values):
                for b, w in enumerate(v):
                    out[(y, x0 + k * step, (part["band"] or 0) + b)] = float(w)
    if not out:
        return None, bad
    m = np.full([max(k[j] for k in out) + 1 for j in range(3)], np.nan)
    for k, v in out.items():
        m[k] = v
    return m, bad


def image(seed, height, width, bands, dtype):
    rng = np.random.default_rng(seed)
    if np.dtype(dtype).kind == "f":
        return rng.normal(size=(height, width, bands)).astype(dtype)
    info = np.iinfo(dtype)
    m = rng.integers(info.min, info.max, (height, width, bands), dtype, endpoint=True)
    m[height // 2 :] = m[height // 2 :] // 50  # something to compress
    return m


@pytest.mark.parametrize(("bands", "dtype", "interlaced", "pieces"), list(itertools.product([1, 2, 3, 4], [np.uint8, np.uint16], [False, True], [1, 5])))
def test_png(bands, dtype, interlaced, pieces):
    for height, width in ((1, 1), (5, 7), (23, 18)):
        m = image(bands, height, width, bands, dtype)
        for filters in ((0, 1, 2, 3, 4), (4, 3)):
            got, bad = read(encoders.png(m, filters, interlaced, pieces) + b"trailing bytes")
            assert bad == [] and (got == m).all()


def test_png_of_few_bits_and_palettes():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 4, 8):
        m = rng.integers(0, 1 << bits, (6, 13))
        packed = np.packbits((m[..., None] >> np.arange(bits - 1, -1, -1) & 1).reshape(6, -1).astype(np.uint8), axis=1)
        whole = encoders.png(packed[..., None], (0,))
        head = struct.pack(">IIBBBBB", 13, 6, bits, 0, 0, 0, 0)
        at = whole.index(b"IDAT") - 4
        assert (read(whole[:8] + encoders._chunk(b"IHDR", head) + whole[at:])[0][..., 0] == m).all()
        colours = rng.integers(0, 256, (1 << bits, 3), np.uint8)
        head = struct.pack(">IIBBBBB", 13, 6, bits, 3, 0, 0, 0)
        got, bad = read(whole[:8] + encoders._chunk(b"IHDR", head) + encoders._chunk(b"PLTE", colours.tobytes()) + whole[at:])
        assert bad == [] and (got == colours[m]).all()
        assert read(whole[:8] + encoders._chunk(b"IHDR", head) + encoders._chunk(b"PLTE", b"") + whole[at:])[1] == ["PALETTE"]


@pytest.mark.parametrize(("compression", "dtype", "layout"), list(itertools.product(
    [1, 5, 8], [np.uint8, np.int16, np.uint32, np.float32, np.float64], [{}, {"rows": 4}, {"tile": (16, 16)}, {"rows": 3, "planar": 2}, {"tile": (16, 32), "planar": 2, "order": ">"}])))
def test_tiff(compression, dtype, layout):
    for bands in (1, 3):
        m = image(bands, 21, 37, bands, dtype)
        for predictor in (1, 2) if np.dtype(dtype).kind != "f" else (1,):
            got, bad = read(encoders.tiff(m, compression, predictor, **layout))
            assert bad == [] and (got == m).all()


@given(st.binary(max_size=400), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_lzw(data, times):
    assert b"".join(pixels._unlzw(encoders._lzw(data * times * 30))) == data * times * 30


def test_damage_is_reported():
    m = image(5, 40, 30, 3, np.uint8)
    png, strips = encoders.png(m, pieces=4), encoders.tiff(m, 8, rows=10)
    got, bad = read(png[: len(png) // 2])
    assert bad == ["TRUNCATED"] and (got == m[: len(got)]).all() and 5 < len(got) < 40
    broken = bytearray(png)
    broken[len(png) // 2] ^= 255
    assert read(bytes(broken))[1] == ["CHECKSUM"]
    broken = bytearray(strips)
    at = rasters.tiff_fields(strips, {273}, {273})[273]
    broken[at[2] : at[2] + 2] = b"zz"
    got, bad = read(bytes(broken))
    assert bad == ["INFLATE"] and np.isnan(got[20:30]).all() and (got[:20] == m[:20]).all() and (got[30:] == m[30:]).all()
    assert read(b"")[1] == ["EMPTY"] and read(None)[1] == ["EMPTY"] and read(b"GIF89a")[1] == ["UNSUPPORTED"] and read(b"II*\0\xff\xff\xff\xff")[1] == ["BROKEN"]
    wide = bytearray(encoders.tiff(m, 1, rows=10))
    k = wide.index(struct.pack("<HHI", 256, 4, 1)) + 8
    wide[k : k + 4] = struct.pack("<I", 1 << 30)
    assert set(read(bytes(wide))[1]) == {"TOO_WIDE"}


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_no_bytes_raise(data):
    m = image(2, 9, 11, 3, np.uint8)
    whole = bytearray(data.draw(st.sampled_from([encoders.png(m), encoders.png(m, interlaced=True), encoders.tiff(m, 5, 2, rows=4), encoders.tiff(m, 8, tile=(16, 16))])))
    for _ in range(data.draw(st.integers(1, 6))):
        whole[data.draw(st.integers(0, len(whole) - 1))] = data.draw(st.integers(0, 255))
    rasters.header(bytes(whole))
    read(bytes(whole[: data.draw(st.integers(0, len(whole)))]))


def test_counts_beyond_the_file_are_not_believed():
    entry = struct.pack("<HHII", 270, 2, 4_000_000_000, 8)
    for count, kind in ((300_000_000, 3), (4_000_000_000, 12), (4_000_000_000, 2)):
        entry = struct.pack("<HHII", 258, kind, count, 8)
        began = time.perf_counter()
        assert rasters.header(b"II*\0" + struct.pack("<IH", 8, 1) + entry + bytes(40))["kind"] == "BROKEN"
        assert time.perf_counter() - began < 0.5


def test_decoded_tables(spark):
    a, b = image(1, 30, 20, 3, np.uint8), image(2, 17, 9, 1, np.uint16)
    files = [("a", encoders.tiff(a, 5, 2, rows=7)), ("b", encoders.png(b)), ("c", None), ("d", b"text"), ("a2", encoders.tiff(a, 8, tile=(16, 16))[:-200])]
    df = spark.createDataFrame([(*f, 1) for f in files], "scene string, content binary, part int").repartition(3)
    rows = pixels.decoded(df, "scene")
    got = {(r.scene, r.y, r.x, r.band): r.value for r in pixels.pixels(rows, "scene").collect()}
    want = {(s, *k): float(v) for s, m in (("a", a), ("b", b)) for k, v in np.ndenumerate(m)}
    assert {k: v for k, v in got.items() if k[0] in "ab"} == want
    assert {(r.scene, r.problem) for r in pixels.problems(rows, "scene").collect()} == {("c", "EMPTY"), ("d", "UNSUPPORTED"), ("a2", "BROKEN")}
    assert pixels.decoded(df.limit(0), "scene").count() == 0


def test_small_files_are_spread(spark):
    """Keys of few bytes are one split, the images made of them aren't; parts go
    on in batches of many, however small a file is."""
    from terraspan.lineage import spread
    from terraspan.plans import ingest_queries

    files = ingest_queries._image_files(spark, "/root/testdata/sf0.001").cache()
    assert files.rdd.getNumPartitions() == spread(spark) >= 8
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert pixels.decoded(files, "k").rdd.getNumPartitions() == spread(spark)
    assert ingest_queries._files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spread(spark)
    files.unpersist()
