"""Image files from arrays (rows, columns, bands): PNG and TIFF; LMDB files
from items."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from terraspan.sources import lmdb as pages
from terraspan.sources.pixels import DEFLATE, LZW, PASSES, TAGS


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _filtered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> bytes:
    """A row of bytes less what its filter foretells."""
    left, corner = (np.concatenate([np.zeros(step, np.int64), x])[: len(x)] for x in (row, above))
    if kind == 4:
        p, q, r = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        guess = np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))
    else:
        guess = [0 * row, left, above, (left + above) // 2][kind]
    return bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()


def png(pixels: np.ndarray, filters: tuple[int, ...] = (0, 1, 2, 3, 4), interlaced: bool = False, pieces: int = 1) -> bytes:
    """A PNG of 1 to 4 bands of 8 or 16 bits; the filters take turns by row."""
    height, width, bands = pixels.shape
    size = pixels.dtype.itemsize
    stream = bytearray()
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        part = pixels[y0::dy, x0::dx]
        above = np.zeros(part.shape[1] * bands * size, np.int64)
        for k, row in enumerate(part if part.size else ()):
            own = np.frombuffer(row.astype(f">u{size}").tobytes(), np.uint8).astype(np.int64)
            stream += _filtered(filters[k % len(filters)], own, above, bands * size)
            above = own
    body = zlib.compress(bytes(stream))
    step = max(1, -(-len(body) // pieces))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[bands]
    head = struct.pack(">IIBBBBB", width, height, 8 * size, colour, 0, 0, interlaced)
    data = b"".join(_chunk(b"IDAT", body[k : k + step]) for k in range(0, len(body), step))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _lzw(data: bytes) -> bytes:
    """LZW codes of TIFF: first bit first, widened one code early."""
    out, room, table, width = 0, 0, {bytes([k]): k for k in range(256)}, 9
    codes: list[tuple[int, int]] = [(256, 9)]
    text, number = b"", 258
    for k in range(len(data)):
        longer = text + data[k : k + 1]
        if longer in table:
            text = longer
            continue
        codes.append((table[text], width))
        table[longer] = number
        number += 1
        text = data[k : k + 1]
        if number + 1 > 1 << width:
            width += 1
        if number == 4094:
            codes.append((256, width if width < 13 else 12))
            table, width, number = {bytes([k]): k for k in range(256)}, 9, 258
    if text:
        codes.append((table[text], width))
        number += 1
        if number + 1 > 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    for code, bits in codes:
        out, room = out << bits | code, room + bits
    return (out << -room % 8).to_bytes(-(-room // 8), "big")


def tiff(pixels: np.ndarray, compression: int = 1, predictor: int = 1, rows: int | None = None, tile: tuple[int, int] | None = None, planar: int = 1, order: str = "<") -> bytes:
    """A TIFF in strips of ``rows`` rows, or in tiles (width, height)."""
    height, width, bands = pixels.shape
    w, h = tile or (width, rows or height)
    planes = [pixels[:, :, b : b + 1] for b in range(bands)] if planar == 2 else [pixels]
    parts = []
    for plane in planes:
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = plane[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                body = part.astype(part.dtype.newbyteorder(order)).tobytes()
                parts.append(_lzw(body) if compression == LZW else zlib.compress(body) if compression == DEFLATE else body)
    form = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    offsets, at = [], 8
    for p in parts:
        offsets.append(at)
        at += len(p) + len(p) % 2
    sizes = [len(p) for p in parts]
    fields = {
        "width": [width], "height": [height], "bits": [8 * pixels.dtype.itemsize] * bands, "compression": [compression], "samples": [bands], "planar": [planar],
        "predictor": [predictor], "sample_format": [form] * bands,
    }
    fields |= {"tile_width": [w], "tile_height": [h], "tile_offsets": offsets, "tile_sizes": sizes} if tile else {"rows_per_strip": [h], "strip_offsets": offsets, "strip_sizes": sizes}
    entries, more, behind = b"", b"", at + 2 + 12 * len(fields) + 4
    for number, values in sorted((TAGS[k], v) for k, v in fields.items()):
        body = struct.pack(f"{order}{len(values)}I", *values)
        if len(body) > 4:
            place = struct.pack(order + "I", behind + len(more))
            more += body
        else:
            place = body
        entries += struct.pack(order + "HHI", number, 4, len(values)) + place
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + b"".join(p + b"\0" * (len(p) % 2) for p in parts) + struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0) + more


def lmdb(items: list[tuple[bytes, bytes]], page: int = 4096, most: int = 1 << 30) -> bytes:
    """An LMDB data file of the items (distinct keys); ``most``: nodes of a page."""
    body: list[bytes] = []  # from page 2

    def full(kind: int, nodes: list[bytes]) -> int:
        head, data, places = pages.HEAD + 2 * len(nodes), b"", []
        for n in nodes:
            data = n + b"\0" * (len(n) % 2) + data
            places.append(page - len(data))
        number = len(body) + 2
        body.append(struct.pack(f"<QHHHH{len(nodes)}H", number, 0, kind, head, page - len(data), *places) + bytes(page - head - len(data)) + data)
        return number

    def level(kind: int, nodes: list[tuple[bytes, bytes]]) -> list[tuple[bytes, int]]:
        out, held, size = [], [], pages.HEAD
        for key, n in [*nodes, (b"", b"")]:
            if held and (not n or len(held) >= most or size + len(n) + 3 > page):
                out.append((held[0][0], full(kind, [x for _, x in held])))
                held, size = [], pages.HEAD
            held.append((key, n))
            size += len(n) + len(n) % 2 + 2
        return out

    leaves, big = [], 0
    for key, value in sorted(items):
        flags, data = 0, value
        if len(key) + len(value) + 8 > (page - pages.HEAD) // 2 - 2:
            n = -(-(pages.HEAD + len(value)) // page)
            number = len(body) + 2
            whole = struct.pack("<QHHI", number, 0, pages.OVERFLOW, n) + value
            whole += bytes(n * page - len(whole))
            body.extend(whole[k : k + page] for k in range(0, len(whole), page))
            flags, data, big = pages.BIG, struct.pack("<Q", number), big + n
        leaves.append((key, struct.pack("<HHHH", len(value) & 0xFFFF, len(value) >> 16, flags, len(key)) + key + data))
    depth, nodes = (1, level(pages.LEAF, leaves)) if leaves else (0, [])
    n_leaves, n_branches = len(nodes), 0
    while len(nodes) > 1:
        links = [(key, struct.pack("<HHHH", to & 0xFFFF, to >> 16 & 0xFFFF, to >> 32, len(key) if k else 0) + (key if k else b"")) for k, (key, to) in enumerate(nodes)]
        nodes = level(pages.BRANCH, links)
        n_branches, depth = n_branches + len(nodes), depth + 1
    root = nodes[0][1] if nodes else pages.NO_PAGE

    def meta(number: int, transaction: int) -> bytes:
        none = struct.pack("<IHH5Q", page, 0, 0, 0, 0, 0, 0, pages.NO_PAGE)
        if not transaction:
            main = struct.pack("<IHH5Q", 0, 0, 0, 0, 0, 0, 0, pages.NO_PAGE)
        else:
            main = struct.pack("<IHH5Q", 0, 0, depth, n_branches, n_leaves, big, len(leaves), root)
        data = struct.pack("<QHHHH", number, 0, pages.META, 0, 0) + struct.pack("<IIQQ", pages.MAGIC, 1, 0, 1 << 30) + none + main + struct.pack("<QQ", len(body) + 1, transaction)
        return data + bytes(page - len(data))

    return meta(0, 0) + meta(1, 1) + b"".join(body)
