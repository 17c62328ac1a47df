"""Near duplicates by SimHash fingerprints, compared exactly in tiles.

Rows of equal fingerprints are one node.  Nodes lie in classes by the
population counts of the fingerprint's four quarters; a class is cut into
tiles of about ``TILE`` nodes by hash.  Two fingerprints that differ in r bits
have quarter counts that differ by r in sum at most, so pairs of tiles whose
counts differ by more than the radius are skipped; all others are compared in
full with numpy: exclusive-or, bit counts.  A pair of tiles returns a star for
each group of linked nodes in it, at most one row per node, and connected
components join these up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm._components import components, join_in_place
from terraspan.llm._spark import as_table, cut, ensure_importable

RADIUS = 2
WORDS = 3
SEED = 42
#: Nodes of a tile, about; 128 KB.
TILE = 1 << 14
#: Comparisons at once: 8 MB.
AT_ONCE = 1 << 20
#: Bytes of text handled at once.
STEP = 1 << 20
#: Quarters are counted in base 32: a count of 0 to 16 and a difference beside
#: it stay apart.
BASE_BITS, QUARTERS = 5, 4

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, step: int) -> Iterator[list[bytes]]:
    """The words of ``text`` in runs of about ``step`` bytes.  ``split`` and
    ``lower`` of bytes treat the white space and letters of ASCII only."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + step) if len(text) - at > step else None
        end = found.start() if found else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, words: int = WORDS, step: int = STEP) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles, repeats included."""
    import xxhash

    held: list[bytes] = []
    some = False
    for piece in _pieces(text, step):
        held += piece
        if len(held) >= words:
            some = True
            joined = map(b" ".join, zip(*(held[k:] for k in range(words)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(held) - words + 1)
            held = held[len(held) - words + 1 :]
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes | None, words: int = WORDS, step: int = STEP) -> int:
    """Bits that are set in over half the hashes; zero without a word."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text or b"", words, step):
        total += len(h)
        for k in range(0, len(h), 1 << 14):
            part = h[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every row."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.simhash import fingerprint

        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def near(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all fingerprints with at most ``radius``
    differing bits."""
    rows = max(1, AT_ONCE // max(1, len(b)))
    found = [np.nonzero(np.bitwise_count(a[k : k + rows, None] ^ b[None, :]) <= radius) for k in range(0, len(a), rows)]
    left = [i + k for (i, _), k in zip(found, range(0, len(a), rows), strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *(j for _, j in found)])


def stars(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, first of its group) for the links (i, j) between ``values``."""
    first = np.arange(len(values))
    while True:
        low = np.minimum(first[i], first[j])
        new = first.copy()
        np.minimum.at(new, first[i], low)
        np.minimum.at(new, first[j], low)
        new = new[new]
        if (new == first).all():
            break
        first = new
    moved = np.flatnonzero(first != np.arange(len(values)))
    return values[moved], values[first[moved]]


def _quarters(fp: Column) -> Column:
    """The class: population counts of the quarters, in base 32."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(QUARTERS)]
    return sum((F.shiftleft(c, BASE_BITS * k) for k, c in enumerate(counts)), F.lit(0))


def _differences(radius: int) -> list[int]:
    """Differences of classes, none negative, whose counts differ by
    ``radius`` in sum at most."""
    some = product(range(-radius, radius + 1), repeat=QUARTERS)
    steps = (sum(d << BASE_BITS * k for k, d in enumerate(x)) for x in some if sum(map(abs, x)) <= radius)
    return sorted(x for x in steps if x >= 0)


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links that connect all fingerprints (fp, each once) with at most
    ``radius`` differing bits."""
    spark = nodes.sparkSession
    ensure_importable(spark)
    nodes = nodes.select("fp", _quarters(F.col("fp")).alias("cls"))
    # there are 17**4 = 83,521 classes at most, whatever the data
    classes = cut(nodes.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))
    number = F.shiftleft(F.col("cls").cast("long"), 32) + F.pmod(F.xxhash64("fp"), F.col("tiles"))
    placed = nodes.join(F.broadcast(classes), "cls").select("fp", number.alias("tile"))
    tiles = as_table(placed.groupBy("tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    right = classes.select(F.col("cls").alias("other"), F.col("tiles").alias("more"))
    both = classes.withColumn("other", F.explode(F.array([F.col("cls") + x for x in _differences(radius)]))).join(F.broadcast(right), "other")
    both = both.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"))
    both = both.select("*", F.explode(F.sequence(F.when(F.col("cls") == F.col("other"), F.col("i")).otherwise(0), F.col("more") - 1)).alias("j"))
    units = both.select(
        (F.shiftleft(F.col("cls").cast("long"), 32) + F.col("i")).alias("a"), (F.shiftleft(F.col("other").cast("long"), 32) + F.col("j")).alias("b")
    )
    units = units.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("x")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.simhash import near, stars

        for batch in batches:
            for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                left, right = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                same = a.as_py() == b.as_py()
                i, j = near(left, right, radius)
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    node, root = stars(left if same else np.concatenate([left, right]), i, j if same else j + len(left))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

    return units.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links between fingerprints
    of at most ``radius`` differing bits.  Texts that are null, empty or
    without a word have fingerprint zero, which links like any other.  Rows
    with a null id take part, but never give a component its id; a component
    of such rows only has component_id null.  Rows that repeat an id are
    returned each.  Texts of any length count whole.  An empty table gives an
    empty one.  Extra columns are ignored, whatever their names.
    """
    rows = as_table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    size = F.count(F.lit(1)).alias("__ts_n")
    nodes = as_table(rows.groupBy("fp").agg(F.min("id").alias("least"), size), "nodes")
    comps = components(cut(links(nodes.select("fp"), radius, tile))).select(F.col("node").alias("fp"), "comp")
    grouped = cut(nodes.join(comps, "fp", "left").withColumn("g", F.coalesce("comp", "fp")).drop("comp"))
    least = grouped.groupBy("g").agg(F.min("least").alias("component_id"), size)
    known = join_in_place(grouped.select("fp", "g", F.col("__ts_n").alias("n")), least, "g", grouped.count())
    known = cut(known.select("fp", "component_id", F.col("n").alias("__ts_n")))
    return join_in_place(rows, known, "fp", rows.count()).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
