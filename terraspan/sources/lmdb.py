"""LMDB files as a Spark data source: keys and values, read by key range.

``spark.read.format("lmdb").load(path)`` reads a data file, the folder that
holds one, or a folder of such folders.  A partition is a set of neighbouring
subtrees of one file's B+ tree, or of many files some whole ones; its task reads
the pages below them.
"""

from __future__ import annotations

import io
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The mark of a meta page, kinds of pages and nodes, sizes.
MAGIC = 0xBEEFC0DE
BRANCH, LEAF, OVERFLOW, META = 1, 2, 4, 8
BIG, SUB, DUPLICATES = 1, 2, 4
HEAD, NO_PAGE = 16, (1 << 64) - 1
#: Partitions of a file at most, and bytes of a batch, about.
PARTS, BATCH = 64, 1 << 22
#: Partitions of all files, or as many as have so many bytes, if that is more.
MOST, PART_BYTES = 128, 1 << 26


class Damaged(ValueError):
    """A file that isn't what it should be."""


class Tree:
    """The pages of one file."""

    def __init__(self, file):
        self.file = file
        self.size = file.size() if hasattr(file, "size") else file.seek(0, 2)
        metas = []
        first = self._bytes(0, 4096)
        for at in (0, self._page_size(first)):
            found = self._meta(self._bytes(at, 256))
            if found:
                metas.append(found)
        if not metas:
            raise Damaged("no meta page")
        _, self.page, self.root, self.entries = max(metas)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    @staticmethod
    def _page_size(page: bytes) -> int:
        return struct.unpack_from("<I", page, HEAD + 24)[0] if len(page) >= HEAD + 28 else 4096

    @staticmethod
    def _meta(page: bytes) -> tuple[int, int, int, int] | None:
        """(transaction, page size, root, entries) of a meta page."""
        if len(page) < HEAD + 136 or struct.unpack_from("<I", page, HEAD)[0] != MAGIC:
            return None
        main = HEAD + 24 + 48
        entries, root = struct.unpack_from("<QQ", page, main + 32)
        return struct.unpack_from("<Q", page, main + 48 + 8)[0], Tree._page_size(page), root, entries

    def nodes(self, number: int) -> tuple[int, list[tuple[bytes, object]]]:
        """(kind, nodes) of a page: (key, page) of a branch, (key, value) of a leaf."""
        page = self._bytes(number * self.page, self.page)
        if len(page) < HEAD:
            raise Damaged(f"page {number} is beyond the end")
        _, _, kind, lower, _ = struct.unpack_from("<QHHHH", page)
        if not kind & (BRANCH | LEAF):
            raise Damaged(f"page {number} is of kind {kind}")
        out: list[tuple[bytes, object]] = []
        for at in struct.unpack_from(f"<{(lower - HEAD) // 2}H", page, HEAD):
            low, high, flags, key_size = struct.unpack_from("<HHHH", page, at)
            key, place = page[at + 8 : at + 8 + key_size], at + 8 + key_size
            if kind & BRANCH:
                out.append((key, low | high << 16 | flags << 32))
                continue
            if flags & (SUB | DUPLICATES):
                raise Damaged("named databases and duplicate keys aren't read")
            size = low | high << 16
            if flags & BIG:
                far = struct.unpack_from("<Q", page, place)[0]
                out.append((key, self._bytes(far * self.page + HEAD, size)))
            else:
                out.append((key, page[place : place + size]))
        return kind, out

    def subtrees(self, least: int) -> list[int]:
        """Neighbouring pages, in key order, that have all items below them:
        ``least`` or more, if the tree is large enough."""
        level = [] if self.root == NO_PAGE or not self.entries else [self.root]
        while 0 < len(level) < least:
            found = [self.nodes(p) for p in level]
            if not found[0][0] & BRANCH:
                break
            level = [page for _, nodes in found for _, page in nodes]
        return level

    def items(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        """The items below a page, in key order."""
        kind, nodes = self.nodes(number)
        for key, x in nodes:
            if kind & BRANCH:
                yield from self.items(x)
            else:
                yield key, x


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.base_name == "data.mdb")


def _opened(path: str) -> Tree:
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return Tree(system.open_input_file(root))


class Subtrees(InputPartition):
    """(path, pages) of files; no pages: the whole file."""

    def __init__(self, parts: list[tuple[str, list[int] | None]]):
        self.parts = parts


class LmdbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", PARTS))

    def partitions(self) -> list[Subtrees]:
        files = _files(self.path)
        most = max(MOST, sum(size for _, size in files) // PART_BYTES)
        if len(files) * self.parts <= most:
            return [x for path, _ in files for x in self._split(path, self.parts)] or [Subtrees([])]
        # many files: none is opened here but those that are larger than a partition
        share, out, held, size = sum(n for _, n in files) / most, [], [], 0
        for path, n in files:
            if n >= 2 * share and self.parts > 1:
                out += self._split(path, min(self.parts, int(n / share)))
                continue
            held.append((path, None))
            size += n
            if size >= share:
                out.append(Subtrees(held))
                held, size = [], 0
        return out + [Subtrees(held)] if held else out

    @staticmethod
    def _split(path: str, parts: int) -> list[Subtrees]:
        pages = _opened(path).subtrees(parts)
        step = max(1, -(-len(pages) // parts))
        return [Subtrees([(path, pages[k : k + step])]) for k in range(0, len(pages), step)]

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, pages in partition.parts:
            tree = _opened(path)
            for page in tree.subtrees(1) if pages is None else pages:
                for item in tree.items(page):
                    held.append(item)
                    size += len(item[1])
                    if size > BATCH:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)


def _batch(items: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in items], pa.binary()) for j in (0, 1)], ["key", "value"])


class LmdbSource(DataSource):
    """key, value of every item; option ``partitions``: of a file, at most about."""

    @classmethod
    def name(cls) -> str:
        return "lmdb"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> LmdbReader:
        return LmdbReader(dict(self.options))


def read(spark: SparkSession, path: str, partitions: int = PARTS) -> DataFrame:
    """key, value of the files at ``path``."""
    spark.dataSource.register(LmdbSource)
    return spark.read.format("lmdb").option("partitions", partitions).load(path)


class _Arrays(pickle.Unpickler):
    """Loads arrays in lists and dicts, and nothing that could run code."""

    ALLOWED = {
        ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"),
        ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("_codecs", "encode"),
        ("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer"),
    }

    def find_class(self, module: str, name: str):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't an array")
        return super().find_class(module, name)


def bands_of(value: bytes) -> dict[str, np.ndarray]:
    """The square bands of a pickled patch (a dict of arrays)."""
    found = _Arrays(io.BytesIO(value)).load()
    if not isinstance(found, dict) or not all(isinstance(a, np.ndarray) and a.ndim == 2 and a.shape[0] == a.shape[1] for a in found.values()):
        raise pickle.UnpicklingError("not a dict of square arrays")
    return {str(k): v for k, v in found.items()}


def patch_bands(items: DataFrame) -> DataFrame:
    """patch, band, side, values, problem: the bands of pickled patches (key,
    value), for ``training.stack_bands``; a value that isn't one has a problem
    and no band."""
    out = "patch string, band string, side int, values array<double>, problem string"
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.sources.lmdb import bands_of

        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                name = key.as_py().decode("utf-8", "replace")
                try:
                    rows += [(name, b, len(m), m.astype(float).ravel().tolist(), None) for b, m in bands_of(value.as_py()).items()]
                except Exception as e:  # a pickle may fail in any way
                    rows.append((name, None, None, None, str(e)[:200] or type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in out.split(", ")])

    return items.select("key", "value").mapInArrow(run, out)
