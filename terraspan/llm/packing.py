"""Packing by concatenating and cutting.

Pass 1 tokenises every document once, in place, and writes its ids with the
partition they belong to and their start inside it.  The token totals of the
partitions (one small row each) are summed to the global offset of every
partition.  Pass 2 reads the ids again and cuts the one global sequence at
multiples of the window: documents that cross a cut give a piece on either
side.  Only the last window of all can be short.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.llm._spark import as_table, ensure_importable, text_or_empty

LENGTH = 4096
END_ID = 2
#: Cached chunks and pieces per Python worker: entries of each of the two
#: generations, of CACHED characters at most, so of about 200 bytes and 50 MB
#: in all.
ENTRIES, CACHED = 125_000, 64

_BETWEEN = regex.compile(r"[\x20\x09-\x0D]+")
#: What str.split() takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Fixed value: how the tokenizer file splits lower-cased text into pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The steps of a tokenizer file that this module does itself.
_NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_PRE_TOKENIZERS = [("Split", _PIECES.pattern), ("ByteLevel", None)]
#: Chunks of these characters only are split here; any other goes through the
#: tokenizer whole.
_LAST = "\u024f"
_PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ɏ]+")


def _byte_chars() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _known_steps(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)

    def steps(part: str, inner: str) -> list[tuple[str, str | None]]:
        return [(x["type"], x.get("pattern", {}).get("Regex")) for x in (file.get(part) or {}).get(inner, ())]

    special = all(x["content"].startswith("<|") and not x["normalized"] for x in file["added_tokens"])
    return special and steps("normalizer", "normalizers") == _NORMALIZERS and steps("pre_tokenizer", "pretokenizers") == _PRE_TOKENIZERS


class Encoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)``
    gives them, with a cache of white-space-free chunks.

    The tokenizer drops white space and never joins characters across it, so
    a text's ids are its chunks' ids in turn.  That holds for files whose steps
    are ``_NORMALIZERS`` and ``_PRE_TOKENIZERS``; with any other file every
    text goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _known_steps(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = self.raw([END_ID])
        self.shown = {b: c for b, c in _byte_chars().items() if b != ord(c)}
        # a full cache becomes the old one; what is used again moves to the new one
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def raw(self, ids: list[int]) -> bytes:
        got = array(self.code, ids)
        if sys.byteorder == "big":
            got.byteswap()
        return got.tobytes()

    def whole(self, text: str) -> bytes:
        return self.raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def kept(self, text: str, ids: bytes) -> bytes:
        if len(text) <= CACHED:
            if len(self.ids) >= ENTRIES:
                self.old, self.ids = self.ids, {}
            self.ids[text] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of one piece: a run of lower-cased letters, a digit, a run of
        other characters.  As a chunk it has the same ids, so both share a cache."""
        if (got := self.ids.get(piece)) is not None:
            return got
        if (got := self.old.get(piece)) is None:
            got = self.tokenised(piece)
        return self.kept(piece, got)

    def tokenised(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return self.raw([t.id for t in self.model.tokenize(shown)])

    def chunk(self, chunk: str) -> bytes:
        if (got := self.old.get(chunk)) is None:
            body, end = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,!?" else (chunk, "")
            if body.isalpha() and (body.isascii() or (max(body) <= _LAST and "\u0130" not in body)):
                low = body.lower()  # one run of letters, perhaps with one mark behind it
                if low is chunk or low == chunk:
                    got = self.tokenised(low)
                else:
                    got = self.piece(low) + self.piece(end) if end else self.piece(low)
            elif not _PLAIN.fullmatch(chunk) or "<|" in chunk or "\u00ad" in chunk:
                got = self.whole(chunk)
            else:
                got = b"".join(map(self.piece, _PIECES.findall(chunk.lower())))
        return self.kept(chunk, got)

    def encode(self, text: str) -> bytes:
        if not self.known:
            return self.whole(text) + self.end
        parts = text.split() if _ODD.search(text) is None else [p for p in _BETWEEN.split(text) if p]
        chunk = self.chunk
        out: list[bytes] = []
        for k in range(0, len(parts), ENTRIES // 4):  # a full cache is another one
            get = self.ids.get
            out += [got if (got := get(p)) is not None else chunk(p) for p in parts[k : k + ENTRIES // 4]]
        out.append(self.end)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, start, id, n, ids: the documents' ids (END_ID last) as
    little-endian bytes, and their start within their partition."""
    ensure_importable(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from terraspan.llm.packing import encoder

        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                ids = [enc.encode(t) for t in piece.column(1).to_pylist()]
                n = np.array([len(b) // enc.dtype.itemsize for b in ids], np.int64)
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - n), piece.column(0),
                        pa.array(n), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), enc.dtype.itemsize, np.int32)),
                    ],
                    ["part", "start", "id", "n", "ids", "width"],
                )
                at = int(ends[-1])

    return base.mapInArrow(run, f"part int, start long, id {id_type}, n long, ids binary, width int")


def concat_and_cut(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, an array, if ``with_ids``)."""
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select(
        "id", (F.col("base") + F.col("start")).alias("at"), "ids", "width"
    )
    id_type = placed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, raw, width = (batch.column(k) for k in range(4))
            rows, starts, sizes, crcs, totals, pieces = [], [], [], [], [], []
            for k, (g, b, w) in enumerate(zip(at.to_pylist(), raw.to_pylist(), width.to_pylist(), strict=True)):
                full = np.frombuffer(b, f"<u{w}").astype("<u4")
                n, s = len(full), 0
                while s < n:
                    m = min(n - s, length - (g + s) % length)
                    rows.append(k)
                    starts.append(s)
                    sizes.append(m)
                    crcs.append(zlib.crc32(full[s : s + m].tobytes()))
                    totals.append(n)
                    if with_ids:
                        pieces.append(full[s : s + m].astype(np.int32))
                    s += m
            if not rows:
                continue
            where = np.asarray(at)[rows] + np.array(starts, np.int64)
            cols = [
                ids.take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()),
                pa.array(where // length), pa.array(where % length),
            ]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    extra = ", ids array<int>" if with_ids else ""
    return placed.mapInArrow(
        run,
        f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}",
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """Packs all rows into sequences of ``length`` tokens.

    Null and empty texts are the end id alone.  Repeated rows and null ids
    are packed like any other.  Texts of any length are encoded whole and cut
    where sequences end.  Extra columns are ignored, whatever their names.  An
    empty table gives no piece.
    """
    tokens = as_table(tokenised(docs, tokenizer, id_col, text_col), "tokens")
    return concat_and_cut(tokens, length, with_ids).withColumnRenamed("id", id_col)


assert unicodedata.is_normalized("NFC", "".join(chr(c) for c in range(0xA1, 0x250)))
