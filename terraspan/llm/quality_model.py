"""Quality classifier on supervised subword embeddings.

A document is the mean of the learned vectors of its words and of the character
n-grams inside them (with the white space on either side), all hashed to
``buckets`` rows; a softmax layer gives the label.  Vectors and layer are
trained together by stochastic gradient descent in numpy.  Because the layer
is linear in the mean, scoring needs one number per bucket: its vector times
the difference of the two output rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm import _features as ft
from terraspan.llm._sample import labelled_rows
from terraspan.llm._spark import crc_mod, ensure_importable, text_or_empty

BUCKETS = 1 << 18
GRAMS = (2, 3, 4)
DIM = 12
#: Labelled rows used for training, at most (about: chosen by hash).
TRAIN_ROWS = 6_000
#: Fixed value: the bucket (modulo their number) of a word that repeats the one before.
AGAIN = 0x5EED
_TAPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """(positions or None, valid or None, buckets) of each kind of feature.

    Kinds are the words, the pseudo-word of a word that repeats the one before
    it, and the n-grams of each length; positions None means every character,
    of which those marked valid start an n-gram.  ``buf`` holds the code points
    of texts with a space behind each, ``offsets`` where they begin and end.
    """
    space = ft.is_space(buf)
    starts, ends = ft.words(buf, space)
    hashes = ft.word_hashes(buf, starts, ends)
    yield starts, None, (hashes % np.uint64(buckets)).astype(np.uint32)
    own = np.searchsorted(offsets, starts, side="right")
    again = starts[1:][(hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])]
    yield again, None, np.full(len(again), AGAIN % buckets, np.uint32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    codes = np.where(space, np.uint32(32), buf).astype(np.uint32) + np.uint32(1)
    inner = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    h = codes * _TAPS[0]
    for n in range(2, max(grams) + 1):
        if len(buf) < n:
            break
        m = len(buf) - n + 1
        h = h[:m] + codes[n - 1 :] * _TAPS[n - 1]
        if n in grams:
            # white space only at either end, and not at both of a window of two
            clean = ~(space[:m] & space[1:]) if n == 2 else inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]
            behind = offsets[1:] - 1  # what starts there would reach into the next text
            clean[behind[behind < m]] = False
            g = h + np.uint32(n)
            g ^= g >> np.uint32(15)
            g *= np.uint32(0x2C1B3C6D)
            g >>= shift
            yield None, clean, g


class Model:
    """``weights``: each bucket's part in the log-odds of label 1."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights.astype(np.float32), float(bias), float(prior)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for first, last, raw, ends in ft.joined(texts):
            buf, offsets = ft.characters(raw, ends)
            total = np.zeros(last - first)
            count = np.zeros(last - first)
            for at, valid, ids in features(buf, offsets, len(self.weights)):
                values = self.weights[ids]
                if at is not None:
                    cuts = np.searchsorted(at, offsets)
                    count += np.diff(cuts)
                else:
                    cuts = np.minimum(offsets, len(values))
                    values *= valid
                    count += ft.segment_sums(valid, cuts)
                total += ft.segment_sums(values, cuts)
            z = total / np.maximum(count, 1) + self.bias
            worded = ft.segment_sums(~ft.is_space(buf), offsets) > 0
            out[first:last] = np.where(worded, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.prior)
        return out


def document_features(texts: list[str | None], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their shares of its features."""
    docs = []
    for first, last, raw, ends in ft.joined(pa.array(texts, pa.large_string())):
        buf, offsets = ft.characters(raw, ends)
        kinds = list(features(buf, offsets, buckets))
        cuts = [np.searchsorted(at, offsets) if at is not None else np.minimum(offsets, len(ids)) for at, _, ids in kinds]
        for k in range(last - first):
            own = []
            for (_, valid, ids), c in zip(kinds, cuts, strict=True):
                a, b = c[k], c[k + 1]
                own.append(ids[a:b] if valid is None else ids[a:b][valid[a:b]])
            u, n = np.unique(np.concatenate(own), return_counts=True)
            docs.append((u, (n / max(1, n.sum())).astype(np.float32)))
    return docs


def train(
    texts: list[str | None], labels: np.ndarray, dim: int = DIM, epochs: int = 6, rate: float = 0.5,
    buckets: int = BUCKETS, seed: int = 3,
) -> Model:
    """Fits vectors and output layer; one label only or none gives a constant."""
    labels = np.asarray(labels, np.int64)
    prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(buckets), np.log(prior / (1 - prior)), prior)
    docs = document_features(texts, buckets)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            lr = rate * (1 - done / steps)
            done += 1
            u, share = docs[k]
            if not len(u):
                continue
            rows = vectors[u]
            mean = share @ rows
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1.0
            back = layer.T @ p
            layer -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            # shares are small: scale a vector's step by the document's length
            vectors[u] = rows - (lr * 20.0 * share)[:, None] * back
    diff = vectors @ (layer[1] - layer[0])
    return Model(diff, bias[1] - bias[0], prior)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = TRAIN_ROWS, held_out: tuple[int, int] = (5, 0), epochs: int = 6,
) -> Model:
    """Trains on at most about ``train_rows`` labelled rows whose crc32 of the
    id isn't ``held_out[1]`` modulo ``held_out[0]``; null ids and labels are
    left out, of repeated labels the largest counts, repeated documents count
    each.  With no labelled row the model is a constant."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(crc_mod(id_col, held_out[0]) != held_out[1])
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    rows = labelled_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, train_rows).collect()
    return train([r.text for r in rows], np.array([r.label for r in rows], np.int64), epochs=epochs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row's whole text; texts without a word,
    empty or null, get the share of label 1 among the training rows.  Texts of
    any length are scored whole, in runs of bounded size unless one is longer;
    repeated rows and null ids are scored each, an empty table gives an empty
    one, extra columns are ignored."""
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prior))
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.quality_model import Model

        m = Model(*shared.value)
        for batch in batches:
            s = pa.array(m.scores(batch.column(1)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], ["id", "score"])

    return base.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
