"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the lower-cased text (anything but
letters becomes one boundary mark), weighted by log term frequency times an
inverse document frequency that is counted over *all* training documents,
and scaled to unit length.  Weights are trained by follow-the-regularised-
leader with elastic-net penalties, which leaves most of them exactly zero,
and the softmax is calibrated by one temperature on rows kept from training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm._sample import bounded_sample
from terraspan.llm._spark import crc_mod, ensure_importable, text_or_empty

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
#: Labelled rows used to fit weights and temperature, at most (about).
TRAIN_ROWS = 3_000
UNKNOWN = "und"
STEP = 1 << 17
_TAPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def runs(texts: list[str], step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, code points, offsets) of runs of about ``step`` characters;
    every text is followed by one space."""
    first = 0
    while first < len(texts):
        last, total, part = first, 0, []
        while last < len(texts) and (last == first or total + len(texts[last]) < step):
            part.append(texts[last].lower())
            total += len(part[-1]) + 1
            last += 1
        codes = np.frombuffer((" ".join(part) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        yield first, last, codes, offsets
        first = last


def grams(codes: np.ndarray, buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per n: (valid, bucket) for the n-gram that starts at each character;
    and which characters are letters."""
    letter = letters()[np.minimum(codes, 0x10FFFF)]
    codes = np.where(letter, codes, np.uint32(0))
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    gap = np.concatenate([[0], np.cumsum(~letter, dtype=np.int32)])
    out, h = [], codes * _TAPS[0]
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        if n > 1:
            h = h[:m] + codes[n - 1 :] * _TAPS[n - 1]
        if n in GRAMS:
            # a boundary only at either end, and at least one letter
            valid = letter[:m] if n == 1 else (letter[:m] | letter[1 : 1 + m]) if n == 2 else gap[n - 1 : n - 1 + m] == gap[1 : 1 + m]
            g = h + np.uint32(n * 0x68E31DA4 & 0xFFFFFFFF)
            g ^= g >> np.uint32(16)
            g *= np.uint32(0x7FEB352D)
            g ^= g >> np.uint32(15)
            g *= np.uint32(0x846CA68B)
            g >>= shift
            out.append((valid, g))
    return out, letter


def counted(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Per text its distinct buckets and their counts; None without a letter."""
    for first, last, codes, offsets in runs([t or "" for t in texts]):
        kinds, letter = grams(codes, buckets)
        for k in range(last - first):
            a, b = offsets[k], offsets[k + 1]
            if not letter[a:b].any():
                yield None
                continue
            # what starts at the space behind the text would reach into the next one
            own = np.concatenate([ids[a : b - 1][valid[a : b - 1]] for valid, ids in kinds])
            counts = np.bincount(own, minlength=buckets)
            u = np.flatnonzero(counts)
            yield u, counts[u]


class Model:
    """Languages, idf, sparse weights (bucket x language), bias, temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.temperature = langs, float(temperature)
        self.idf, self.weights, self.bias = idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32)

    def vector(self, u: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n).astype(np.float32) * self.idf[u]
        norm = np.sqrt(x @ x)
        return x / norm if norm > 0 else x

    def logits(self, found) -> np.ndarray:
        u, n = found
        return self.vector(u, n) @ self.weights[u] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for k, found in enumerate(counted(texts, len(self.idf))):
            if found is None or not self.langs:
                langs.append(UNKNOWN)
                continue
            p = softmax(self.logits(found) / self.temperature)
            best = int(p.argmax())
            langs.append(self.langs[best])
            scores[k] = p[best]
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(
    texts: list[str | None], langs: list[str], idf: np.ndarray,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 5,
) -> Model:
    """FTRL-proximal on four fifths of the rows, temperature on the rest."""
    names = sorted(set(langs))
    buckets = len(idf)
    model = Model(names, idf, np.zeros((buckets, len(names))), np.zeros(len(names)), 1.0)
    if len(names) < 2:
        return model
    rows = [(found, names.index(y)) for found, y in zip(counted(texts, buckets), langs, strict=True) if found is not None]
    vectors = [(u, model.vector(u, n), y) for (u, n), y in rows]
    fit, held = [v for k, v in enumerate(vectors) if k % 5], vectors[::5]
    z, s = np.zeros((buckets + 1, len(names))), np.zeros((buckets + 1, len(names)))

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], s[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            u, x, y = fit[k]
            at = np.append(u, buckets)  # the last row is the bias
            xx = np.append(x, 1.0)
            w = weights(at)
            p = softmax(xx @ w)
            p[y] -= 1.0
            g = xx[:, None] * p
            sigma = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / alpha
            z[at] += g - sigma * w
            s[at] += g * g
    every = weights(np.arange(buckets + 1))
    model = Model(names, idf, every[:-1], every[-1], 1.0)
    scores = np.array([x @ model.weights[u] + model.bias for u, x, _ in held])
    truth = np.array([y for *_, y in held])
    if len(held):
        model.temperature = temperature(scores, truth)
    return model


def temperature(logits: np.ndarray, truth: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]))

    a, b, r = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, df: over every row of ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.langid import counted

        df = np.zeros(buckets, np.int64)
        rows = 0
        for batch in batches:
            for found in counted(batch.column(0).to_pylist(), buckets):
                rows += 1
                if found is not None:
                    df[found[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, buckets).astype(np.int32)), pa.array(np.append(df[at], rows))], ["bucket", "df"]
        )

    each = docs.select("text").mapInArrow(run, "bucket int, df long")
    return each.groupBy("bucket").agg(F.sum("df").alias("df"))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS, held_out: tuple[int, int] = (4, 2), buckets: int = BUCKETS,
) -> Model:
    """Learns from the rows with a language whose crc32 of the id isn't
    ``held_out[1]`` modulo ``held_out[0]``: document frequencies from all of
    them, weights from about ``train_rows`` distinct ones at most, in a fixed
    order.  Null ids are not held out; null texts count as empty and teach
    nothing; an id with two languages teaches both.  No such row: a model that
    answers ``und`` with score 0."""
    ensure_importable(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & (crc_mod(id_col, held_out[0]) != held_out[1])).select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    found = document_frequencies(known, buckets).toPandas()
    df = np.zeros(buckets + 1)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    total = int(df[-1])
    idf = np.log((1.0 + total) / (1.0 + df[:-1])) + 1.0
    rows = bounded_sample(known, ("id", "text"), train_rows, total).orderBy("id", "text", "lang").collect()
    return train([r.text for r in rows], [r.lang for r in rows], idf)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0; score is
    the calibrated probability.  Of languages with equal scores the first by
    code point is named.  Texts of any length are predicted whole; repeated
    rows and null ids are predicted each; an empty table gives an empty one;
    extra columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.langs, model.idf, model.weights, model.bias, model.temperature)
    )
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terraspan.llm.langid import Model

        m = Model(*shared.value)
        for batch in batches:
            langs, scores = m.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"]
            )

    return base.mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)
