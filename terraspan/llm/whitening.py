"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become integers, so that counts, sums and deviations are exact.  The
centred rows are compressed by blockwise TSQR: each task folds its batches
into one triangle R (as wide as a vector), and triangles are folded in groups
of ``FAN`` until few are left.  Plane rotations then make R's columns
orthogonal; the columns' norms are the standard deviations, to full relative
precision since no covariance is ever formed, and the accumulated rotations
are the components.  Only triangles of the vectors' width reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm._spark import as_table, cut, ensure_importable

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this are taken as this; their sums over a batch stay exact.
MOST = 1 << 46
COMPONENTS = 8
#: Triangles (or partial covariances) that are folded into one.
FAN_BITS = 4
#: Sweeps of rotations at most; some ten are enough.
SWEEPS = 60


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x: the integer entries of rows whose vector is whole and finite."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN counts as larger
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-MOST))), F.lit(float(MOST)))) + SHIFT)
    return rows.where(F.col("v").isNotNull() & fine & (F.size("v") > 0)).select("id", x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where these hold it, else Python's."""
    reach = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums) if len(x) else 0
    return x * n - np.array(sums, np.int64) if reach < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def squared_lengths(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    most = max(abs(int(d.min())), abs(int(d.max()))) if len(d) else 0
    if most * most * d.shape[1] < 1 << 62:
        return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in d]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once."""
    return (scaled_deviations(x, n, sums) / n).astype(np.float64)


def fold(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the rows below a triangle."""
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def rotations(r: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(norms, V): plane rotations V that make the columns of ``r @ V``
    orthogonal, sorted by falling norm.  Pairs are turned in rounds of a
    tournament, in which every column has one partner."""
    width = r.shape[1]
    a, v = r.astype(np.float64).T.copy(), np.eye(width)  # a row per column
    seats = np.arange(width + width % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            todo = np.abs(xy) > np.finfo(float).eps * np.sqrt(xx * yy)
            if todo.any():
                turned = True
                p, q, x, y = p[todo], q[todo], x[todo], y[todo]
                zeta = (yy[todo] - xx[todo]) / (2 * xy[todo])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = (c * t)[:, None]
                c = c[:, None]
                a[p], a[q] = c * x - s * y, s * x + c * y
                x, y = v[p], v[q]
                v[p], v[q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    norms = np.sqrt((a * a).sum(1))
    order = np.argsort(-norms, kind="stable")
    v = v[order] / np.sqrt((v[order] ** 2).sum(1, keepdims=True))
    sign = np.sign(v[np.arange(width), np.abs(v).argmax(1)])
    return norms[order], (v * sign[:, None]).T


def joined_moments(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, centred sums of products) of all parts."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def _few(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> list[bytes]:
    """``parts`` (part, body), one row per task, merged in groups of 16 until
    that many are left at most."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")
        return pa.table({"part": rows["part"][:1], "body": pa.array([merge(rows["body"].to_pylist())], pa.binary())})

    parts = cut(parts)
    while parts.count() > 1 << FAN_BITS:
        groups = parts.withColumn("part", F.shiftright("part", FAN_BITS)).groupBy("part")
        parts = cut(groups.applyInArrow(run, "part int, body binary"))
    return [r.body for r in parts.orderBy("part").collect()]


def _per_task(x: DataFrame, start: Callable[[], object], step: Callable, body: Callable[[object], bytes]) -> DataFrame:
    """part, body: what a task has gathered from its batches, if it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = start()
        for batch in batches:
            if batch.num_rows:
                held = step(held, batch.column(0))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([body(held)], pa.binary())], ["part", "body"])

    return x.select("x").mapInArrow(run, "part int, body binary")


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and
    identity_error, for each vector and component.

    Rows whose vector is null, empty or holds a null or an entry that isn't
    finite are dropped; so are vectors of another length than most have (of
    equally many, the longer).  Repeated rows count each, a null id is an id.
    A component without variance has explained 0 and whitened null and doesn't
    count in identity_error, which is null if there is no other; explained is
    null if nothing varies.  ``deviation`` is null where a long doesn't hold
    it.  Entries beyond 2**46 / 1024 are taken as that.  An empty table gives
    an empty one.  Extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = as_table(integers(vectors, id_col, vec_col), "vectors")
    usual = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    width, n = usual["width"], usual["count"]
    x = x.where(F.size("x") == width)

    def add(held: list[int] | None, column: pa.Array) -> list[int]:
        own = _matrix(column, width).sum(axis=0).tolist()
        return own if held is None else [a + b for a, b in zip(held, own, strict=True)]

    def sums_of(bodies: list[bytes]) -> list[int]:
        return [sum(c) for c in zip(*([int(s) for s in b.split()] for b in bodies), strict=True)]

    def as_words(sums: list[int]) -> bytes:
        return " ".join(map(str, sums)).encode()

    sums = sums_of(_few(_per_task(x, lambda: None, add, as_words), lambda b: as_words(sums_of(b))))

    def triangle_of(bodies: list[bytes]) -> np.ndarray:
        r = None
        for b in bodies:
            r = fold(r, np.frombuffer(b).reshape(-1, width))
        return r

    triangles = _per_task(x, lambda: None, lambda r, c: fold(r, centred(_matrix(c, width), n, sums)), lambda r: r.tobytes())
    norms, turns = rotations(triangle_of(_few(triangles, lambda b: triangle_of(b).tobytes())))
    shown = min(components, width)
    live = int((norms[:shown] > width * np.finfo(float).eps * norms[0]).sum())
    to_white = turns[:, :live] * (np.sqrt(n) / norms[:live])
    total = float((norms**2).sum())
    explained = [float(s * s) / total if total else None for s in norms[:shown]]
    explained[live:] = [0.0 if total else None] * (shown - live)

    error = None
    if live:

        def moments(held, column: pa.Array):
            w = centred(_matrix(column, width), n, sums) @ to_white
            mean = w.mean(axis=0)
            part = len(w), mean, (w - mean).T @ (w - mean)
            return part if held is None else joined_moments([held, part])

        def body(p) -> bytes:
            return np.concatenate([[p[0]], p[1], p[2].ravel()]).tobytes()

        def parts_of(bodies: list[bytes]):
            flat = [np.frombuffer(b) for b in bodies]
            return joined_moments([(int(f[0]), f[1 : 1 + live], f[1 + live :].reshape(live, live)) for f in flat])

        count, _, products = parts_of(_few(_per_task(x, lambda: None, moments, body), lambda b: body(parts_of(b))))
        error = float(np.abs(products / count - np.eye(live)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            exact = scaled_deviations(_matrix(batch.column(1), width), n, sums)
            white = np.full((m, shown), np.nan)
            white[:, :live] = (exact / n).astype(np.float64) @ to_white
            lengths = [d if d < 1 << 63 else None for d in squared_lengths(exact)]
            rows = np.repeat(np.arange(m), shown)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)), pa.array(np.full(m * shown, n)),
                    pa.array(lengths, pa.int64()).take(pa.array(rows)), pa.array(white.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * shown), pa.float64()),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select("id", "x").mapInArrow(run, schema)
