"""Bounded, seeded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 30


def bounded_sample(df: DataFrame, keys: tuple[str, ...], rows: int, total: int, seed: int = 7) -> DataFrame:
    """About ``rows`` of the distinct rows of ``df`` (all, if ``total``, its
    number of rows, is no more), chosen by a seeded hash of ``keys``; no sort,
    so nothing is gathered to choose them.  Rows that repeat the keys are
    chosen together, which is why only distinct ones are returned."""
    if total > rows:
        at_most = int(SPAN * rows / total)
        df = df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(SPAN)) < at_most)
    return df.distinct()


def labelled_rows(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """id, text, label of about ``rows`` labelled documents (twice as many at
    most, if ids repeat), in a fixed order.  ``docs``: id, text; ``known``:
    id, label, each id once."""
    chosen = bounded_sample(known, ("id",), rows, known.count())
    found = docs.join(F.broadcast(chosen), "id")
    return bounded_sample(found, ("id", "text"), 2 * rows, found.count()).orderBy("id", "text")
