"""Exact deduplication by skew-safe combining, DataFrame operations only.

Copies are combined in three steps, and every step groups by the full
normalised text beside its digest, so equal digests alone never merge rows:

1. locally: the partial aggregate before the exchange keeps one row per
   distinct text of a task's input;
2. by salted digest group: rows of a *hot* digest (one that holds at least
   ``1/hot_share`` of all rows, so there are at most ``hot_share`` of them and
   the list may be broadcast) are dealt over ``salts`` groups, all others over
   one;
3. globally: the salt winners of hot digests are combined; other groups are
   complete after step 2, and their text isn't moved again.

The text is shuffled once, that of a hot digest's salt winners twice.  The
result is mapped back to all rows by digest where a digest has one text
(always, for SHA-256), else by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm._spark import SPACE, cut, text_or_empty


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = 64,
    hot_share: int = 512,
    hot_rows: int = 1000,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, copy.

    Of equal texts (white-space runs count as one space; null counts as
    empty) the row with the smallest id stays.  Rows that repeat an id and a
    text are numbered by ``copy`` from 0; only copy 0 can stay.  Null ids lose
    against any other; a group of null ids only keeps one of them (keep_id
    null).  Columns other than id and text are ignored, whatever their names.
    Texts of any length count whole.  An empty table gives an empty result.

    ``digest`` may be replaced by a weaker function; the result stays exact.
    """
    found = _deduped(docs, id_col, text_col, digest, salts, hot_share, hot_rows)
    return found.drop("content").withColumnRenamed("id", id_col)


def _deduped(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], salts: int, hot_share: int, hot_rows: int) -> DataFrame:
    """id, keep_id, group_size, kept, digest, copy, and ``content``: the
    normalised text, if digests stand for several texts (else null)."""
    base = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm")))
    ids = cut(base.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")))
    total = ids.agg(F.sum("n")).first()[0] or 0
    limit = max(hot_rows, -(-total // hot_share))
    hot = ids.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") >= limit)
    hot = F.broadcast(hot.select("digest", F.lit(True).alias("hot")))

    def salted(df: DataFrame) -> DataFrame:
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(-1))
        return df.join(hot, "digest", "left").withColumn("salt", salt.cast("int")).drop("hot")

    def classes(*keys: str) -> DataFrame:
        """The texts with hot, keep_id, group_size and the given keys."""
        least, number = F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        groups = salted(base).groupBy("salt", "digest", "norm").agg(least, number)
        ready = groups.where("salt < 0").select(*keys, F.lit(False).alias("hot"), "keep_id", "group_size")
        winners = groups.where("salt >= 0").groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        return ready.unionByName(winners.select(*keys, F.lit(True).alias("hot"), "keep_id", "group_size"))

    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
    each = cut(classes("digest"))
    clash = each.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if clash.isEmpty():
        targets = each.select("digest", F.explode(spread).alias("salt"), "keep_id", "group_size")
        out = salted(ids).join(targets, ["digest", "salt"], "left").withColumn("content", F.lit(None).cast("string"))
    else:  # different texts under one digest: map back by the text as well
        targets = classes("digest", "norm").select("digest", "norm", F.explode(spread).alias("salt"), "keep_id", "group_size")
        counted = salted(base.groupBy("id", "digest", "norm").agg(F.count(F.lit(1)).alias("n")))
        out = counted.join(targets, ["digest", "norm", "salt"], "left").withColumnRenamed("norm", "content")
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    return out.select(
        "id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        "digest",
        "copy",
        "content",
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = 64,
    hot_share: int = 512,
    hot_rows: int = 1000,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One row per text, the one with the smallest id; of rows that repeat id and
    text (also with other values elsewhere) any one.  Null ids lose against
    any other.  An empty table gives an empty one.
    """
    kept = _deduped(docs, id_col, text_col, digest, salts, hot_share, hot_rows).where("kept")
    kept = kept.select(F.col("id").alias("__ts_id"), F.col("digest").alias("__ts_kept"), F.col("content").alias("__ts_content"))
    norm = normalised(text_col)
    mark = docs.withColumn("__ts_digest", digest(norm))
    same = F.col("__ts_content").isNull() | (F.col("__ts_content") == norm)
    joined = mark.join(kept, F.col(id_col).eqNullSafe(F.col("__ts_id")) & (F.col("__ts_digest") == F.col("__ts_kept")) & same)
    return joined.dropDuplicates([id_col, "__ts_digest", "__ts_content"]).select(*[F.col(f"`{c}`") for c in docs.columns])
