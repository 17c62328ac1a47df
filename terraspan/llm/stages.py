"""Stage functions of the corpus pipeline: documents in, documents out.

Each takes (spark, docs, sf_dir) and works on every row it is given.  All but
the packing stage return the columns of ``documents``.  Null and empty texts
are documents like any other: harmless, equal to each other, near nothing,
without words for the mix.  Rows are told apart by id and text, so null and
repeated ids share no fate unless their texts are equal too.  Columns may have
any name that doesn't begin with ``__ts_``.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspan.llm import exact_dedup, minhash, mixing, packing, toxicity
from terraspan.llm._spark import cut, text_or_empty
from terraspan.llm.queries import tokenizer_path

#: Documents that score this or more are rejected as toxic.
TOXIC = 0.5


def _text_digest() -> Column:
    return F.unhex(F.md5(text_or_empty().cast("binary")))


def _names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the learned lexicon calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    return toxicity.without_toxic(docs, lexicon, TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the
    smallest doc_id (null last; ties by the text's digest).  Rows that repeat
    id and text are one document here and stay or go together."""
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), _text_digest()).alias("__ts_key")
    keyed = docs.withColumn("__ts_key", key)
    found = minhash.near_duplicates(keyed, id_col="__ts_key")
    dropped = found.where(~F.col("kept")).select("__ts_key").distinct()
    return keyed.join(dropped, "__ts_key", "left_anti").select(*_names(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times).  Rows that
    repeat id, source and text share evenly what it takes of them."""
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("source"), _text_digest())
    keyed = docs.withColumn("__ts_key", key)
    taken = mixing.mix_sources(keyed, id_col="__ts_key").groupBy("__ts_key").agg(
        F.sum("copies").alias("__ts_sum"), F.count(F.lit(1)).alias("__ts_rows")
    )
    taken = cut(taken.where("__ts_sum > 0"))
    each, more = F.floor(F.col("__ts_sum") / F.col("__ts_rows")).cast("int"), F.pmod("__ts_sum", "__ts_rows")
    out = keyed.join(taken.where(more == 0), "__ts_key").withColumn("__ts_copies", each)
    odd = taken.where(more > 0)
    if not odd.isEmpty():  # repeated rows of which only some get one copy more
        place = F.row_number().over(W.partitionBy("__ts_key").orderBy("__ts_key"))
        out = out.unionByName(keyed.join(odd, "__ts_key").withColumn("__ts_copies", each + (place <= more).cast("int")))
    out = out.where("__ts_copies > 0")
    return out.select(*_names(docs), F.explode(F.sequence(F.lit(1), F.col("__ts_copies"))).alias("__ts_copy")).drop("__ts_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("pack", pack),
]
