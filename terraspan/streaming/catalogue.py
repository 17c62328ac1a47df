"""The catalogue as the sink of a stream of files.

Every micro-batch has a folder of its own for its scenes and one for the sums
over them, which it replaces if it runs again; known contents are state of the
stream.  So a file counts once, whatever is repeated, and totals are sums of a
few rows per batch.  One stream may read the folders of many writers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraspan.operators import catalog
from terraspan.sources import ingest, readers

#: What the catalogue keeps of a described file, besides the columns of a scene.
EXTRA = ["outcome"]


def read_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the raster files of a folder (or of a pattern of folders)."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", readers.RASTERS).option("maxFilesPerTrigger", per_batch).load(path)
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def new_scenes(files: DataFrame) -> DataFrame:
    """The first file of each content in a stream (file_name, content), with
    its outcome (NEW or why it is refused); the hashes are the stream's state.
    A refused file counts by its name too."""
    df = ingest.described(files).withColumn("outcome", F.coalesce("refused", F.lit("NEW"))).drop("refused")
    named = F.when(F.col("outcome") == "NEW", F.lit("")).otherwise(F.col("file_name"))
    return df.withColumn("__named", named).dropDuplicates(["file_hash", "__named"]).drop("__named")


def sums(scenes: DataFrame) -> DataFrame:
    """outcome, modality, format, scenes, bytes, georeferenced, latest."""
    return scenes.groupBy("outcome", "modality", "format").agg(
        F.count(F.lit(1)).alias("scenes"), F.sum("file_size_bytes").alias("bytes"), F.count_if(F.col("epsg").isNotNull()).alias("georeferenced"), F.max("ingested_at").alias("latest")
    )


def keep_batch(batch: DataFrame, number: int, path: str) -> None:
    """Writes a micro-batch and its sums, in place of what it wrote before."""
    where = f"{path}/scenes/batch={number}"
    batch.withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(where)
    sums(batch.sparkSession.read.parquet(where)).coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")


def ingest_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes all present files (a stream of file_name and content) into the
    catalogue at ``path`` and stops."""
    return (
        new_scenes(files).writeStream.foreachBatch(lambda batch, number: keep_batch(batch, number, path)).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """The scenes of the catalogue; files that can't be read are passed over."""
    kept = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{path}/scenes")
    return kept.where("outcome = 'NEW'").drop("batch", *EXTRA)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """facet, value, scenes, bytes, georeferenced, latest as a scan of all
    scenes gives them, from the batches' sums."""
    kept = spark.read.parquet(f"{path}/sums").where("outcome = 'NEW'")
    return catalog.merged_stats(kept)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """outcome, files: what became of the distinct files."""
    return spark.read.parquet(f"{path}/sums").groupBy("outcome").agg(F.sum("scenes").alias("files"))
