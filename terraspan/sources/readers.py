"""Readers of the engine's tables, raster folders and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan import schemas
from terraspan.functions.language import file_format, from_file_name, scene_id

#: Fixed value: raster files of a folder.
RASTERS = "*.{tif,tiff,geotiff,png,jpg,jpeg}"


def _kept(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of the engine: empty if there is none yet, and without the
    files that can't be read."""
    s, where = schemas.schema(kind), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], s)
    return spark.read.schema(s).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue."""
    return _kept(spark, path, schemas.SCENE)


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """The embeddings of targets."""
    return _kept(spark, path, schemas.EMBEDDING)


def training_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that don't parse are kept in ``_corrupt_record``."""
    s = schemas.schema(schemas.TRAINING_RECORD).add("_corrupt_record", "string")
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def raster_folder(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content, length of the raster files of a folder (not below)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", RASTERS).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", F.col("length").alias("file_size_bytes"))


def ingested(files: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Outcome of each file (file_name, content): scene_id, file_hash, format,
    and outcome NEW, DUPLICATE, EMPTY_BUFFER or UNSUPPORTED."""
    df = files.select(
        "file_name", F.sha2("content", 256).alias("file_hash"), F.length("content").alias("bytes"),
        file_format(F.col("file_name"), F.lit(None).cast("string"), F.col("content")).alias("format"),
        from_file_name(F.col("file_name"), F.lit(3)).alias("told"),
    )
    df = df.withColumn("scene_id", scene_id(F.col("told.sensor"), F.col("told.date"), F.col("file_hash")))
    first = df.groupBy("file_hash").agg(F.min("file_name").alias("first_name"))
    seen = known_hashes.select("file_hash", F.lit(True).alias("known")).distinct()
    df = df.join(first, "file_hash").join(seen, "file_hash", "left")
    outcome = (
        F.when(F.col("bytes") == 0, "EMPTY_BUFFER").when(F.col("format") == "UNKNOWN", "UNSUPPORTED")
        .when(F.col("known") | (F.col("file_name") != F.col("first_name")), "DUPLICATE").otherwise("NEW")
    )
    return df.select("scene_id", "file_name", "file_hash", "format", F.coalesce(outcome, F.lit("NEW")).alias("outcome"))
