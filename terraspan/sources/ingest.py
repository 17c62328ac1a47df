"""Ingest of raster files into the catalogue, and what is appended to."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraspan.functions import vectors
from terraspan.functions.language import from_file_name, scene_id
from terraspan.operators import catalog
from terraspan.sources import rasters


def described(files: DataFrame) -> DataFrame:
    """A row per file (file_name, content) with what its header and name tell,
    and why it can't be a scene (``refused``: EMPTY_BUFFER, UNSUPPORTED,
    DAMAGED, else null).  A day that doesn't exist (20200231) is part of the id
    but no date.  Nothing is shuffled; files may be a stream."""
    df = files.withColumns({"file_hash": F.sha2("content", 256), "file_size_bytes": F.length("content").cast("long")})
    df = rasters.raw_headers(df, "file_name", "file_hash", "file_size_bytes")
    s, m, told = rasters.scene_header(F.col("h")), rasters.chat_metadata(F.col("h")), from_file_name(F.col("file_name"), F.coalesce(F.col("h.samples"), F.lit(3)))
    df = df.withColumns({"s": s, "m": m, "told": told})
    day = F.coalesce(F.substring("s.acquisition_date", 1, 10), F.col("told.date").cast("string"))
    refused = F.when(F.col("h.kind") == "EMPTY", "EMPTY_BUFFER").when(F.col("h.kind") == "UNKNOWN", "UNSUPPORTED").when(F.col("h.kind") == "BROKEN", "DAMAGED")
    return df.select(
        scene_id(F.col("told.sensor"), day, F.col("file_hash")).alias("scene_id"), "file_name", "file_hash", "file_size_bytes", F.col("h.kind").alias("format"),
        "h.width", "h.height", F.coalesce("s.band_count", "m.bands").alias("band_count"), "s.bands", "s.crs", "s.epsg", "s.transform", "m.bounds",
        F.coalesce(F.try_to_timestamp("s.acquisition_date"), F.try_to_timestamp(day)).alias("acquisition_date"), "told.sensor", "told.satellite",
        F.coalesce("told.modality", "s.modality").alias("modality"), refused.alias("refused"),
    )


def scene_rows(files: DataFrame, known: DataFrame) -> DataFrame:
    """A row per file (file_name, content) with what its header and name tell
    and its outcome: NEW, DUPLICATE (content known, or another of these files
    has it), EMPTY_BUFFER, DAMAGED or UNSUPPORTED.  ``known``: file_hash.

    The contents aren't shuffled: hash and header are taken where they are read.
    """
    df = described(files)
    first = df.groupBy("file_hash").agg(F.min("file_name").alias("first_name"))
    seen = known.select("file_hash").distinct().withColumn("known", F.lit(True))
    df = df.join(first, "file_hash").join(seen, "file_hash", "left")
    copy = F.when(F.col("known") | (F.col("file_name") != F.col("first_name")), "DUPLICATE").otherwise("NEW")
    return df.withColumn("outcome", F.coalesce("refused", copy)).drop("known", "first_name", "refused")


def append_scenes(rows: DataFrame, path: str) -> DataFrame:
    """Appends the NEW rows to the catalogue at ``path`` and returns its totals.

    One writer at a time; a part file appears whole or not at all.
    """
    rows.where("outcome = 'NEW'").drop("outcome").withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(path)
    scenes = rows.sparkSession.read.parquet(path)
    return catalog.archive_stats(scenes, "modality", "format", "file_size_bytes", F.col("epsg").isNotNull(), "ingested_at")


def embedded(targets: DataFrame, cache: DataFrame, text: str, model: str, preprocessor: str) -> DataFrame:
    """The cache's new rows: embeddings of the targets (target_id and text)
    whose key it doesn't have yet, each key once."""
    key = vectors.cache_key(F.col(text), model, preprocessor)
    new = vectors.missing_embeddings(targets, cache, key).dropDuplicates(["cache_key"])
    found = new.join(vectors.embed_text(new, "cache_key", text), "cache_key")
    return found.select(
        "cache_key", F.col("target_id").cast("string").alias("target_id"), F.lit("text").alias("target_type"), "vector",
        F.lit(vectors.DIMENSION).alias("dimension"), F.lit(model).alias("model_version"), F.lit(preprocessor).alias("preprocessor_version"), F.current_timestamp().alias("created_at"),
    )


def enqueued(candidates: DataFrame, queue: DataFrame, key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """The candidates that the queue doesn't have yet, as NEW rows of it, and
    an audit event for each."""
    new = candidates.join(queue.select(key), key, "left_anti").dropDuplicates([key])
    new = new.withColumns({"status": F.lit("NEW"), "enqueued_at": F.current_timestamp()})
    name = F.concat(F.lit("EVT-"), F.substring(F.sha2(F.concat_ws("|", F.lit("ENQUEUED"), key).cast("binary"), 256), 1, 16))
    events = new.select(name.alias("event_id"), F.col("enqueued_at").alias("timestamp"), key, F.lit("CANDIDATE_ENQUEUED").alias("operation"), F.lit("SUCCESS").alias("status"))
    return new, events


def folder_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """extension, files, bytes of a folder and all below; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise(F.lit(""))
    return files.groupBy(ending.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def write_benchmark(metrics: DataFrame, path: str) -> None:
    """metrics (name, value, target) as JSON and as a Markdown table, each one file."""
    met = F.when(F.col("value") >= F.col("target"), "met").otherwise("missed")
    rows = metrics.withColumn("outcome", met).orderBy("name")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    line = F.format_string("| %s | %.4f | %.4f | %s |", "name", "value", "target", "outcome")
    head = metrics.sparkSession.createDataFrame([(0, "| metric | value | target | outcome |"), (1, "|-|-|-|-|")], "place int, value string")
    body = rows.select(F.lit(2).alias("place"), line.alias("value"))
    head.unionByName(body).orderBy("place", "value").coalesce(1).select("value").write.mode("overwrite").text(f"{path}/report")


def audit_text(queue: DataFrame) -> DataFrame:
    """candidate_id, report: the full audit report of each candidate, plain text."""
    rule, none = "=" * 60, F.lit("Not available")

    def part(title: str, *lines: tuple[str, Column]) -> list[Column]:
        return [F.lit(f"\n{title}\n{'-' * len(title)}"), *[F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), none)) for name, value in lines]]

    c = F.col
    body = [
        F.lit(f"{rule}\nEVIDENCE AND AUDIT REPORT\n{rule}"),
        *part("Candidate", ("Id", c("candidate_id")), ("Status", c("status")), ("Origin", c("source_type")), ("Run", c("source_run_id"))),
        *part("Scene", ("Location", c("identity.location_name")), ("CRS", c("identity.crs")), ("Sensors", F.array_join("identity.sensors", ", ")),
              ("Modality", F.upper("identity.modality")), ("Dates", F.array_join("identity.acquisition_dates", " to "))),
        *part("Retrieval", ("Similarity", F.format_string("%.3f", "retrieval.similarity_score"))),
        *part("Change", ("Class", c("change.change_classification")), ("Share", F.format_string("%.2f%%", "change.change_percentage")),
              ("Pixels", F.format_string("%d of %d", "change.changed_pixel_count", "change.total_scene_pixels")), ("First supported", c("temporal.earliest_supported"))),
        *part("Quality", ("Overall", c("quality.overall_status")), ("Registration", c("quality.registration_status")), ("Season", c("quality.seasonal_severity")), ("Cloud", c("quality.cloud_status"))),
        *part("Decision", ("Analyst", F.coalesce(c("analyst_decision.decision"), F.lit("PENDING"))), ("Reason", c("analyst_decision.rejection_reason"))),
    ]
    return queue.select("candidate_id", F.concat_ws("\n", *body).alias("report"))


#: The tools by name: tasks and modalities they serve, and the function.
TOOLS: dict[str, tuple[set[str], set[str], object]] = {}


def tool(name: str, tasks: set[str], modalities: set[str]):
    """Registers a function of columns or frames as a tool."""

    def add(f):
        TOOLS[name] = (tasks, modalities, f)
        return f

    return add


def tools_for(task: str, modality: str | None = None) -> dict[str, object]:
    """The tools of a task, by name, that take the modality."""
    return {n: f for n, (tasks, kinds, f) in sorted(TOOLS.items()) if task in tasks and (modality is None or modality in kinds or "ALL" in kinds)}


tool("validateRaster", {"METADATA_PROVENANCE", "SCENE_INTERPRETATION", "BI_TEMPORAL_ANALYSIS", "SAR_ANALYSIS", "OPTICAL_SAR_ANALYSIS"}, {"ALL"})(rasters.validated)
tool("inspectBands", {"METADATA_PROVENANCE", "SCENE_INTERPRETATION"}, {"ALL"})(rasters.chat_metadata)
tool("identifyPolarization", {"SAR_ANALYSIS"}, {"SAR"})(rasters.polarization)


def tool_table(spark: SparkSession) -> DataFrame:
    """name, tasks, modalities of every tool."""
    kind = T.StructType.fromDDL("name string, tasks array<string>, modalities array<string>")
    return spark.createDataFrame([(n, sorted(t), sorted(m)) for n, (t, m, _) in sorted(TOOLS.items())], kind)


def capability_json(spark: SparkSession) -> str:
    """The tool table as JSON (a few rows)."""
    return json.dumps([r.asDict() for r in tool_table(spark).collect()])
