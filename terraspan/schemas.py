"""Table schemas as Spark DDL, and the enumerations they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAND = "STRUCT<index:INT,name:STRING,data_type:STRING,min:DOUBLE,max:DOUBLE,mean:DOUBLE,std_dev:DOUBLE,nodata_value:DOUBLE,wavelength_nm:DOUBLE>"
BOUNDS = "STRUCT<min_x:DOUBLE,min_y:DOUBLE,max_x:DOUBLE,max_y:DOUBLE,min_lng:DOUBLE,min_lat:DOUBLE,max_lng:DOUBLE,max_lat:DOUBLE>"
RESOLUTION = "STRUCT<pixel_width:DOUBLE,pixel_height:DOUBLE,unit:STRING,formatted:STRING>"
SAR_QUALITY = "STRUCT<polarization:STRING,speckle_severity:STRING,numerical_validity:BOOLEAN,enl:DOUBLE>"
QUALITY = (
    "STRUCT<file_readable:BOOLEAN,format_supported:BOOLEAN,metadata_completeness_score:INT,georeferencing_status:STRING,"
    "dimensions_valid:BOOLEAN,numerical_values_valid:BOOLEAN,nodata_value:DOUBLE,nodata_percentage:DOUBLE,"
    f"usable_pixel_percentage:DOUBLE,cloud_cover_status:STRING,cloud_cover_percentage:DOUBLE,sar_quality:{SAR_QUALITY},warnings:ARRAY<STRING>>"
)
STEP = "STRUCT<step:STRING,timestamp:TIMESTAMP,status:STRING,details:STRING,tool:STRING>"
PROVENANCE = (
    "STRUCT<scene_id:STRING,file_hash:STRING,source_file_name:STRING,ingestion_timestamp:TIMESTAMP,"
    f"pipeline_version:STRING,file_size_bytes:BIGINT,steps:ARRAY<{STEP}>>"
)
SCENE = (
    "scene_id STRING, file_name STRING, file_hash STRING, format STRING, file_size_bytes BIGINT, width INT, height INT, band_count INT, "
    f"bands ARRAY<{BAND}>, crs STRING, epsg INT, transform ARRAY<DOUBLE>, bounds {BOUNDS}, resolution {RESOLUTION}, "
    "acquisition_date TIMESTAMP, sensor STRING, satellite STRING, modality STRING, source STRING, "
    f"quality {QUALITY}, provenance {PROVENANCE}, thumbnail_path STRING, stored_file_path STRING, ingested_at TIMESTAMP, "
    "processing_version STRING, status STRING, rejection_reason STRING"
)
EMBEDDING = "scene_id STRING, file_hash STRING, vector ARRAY<DOUBLE>, added_at TIMESTAMP, dimension INT"
EMBEDDING_CACHE = (
    "cache_key STRING, target_id STRING, target_type STRING, vector ARRAY<DOUBLE>, dimension INT, model_version STRING, "
    "preprocessor_version STRING, created_at TIMESTAMP"
)
OBSERVATION = (
    "location_id STRING, ord INT, scene_id STRING, acquisition_date TIMESTAMP, sensor STRING, satellite STRING, modality STRING, "
    "status STRING, exclusion_reason STRING, cloud_cover_pct DOUBLE"
)
CHANGE_REGION = (
    "region_id STRING, min_x INT, min_y INT, max_x INT, max_y INT, pixel_area BIGINT, physical_area_m2 DOUBLE, area_status STRING, "
    "mean_magnitude DOUBLE, max_magnitude DOUBLE, spatial_coherence STRING, density DOUBLE, semantic STRING"
)
PIXEL = "scene_id STRING, band STRING, x INT, y INT, value DOUBLE"
EO_PRODUCT = (
    "source STRING, product_id STRING, title STRING, satellite STRING, sensor STRING, acquisition_time STRING, bbox ARRAY<DOUBLE>, "
    "resolution STRING, product_type STRING, access STRING, download_available BOOLEAN, cloud_cover_percentage DOUBLE, "
    "is_temporal_pair BOOLEAN, semantic_description STRING, semantic_tags ARRAY<STRING>"
)
REVIEW_CANDIDATE = (
    "candidate_id STRING, status STRING, source_type STRING, enqueued_at TIMESTAMP, updated_at TIMESTAMP, source_run_id STRING, "
    "identity STRUCT<scene_id:STRING,file_name:STRING,location_name:STRING,crs:STRING,sensors:ARRAY<STRING>,modality:STRING,acquisition_dates:ARRAY<STRING>>, "
    "retrieval STRUCT<original_query:STRING,retrieval_method:STRING,similarity_score:DOUBLE>, "
    "temporal STRUCT<earliest_supported:STRING>, "
    "change STRUCT<change_classification:STRING,change_percentage:DOUBLE,changed_pixel_count:BIGINT,total_scene_pixels:BIGINT,change_method:STRING>, "
    "quality STRUCT<overall_status:STRING,registration_status:STRING,seasonal_severity:STRING,cloud_status:STRING>, "
    "analyst_decision STRUCT<decision:STRING,timestamp:TIMESTAMP,rejection_reason:STRING,confirmed_evidence:ARRAY<STRING>,analyst_notes:STRING>"
)
AUDIT = (
    "event_id STRING, timestamp TIMESTAMP, run_id STRING, candidate_id STRING, scene_id STRING, operation STRING, status STRING, "
    "details MAP<STRING,STRING>, relevant_version STRING, provenance_ref STRING"
)
FEEDBACK = (
    "feedback_id STRING, timestamp TIMESTAMP, candidate_id STRING, reference_scene_id STRING, change_type STRING, "
    "analyst_decision STRING, rejection_reason STRING"
)
TRAINING_RECORD = (
    "id STRING, images ARRAY<STRUCT<path:STRING,tensor_path:STRING,modality:STRING>>, task_type STRING, question STRING, answer STRING, "
    "choices ARRAY<STRING>, caption STRING, grounding_info ARRAY<MAP<STRING,STRING>>, geographic_info MAP<STRING,STRING>, source STRING, split STRING"
)

REVIEW_STATUSES = ["NEW", "IN_REVIEW", "CONFIRMED", "REJECTED", "UNCERTAIN", "ARCHIVED"]
MODALITIES = ["optical", "sar", "multispectral", "unknown"]
FORMATS = ["GeoTIFF", "TIFF", "COG", "PNG", "JPEG", "UNKNOWN"]
FINAL_STATES = [
    "NO_SIGNIFICANT_CHANGE", "POSSIBLE_CHANGE", "SUPPORTED_CHANGE", "LIKELY_SEASONAL_VARIATION", "REGISTRATION_UNCERTAIN",
    "LOW_QUALITY", "CROSS_SENSOR_UNCERTAIN", "EVIDENCE_CONFLICT", "INSUFFICIENT_EVIDENCE",
]
AUDIT_OPERATIONS = [
    "SEARCH_PERFORMED", "SIMILAR_SITE_DISCOVERY", "TEMPORAL_ANALYSIS", "CHANGE_DISCOVERY", "CANDIDATE_ENQUEUED",
    "CANDIDATE_CONFIRMED", "CANDIDATE_REJECTED", "CANDIDATE_MARKED_UNCERTAIN", "BULK_REVIEW_APPLIED", "EXPORT_GENERATED",
]


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def missing_as_null(scenes: DataFrame) -> DataFrame:
    """Sentinels of missing data as null, and ``is_georeferenced``."""
    crs, status = F.col("crs"), F.col("quality.georeferencing_status")
    return scenes.withColumns({
        "is_georeferenced": F.coalesce(crs.isNotNull() & (crs != "unavailable") & (status == "AVAILABLE"), F.lit(False)),
        "crs": unless(crs, "unavailable"),
        "sensor": unless(F.col("sensor"), "UNKNOWN"),
        "satellite": unless(F.col("satellite"), "UNKNOWN"),
    })


def unless(col: Column, sentinel: str) -> Column:
    return F.when(col != sentinel, col)
