"""Analyst review: decisions, state, queue, audit and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan import schemas
from terraspan.functions.language import csv_field
from terraspan.functions.rules import cascade
from terraspan.operators.catalog import asked, contains

#: Columns of the CSV export.
CSV_COLUMNS = [
    "candidate_id", "status", "source_type", "change_type", "change_percentage", "earliest_supported", "sensors", "acquisition_dates",
    "location_name", "crs", "similarity_score", "quality_status", "registration_status", "decision", "decision_timestamp", "rejection_reason", "run_id",
]
OPERATIONS = {"CONFIRMED": "CANDIDATE_CONFIRMED", "REJECTED": "CANDIDATE_REJECTED", "UNCERTAIN": "CANDIDATE_MARKED_UNCERTAIN"}
DECISIONS = list(OPERATIONS)


def allowed(status: Column, decision: Column) -> Column:
    """Whether a decision may be taken: any state but ARCHIVED."""
    return decision.isin(*DECISIONS) & ~status.eqNullSafe("ARCHIVED")


def current_state(queue: DataFrame, events: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The queue after its decision log (key, ts, seq, decision): the last
    allowed decision of a candidate is its status; archived ones don't change."""
    last = events.where(F.col("decision").isin(*DECISIONS)).groupBy(key).agg(
        F.max_by("decision", F.struct("ts", "seq")).alias("decision"), F.max("ts").alias("decided_at"), F.count(F.lit(1)).alias("decisions"),
    )
    df = queue.join(last, key, "left")
    ok = F.coalesce(allowed(F.col("status"), F.col("decision")), F.lit(False))
    return df.withColumns({
        "status": F.when(ok, F.col("decision")).otherwise(F.col("status")), "decision": F.when(ok, F.col("decision")),
        "decided_at": F.when(ok, F.col("decided_at")), "decisions": F.when(ok, F.col("decisions")).otherwise(F.lit(0)),
    })


def bulk_decision(queue: DataFrame, ids: DataFrame, decision: str, key: str = "candidate_id") -> DataFrame:
    """Per requested id whether it was updated; unknown and archived ones fail
    alone."""
    df = ids.select(key).join(queue.select(key, "status"), key, "left")
    ok = F.col("status").isNotNull() & allowed(F.col("status"), F.lit(decision))
    return df.select(key, F.coalesce(ok, F.lit(False)).alias("updated"), F.when(ok, F.lit(OPERATIONS[decision])).alias("operation"))


def status_counts(queue: DataFrame) -> DataFrame:
    """status, n for every status, also those nobody has."""
    spark = queue.sparkSession
    every = spark.createDataFrame([(s,) for s in schemas.REVIEW_STATUSES], "status string")
    counts = queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def query_queue(queue: DataFrame, *, status=None, change_type=None, sensor=None, quality=None, search=None, sort_by: str = "RELEVANCE", order: str = "DESC",
                columns: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """Filtered and sorted candidates; ties by id.

    ``compat`` keeps the inverted order of four of the sorts: RELEVANCE and
    CHANGE_PERCENTAGE lowest first and NEWEST oldest first unless ASC.
    """
    c = {
        "id": "candidate_id", "status": "status", "change_type": "change.change_classification", "sensors": "identity.sensors",
        "quality": "quality.overall_status", "location": "identity.location_name", "file_name": "identity.file_name",
        "query": "retrieval.original_query", "enqueued": "enqueued_at", "change": "change.change_percentage", "similarity": "retrieval.similarity_score",
    } | (columns or {})
    if asked(status):
        queue = queue.where(F.col(c["status"]) == status)
    if asked(change_type):
        queue = queue.where(F.lower(c["change_type"]) == change_type.lower())
    if asked(sensor):
        queue = queue.where(F.exists(F.col(c["sensors"]), lambda s: contains(s, sensor)))
    if asked(quality):
        queue = queue.where(F.col(c["quality"]) == quality)
    if asked(search):
        hit = F.lit(False)
        for k in ("id", "location", "file_name", "change_type", "query"):
            hit = hit | contains(F.col(c[k]).cast("string"), search)
        queue = queue.where(hit)
    column, natural = {
        "NEWEST": (c["enqueued"], "desc"), "OLDEST": (c["enqueued"], "asc"), "CHANGE_PERCENTAGE": (c["change"], "desc"),
        "STATUS": (c["status"], "asc"), "QUALITY": (c["quality"], "asc"), "RELEVANCE": (c["similarity"], "desc"),
    }[sort_by]
    if sort_by in ("STATUS", "QUALITY"):
        down = order != "ASC"
    elif compat:
        down = (natural == "desc") == (order == "ASC")
    else:
        down = natural == "desc" if order != "ASC" or sort_by == "OLDEST" else False
    key = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_first()
    return queue.orderBy(key, F.col(c["id"]))


def decision_events(decisions: DataFrame) -> DataFrame:
    """Audit rows of decisions (candidate_id, scene_id, run_id, ts, decision)."""
    op = cascade([(F.col("decision") == d, o) for d, o in OPERATIONS.items()])
    key = F.concat_ws("|", "candidate_id", "run_id", F.col("ts").cast("string"), "decision")
    return decisions.where(op.isNotNull()).select(
        F.concat(F.lit("EVT-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16)).alias("event_id"), F.col("ts").alias("timestamp"),
        "run_id", "candidate_id", "scene_id", op.alias("operation"), F.lit("SUCCESS").alias("status"),
        F.create_map(F.lit("decision"), F.col("decision")).alias("details"),
    )


def run_id(ts: Column, key: Column) -> Column:
    """RUN-yyyymmdd-hhmmss-XXXX, the last part from a hash of the key."""
    return F.concat(F.lit("RUN-"), F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), F.upper(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 4)))


def export_columns(queue: DataFrame) -> DataFrame:
    """The export's 17 flat text columns with their defaults."""
    q = queue
    cols = {
        "candidate_id": F.col("candidate_id"), "status": F.col("status"), "source_type": F.col("source_type"),
        "change_type": F.col("change.change_classification"), "change_percentage": F.format_string("%.1f", F.col("change.change_percentage")),
        "earliest_supported": F.coalesce(F.nullif(F.col("temporal.earliest_supported"), F.lit("")), F.lit("N/A")),
        "sensors": F.array_join("identity.sensors", "; "), "acquisition_dates": F.array_join("identity.acquisition_dates", " to "),
        "location_name": F.col("identity.location_name"), "crs": F.coalesce(F.nullif(F.col("identity.crs"), F.lit("")), F.lit("UNREFERENCED")),
        "similarity_score": F.format_string("%.3f", F.col("retrieval.similarity_score")), "quality_status": F.col("quality.overall_status"),
        "registration_status": F.col("quality.registration_status"), "decision": F.coalesce(F.col("analyst_decision.decision"), F.lit("PENDING")),
        "decision_timestamp": F.coalesce(F.date_format("analyst_decision.timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
        "rejection_reason": F.coalesce(F.col("analyst_decision.rejection_reason"), F.lit("")), "run_id": F.col("source_run_id"),
    }
    return q.select(*[cols[c].alias(c) for c in CSV_COLUMNS])


def csv_lines(queue: DataFrame) -> DataFrame:
    """line: the quoted CSV line of each candidate."""
    flat = export_columns(queue)
    return flat.select("candidate_id", F.concat_ws(",", *[csv_field(F.col(c)) for c in CSV_COLUMNS]).alias("line"))


def write_csv(queue: DataFrame, path: str) -> None:
    export_columns(queue).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def json_lines(queue: DataFrame) -> DataFrame:
    return queue.select("candidate_id", F.to_json(F.struct(*queue.columns)).alias("json"))


def markdown(queue: DataFrame) -> DataFrame:
    """candidate_id, report: a short audit report of each candidate."""
    none = F.lit("n/a")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# Evidence and audit report "), F.col("candidate_id")),
        F.concat(F.lit("- Location: "), F.coalesce(F.col("identity.location_name"), none)),
        F.concat(F.lit("- CRS: "), F.coalesce(F.col("identity.crs"), F.lit("Unreferenced"))),
        F.concat(F.lit("- Dates: "), F.array_join("identity.acquisition_dates", " → ")),
        F.concat(F.lit("- Sensors: "), F.array_join("identity.sensors", ", "), F.lit(" ("), F.upper("identity.modality"), F.lit(")")),
        F.lit("## Change"),
        F.concat(F.lit("- Class: "), F.col("change.change_classification")),
        F.format_string("- Extent: %.2f%% (%d of %d pixels)", "change.change_percentage", "change.changed_pixel_count", "change.total_scene_pixels"),
        F.concat(F.lit("- First supported: "), F.coalesce(F.col("temporal.earliest_supported"), F.lit("Single Observation"))),
        F.lit("## Quality"),
        F.concat(F.lit("- Overall: "), F.col("quality.overall_status"), F.lit(", registration: "), F.col("quality.registration_status")),
        F.concat(F.lit("- Season: "), F.coalesce(F.col("quality.seasonal_severity"), F.lit("NONE")), F.lit(", cloud: "), F.coalesce(F.col("quality.cloud_status"), none)),
        F.lit("## Decision"),
        F.concat(F.lit("- "), F.col("status"), F.lit(", "), F.coalesce(F.col("analyst_decision.decision"), F.lit("PENDING ANALYST VERIFICATION"))),
    )
    return queue.select("candidate_id", body.alias("report"))


def events_where(events: DataFrame, limit: int = 100, tie: str | None = None, **equal: str | None) -> DataFrame:
    """Newest audit or feedback rows with the given values; ``tie``: the column
    that orders rows of one time."""
    for k, v in equal.items():
        if asked(v):
            events = events.where(F.col(k) == v)
    return events.orderBy(F.col("timestamp").desc(), *([tie] if tie else [])).limit(limit)
